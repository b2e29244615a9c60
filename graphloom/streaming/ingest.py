"""Beyond the batch operators: documents read as a stream, cleaned and searched for mentions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.terms import clean_text, word_count
from graphloom.operators.extract import pattern_mentions
from graphloom.sources.files import DOCUMENT


def documents(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def useful(docs: DataFrame, least_words: int = 200) -> DataFrame:
    """Cleaned documents with enough words; works on streams and tables alike."""
    return docs.withColumn("text", clean_text("text")).withColumn("word_count", word_count("text")).filter(F.col("word_count") >= least_words)


def mentions_to(docs: DataFrame, out: str, checkpoint: str, patterns: list[tuple[str, str]], available_now: bool = True) -> StreamingQuery:
    """Writes the mentions of a stream's documents as parquet. The sink is exactly-once by its checkpoint."""
    found = pattern_mentions(docs, "url", "text", patterns, case=True)
    w = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
