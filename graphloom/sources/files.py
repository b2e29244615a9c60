"""Readers and writers of documents, mentions, relations and results. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import strip

DOCUMENT = "url string, title string, text string, date string, author string, method string, source_api string, domain string, crawled_at string, word_count int"
MENTION = "text string, type string, label string, source_url string, confidence double, method string"
RELATION = "subject string, subject_type string, predicate string, object string, object_type string, source_url string, method string"
ENTITY_MAPPING = "private_entity string, label string, wikidata_qid string, wikidata_uri string, confidence double, status string"
PREDICATE_MAPPING = "private_predicate string, predicate_slug string, wikidata_pid string, wikidata_uri string, confidence double, status string"
NEIGHBOURS = "map<string, array<struct<entity: string, label: string, sim: double>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, quoted as by RFC 4180; strings without white space at their ends."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(schema).csv(path)
    return df.select(*(strip(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str, schema: str) -> None:
    """The columns of ``schema`` only, in its order."""
    df.select(*(c.split()[0] for c in schema.split(", "))).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(seed, rank, entity, label, sim) of a JSON map of neighbour lists."""
    value = spark.read.option("wholetext", True).text(path).select(F.from_json("value", NEIGHBOURS).alias("m"))
    lists = value.select(F.explode("m").alias("seed", "list"))
    return lists.select("seed", F.posexplode("list").alias("rank", "n")).select("seed", "rank", "n.entity", "n.label", "n.sim")


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def first_text(primary: DataFrame, secondary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A source with another to fall back on: the first text of each key that isn't blank."""
    b = secondary.select(key, F.col(text).alias("_b"))
    return primary.join(b, key, "full").withColumn(text, F.coalesce(F.when(strip(text) != "", F.col(text)), F.col("_b"))).drop("_b")
