"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows under one key from which the key is split over several tasks.
HOT_ROWS = 100_000


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, tie: Column, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined to ``right`` on ``key``; each row of ``right`` has the number of left rows with its key in ``rows``.

    Keys with at least ``hot_rows`` left rows get one copy of their right row per ``hot_rows`` left
    rows, and each left row goes to one of the copies by the hash of ``tie``. The list of hot keys
    is broadcast: it has at most (left rows / ``hot_rows``) entries, 10 MB for 10^11 rows, because
    no key enters it with fewer rows. Column ``rows`` stays only for joins that keep the right side.
    """
    copies = F.ceil(F.col(rows) / F.lit(float(hot_rows))).cast("int")
    hot = right.filter(F.col(rows) >= hot_rows).select(F.col(key).alias("_hot_key"), copies.alias("_copies")).distinct()
    many = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    many = many.withColumn("_salt", F.when(F.col("_copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(tie), F.col("_copies")).cast("int"))).drop("_hot_key", "_copies")
    last = F.when(F.col(rows) >= hot_rows, copies - 1).otherwise(F.lit(0))
    few = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return many.join(few, [key, "_salt"], how).drop("_salt")
