"""Problem 5: duplicates hidden by formatting differences.

Progressive refinement of partitions. Rows first fall into classes by what is cheapest to know: type, label and how often text
and address have each of a few letters, case aside (``LETTERS``: a replace and a length each, without regular expressions or arrays).
Only inside classes with several members come the stripped lengths and whole histograms of letters, and only inside what
is left the full normal form, with the parameters sorted. Each step counts its classes with a partial aggregate of
(hash, count) pairs and keeps the rows of classes with several members by a join that splits hot classes, so no class is gathered in
one task. What a dear step works on is written to the checkpoint folder first, so that nothing dear is computed twice.

Defined cases: a null text or address, or a text without letter or digit: no copies. Null type or
label equals null only. An empty address is a value like any other. Repeated ``mention_id`` values
count as one row, rows without one aren't reported. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.skew import HOT_ROWS, hot_join
from graphloom.sources.tables import cut

#: Letters that are counted first; any choice is right, letters that vary much keep more rows apart.
LETTERS = "aeioulnrst"
_NOT_ALNUM = r"[^\p{L}\p{N}]+"


def folded(c: Column) -> Column:
    """Only letters and digits, without case."""
    return F.lower(F.upper(F.regexp_replace(c, _NOT_ALNUM, "")))


def text_key(text: Column) -> Column:
    return folded(text)


def address_key(url: Column) -> Column:
    """Path, sorted parameters and fragment, each with letters and digits only; empty parameters don't count."""
    body = F.substring_index(url, "#", 1)
    fragment = F.when(F.instr(url, "#") > 0, F.expr("substring(_u, instr(_u, '#') + 1)")).otherwise(F.lit(""))
    path = F.substring_index(body, "?", 1)
    query = F.when(F.instr(body, "?") > 0, F.expr("substring(substring_index(_u, '#', 1), instr(substring_index(_u, '#', 1), '?') + 1)")).otherwise(F.lit(""))
    params = F.array_sort(F.filter(F.transform(F.split(query, "&"), folded), lambda x: x != ""))
    return F.concat(folded(path), F.lit("?"), F.array_join(params, "&"), F.lit("#"), folded(fragment))


def _counts(c: Column) -> list[Column]:
    """How often each of LETTERS is there, case aside."""
    s = F.lower(F.upper(c))
    return [F.length(s) - F.length(F.replace(s, F.lit(x))) for x in LETTERS]


def _histogram(c: Column) -> Column:
    """The stripped length and how often each letter is there, of a folded text."""
    return F.xxhash64(F.length(c), F.array_join(F.array_sort(F.split(c, "")), ""))


def _several(rows: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """The rows of classes with more than one member."""
    classes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    return hot_join(rows, classes, key, "_rows", F.col("mention_id"), "left_semi", hot_rows)


def copy_classes(mentions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(mention_id, first_id, copies) of each row that has copies."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = (
        mentions.select(F.col("mention_id"), known("type").alias("_t"), known("label").alias("_l"), F.col("text").alias("_x"), F.col("source_url").alias("_u"))
        .filter(F.col("mention_id").isNotNull() & F.col("_x").isNotNull() & F.col("_u").isNotNull())
        .withColumn("_k1", F.xxhash64("_t", "_l", *_counts(F.col("_x")), *_counts(F.col("_u"))))
    )
    rows = _several(rows, "_k1", hot_rows).filter(F.col("_x").rlike(r"[\p{L}\p{N}]"))
    rows = cut(rows.withColumn("_k2", F.xxhash64("_k1", _histogram(folded(F.col("_x"))), _histogram(folded(F.col("_u"))))).drop("_k1"))
    rows = _several(rows, "_k2", hot_rows)
    rows = cut(rows.select("mention_id", F.concat_ws("\u0001", "_t", "_l", text_key(F.col("_x")), address_key(F.col("_u"))).alias("_k3")))
    groups = rows.groupBy("_k3").agg(F.min("mention_id").alias("first_id"), F.max("mention_id").alias("_last"), F.count(F.lit(1)).alias("copies")).filter("_last > first_id")
    return hot_join(rows, groups.drop("_last"), "_k3", "copies", F.col("mention_id"), "inner", hot_rows).select("mention_id", "first_id", "copies")


def found(mentions: DataFrame) -> DataFrame:
    """(first_id, copy_id): each copy with the smallest id of its group."""
    return copy_classes(mentions).filter("mention_id > first_id").select("first_id", F.col("mention_id").alias("copy_id")).distinct()


def collapsed(mentions: DataFrame) -> DataFrame:
    """One row per record with its number of copies: ``first_id, copies`` of each group that has several rows."""
    return copy_classes(mentions).filter("mention_id = first_id").select("first_id", "copies").distinct()


_GROUPS_SQL = r"""
WITH r AS (
  SELECT mention_id, type, label, lower(upper(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS tk,
         split_part(source_url, '#', 1) AS body,
         CASE WHEN instr(source_url, '#') > 0 THEN substr(source_url, instr(source_url, '#') + 1) ELSE '' END AS frag
  FROM extracted_knowledge
  WHERE text IS NOT NULL AND source_url IS NOT NULL AND regexp_matches(text, '[\p{L}\p{N}]')
), k AS (
  SELECT mention_id, type, label, tk,
         lower(upper(regexp_replace(split_part(body, '?', 1), '[^\p{L}\p{N}]', '', 'g'))) AS path,
         list_sort(list_filter(list_transform(string_split(CASE WHEN instr(body, '?') > 0 THEN substr(body, instr(body, '?') + 1) ELSE '' END, '&'),
           lambda x: lower(upper(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')))), lambda x: x <> '')) AS params,
         lower(upper(regexp_replace(frag, '[^\p{L}\p{N}]', '', 'g'))) AS frag
  FROM r
), g AS (SELECT mention_id, min(mention_id) OVER w AS first_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY type, label, tk, path, params, frag))
"""
FOUND_SQL = _GROUPS_SQL + "SELECT DISTINCT first_id, mention_id AS copy_id FROM g WHERE mention_id > first_id"
COLLAPSED_SQL = _GROUPS_SQL + "SELECT DISTINCT first_id, copies FROM g WHERE mention_id = first_id AND copies > 1"
