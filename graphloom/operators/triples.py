"""Graphs as DataFrames: union, insertion of what is new, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.rdf import COLUMNS


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Equality of triples; literals of other types or languages differ."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in COLUMNS))


def union(*graphs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (g.select(*COLUMNS) for g in graphs)).distinct()


def novel(graph: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts that the graph doesn't have yet. Triples meet by one 64-bit hash; equality of all their parts decides."""
    hashed = lambda df: df.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_h"))
    facts, graph = hashed(facts).dropDuplicates(["_h", *COLUMNS]), hashed(graph)
    return facts.join(graph, (facts["_h"] == graph["_h"]) & _same(facts, graph), "left_anti").drop("_h")


def insert(graph: DataFrame, facts: DataFrame) -> DataFrame:
    return union(graph, facts)


def remove(graph: DataFrame, condition: Column) -> DataFrame:
    return graph.filter(~F.coalesce(condition, F.lit(False)))


def stats(graph: DataFrame) -> DataFrame:
    """One row: triples, subjects, objects and entities that are IRIs, predicates. One pass: nodes are counted by role."""
    triples = graph.select(*COLUMNS).distinct()
    node = lambda c, role: F.struct(F.col(c).alias("node"), F.lit(role).alias("role"))
    nodes = triples.select(
        F.explode(F.filter(F.array(F.when(~F.col("s").startswith("_:"), node("s", "s")), F.when(F.col("o_kind") == "uri", node("o", "o")), node("p", "p")), lambda x: x.isNotNull())).alias("n")
    ).select("n.*")
    roles = nodes.groupBy("node").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in "sop"))
    counts = roles.agg(F.sum("s").alias("subjects"), F.sum("o").alias("objects"), F.sum(F.greatest("s", "o")).alias("entities"), F.sum("p").alias("predicates"))
    return counts.crossJoin(triples.agg(F.count(F.lit(1)).alias("triples"))).select(*(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("triples", "subjects", "objects", "entities", "predicates")))


def top_counts(df: DataFrame, key: Column | str, name: str, limit: int | None = None) -> DataFrame:
    """The most frequent values with their counts; ties by value."""
    out = df.select((F.col(key) if isinstance(key, str) else key).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)
    return out.limit(limit) if limit else out
