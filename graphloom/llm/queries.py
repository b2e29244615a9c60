"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import canonical, copies, encode, entities, leaks, names, sentences, subjects
from graphloom.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(load(spark, sf_dir, "crawler_output"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.found(*(load(spark, sf_dir, t) for t in ("entity_mapping", "private_kb", "external_items")))


def p2_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair with its calibrated confidence."""
    scored = entities.scored(*(load(spark, sf_dir, t) for t in ("entity_mapping", "private_kb", "external_items")))
    return scored.withColumn("confidence", F.round("confidence", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(load(spark, sf_dir, "extracted_knowledge"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.mapped(load(spark, sf_dir, "entity_mapping"), load(spark, sf_dir, "canonical_values"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.found(load(spark, sf_dir, "extracted_knowledge"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that was stored several times, with its number of copies."""
    return copies.collapsed(load(spark, sf_dir, "extracted_knowledge"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.ids(load(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(*(load(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_labels")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_confidences, p3_found, p4_found, p5_found, p5_collapsed, p6_ids, p7_found, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": canonical.FOUND_SQL, "p5_found": copies.FOUND_SQL, "p5_collapsed": copies.COLLAPSED_SQL}
