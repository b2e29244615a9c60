"""Readers of the parquet tables of a data folder."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir`` (a parquet file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, per_core: int = 2) -> DataFrame:
    """``df`` in enough partitions for work that is heavy on CPU.

    A scan of few or small files has fewer partitions than the cluster has cores; rows are then
    dealt out by the hash of ``key`` (unique, so no partition gets more than its share). A scan
    that already has a partition for every core is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core, F.xxhash64(key))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, a temporary one only in local tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
            atexit.register(shutil.rmtree, shared, True)
        sc.setCheckpointDir(f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if "://" in shared else shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there: lineage ends, lost executors cost nothing.

    free: the shuffle files that made it are removed at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not free:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_FREES)
    spark.conf.set(_FREES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which nothing else runs again
    finally:
        spark.conf.set(_FREES, before)
