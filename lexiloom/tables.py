"""Opening the tables of a data folder and keeping intermediate results."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all workers share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, one machine (a local master) takes a folder of its own; a cluster raises ValueError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all workers share")
    return str(Path(tempfile.gettempdir()) / "lexiloom-shared")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so later reads neither recompute nor depend on executors.

    Spark deletes the files when the result is no longer referred to, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores if its files can't occupy them; else as it is, so a large table is never shuffled for this.

    Only the layout differs; no result depends on it.
    """
    context = df.sparkSession.sparkContext
    cores = context.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a data folder."""
    return spread(table(spark, folder, "documents"), "doc_id")
