"""The driver's tables: Parquet, read lazily."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views, of ``names`` or of all tables."""
    for name in names or NAMES:
        load(spark, folder, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder. Where both
    are unset, a temporary folder on a single machine; on a cluster that would scatter files over the executors'
    own disks, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "tidemill-shared")
