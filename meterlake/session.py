"""A session as the engine wants it: UTC, adaptive plans; and tables between two passes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "meterlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share; a temporary folder only where it is unset and the
    master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)


def written(df: DataFrame) -> DataFrame:
    """df, written once and read again: later passes see the same rows, whatever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/between-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
