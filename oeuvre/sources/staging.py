"""Steps that are read several times, written once to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in a local session without one, a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, what: str = "stage") -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again.

    A lost executor takes nothing with it, and every later reader sees the same rows in the same partitions.
    """
    folder = os.path.join(shared_folder(df.sparkSession), f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
