"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``.

    Where that setting is empty, a local session gets a temporary folder; a cluster's executors would not share one, so that is an error.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        place = "file://" + tempfile.mkdtemp(prefix="petrilake-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df, written in the shared folder and read again, so that what follows starts from a short plan."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
