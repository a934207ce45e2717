"""Insertion of shots as they arrive: the sums of a trilinear insertion can be added, so a stream keeps them as a table of (vox, num, den) parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.config import Grid
from voxelweave.operators.grid import insert, normalized


def insert_stream(points: DataFrame, value: Column, grid: Grid, path: str, checkpoint: str):
    """Start a query that adds every micro-batch of ``points`` (qx, qy, qz, ..) to the parts under ``path``. A batch that is repeated after a failure
    replaces its own part, so it is counted once."""

    def add(batch: DataFrame, number: int) -> None:
        insert(batch, value, grid).select("vox", "num", "den").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def inserted(spark: SparkSession, path: str) -> DataFrame:
    """(vox, num, den, w) of all parts so far."""
    parts = spark.read.parquet(path)
    return normalized(parts.groupBy("vox").agg(F.sum("num").alias("num"), F.sum("den").alias("den")))
