"""Helpers of the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a list is numbered by one task.
ONE_TASK = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share; only a local master may do without one that the session names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str, rows: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 1, in a total order of all rows.

    A list of up to ONE_TASK rows is one task's window. A larger one is sorted over ranges, numbered in each, and moved by the
    ranges' counts, of which there is one for each partition. ``rows`` is the number of rows, if it is known.
    """
    if (df.count() if rows is None else rows) <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    columns = df.columns
    ranged = cut(df.orderBy(*order).withColumn("part_", F.spark_partition_id()))
    held = ranged.groupBy("part_").count()
    before = held.select("part_", (F.sum("count").over(W.orderBy("part_")) - F.col("count")).alias("before_"))
    inside = F.row_number().over(W.partitionBy("part_").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(before), "part_").select(*columns, (F.col(name) + F.col("before_")).cast("int").alias(name))
