"""Stored files and rows by place: sizes of what is stored, rows in a caller's order, batches, and the end of a namespace."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.common import numbered


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, path, bytes, modified) of all files below a folder; the namespace is the first folder, empty for files beside them. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.lit("^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in without_scheme(path).rstrip("/") + "/")), "")
    return files.select(F.when(below.contains("/"), F.regexp_extract(below, r"^([^/]*)/", 1)).otherwise("").alias("namespace"), "path", "bytes", "modified")


def without_scheme(path: str) -> str:
    head, colon, rest = path.partition(":")
    return "/" + rest.lstrip("/") if colon and head.isalpha() else path


def sizes(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """files, bytes and the newest change below a folder, altogether or by namespace."""
    return stored_files(spark, path).groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("modified").alias("modified"))


def purge(spark: SparkSession, path: str) -> bool:
    """Deletes a namespace's folder, wherever it is stored; False if there was none. What lies above a namespace, with fewer than three names, isn't deleted."""
    if len([p for p in without_scheme(path).split("/") if p]) < 3:
        raise ValueError("this isn't the folder of a namespace")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(target)) and bool(system.delete(target, True))


def gathered(spark: SparkSession, store: str, wanted: DataFrame, batch_rows: int, place: str = "row_number") -> DataFrame:
    """The rows of an imported snapshot (see ``files.import_snapshot``, of ``batch_rows`` places a shard) at the places ``wanted`` (pos, place), in order of pos: a place that is wanted twice comes twice.

    Only shards that hold a wanted place are read, as many names as there are shards at most, and of those only the wanted ones' row groups. A place that isn't stored raises.
    """
    asked = wanted.select("pos", F.col(place).alias("asked"))
    shards = sorted(r[0] for r in asked.select(F.floor(F.col("asked") / batch_rows).alias("shard")).distinct().collect() if r[0] is not None)
    bounds = asked.agg(F.min("asked").alias("lo"), F.max("asked").alias("hi")).first()
    rows = spark.read.parquet(f"{store}/rows").where(F.col("shard").isin(shards) if shards else F.lit(False))
    rows = rows.where(F.col(place).between(bounds["lo"], bounds["hi"]) if shards else F.lit(False)).drop("shard")
    found = asked.join(rows.withColumn("there_", F.lit(True)), F.col("asked") == F.col(place), "left")
    checked = F.when(F.col("there_").isNull(), F.raise_error(F.concat(F.lit("no row is stored at "), F.coalesce(F.col("asked").cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)
    return found.where(checked).select("pos", *rows.columns).orderBy("pos")


def batches(rows: DataFrame, size: int, *order: str) -> Iterator[list[Row]]:
    """The rows in order, ``size`` at a time; the driver holds a batch and a task's part of the rows."""
    if size < 1:
        raise ValueError("a batch has a row or more")
    held: list[Row] = []
    for r in (rows.orderBy(*order) if order else rows).toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def in_physical_order(rows: DataFrame, members: DataFrame, key: str = "id", place: str = "row_idx") -> DataFrame:
    """Rows of the members, in order of their places; ``pos`` numbers them from 1."""
    return numbered(rows.join(members.select(key).distinct(), key, "left_semi"), [F.col(place)], "pos").orderBy("pos")
