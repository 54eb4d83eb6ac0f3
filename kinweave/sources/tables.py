"""Tables of one row for each key that change by merges: buckets of keys, of which a merge rewrites only those that it touches, and a log that says which files count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from kinweave.operators.common import cut

LOG = "version long, bucket int, rows long"
LAYOUT = "key string, order array<string>, buckets int, schema string"


@dataclass(frozen=True)
class KeyedTable:
    """A table in a folder: ``data/version=V/bucket=B`` holds what merge V left in bucket B, ``log`` a file of each merge, ``layout`` what is fixed.

    Of a bucket the files of its last logged version count. A merge writes its files, then its log; what a broken merge left isn't read, and is overwritten when the merge is made again. One merge at a time may run.
    """

    path: str
    key: str
    order: tuple[str, ...]
    buckets: int
    schema: StructType

    def log(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(LOG).json(f"{self.path}/log/*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return spark.createDataFrame([], LOG)
            raise

    def versions(self, spark: SparkSession, version: int | None = None) -> dict[int, int]:
        """The version of each bucket that holds rows, up to ``version``: as many entries as buckets."""
        log = self.log(spark) if version is None else self.log(spark).where(F.col("version") <= version)
        return {r["bucket"]: r["version"] for r in log.where("bucket IS NOT NULL").groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def read(self, spark: SparkSession, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; as they are now, or were after a merge."""
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(self.versions(spark, version).items()) if buckets is None or b in buckets]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)


def created(spark: SparkSession, path: str, schema: StructType, key: str = "id", order: tuple[str, ...] = (), buckets: int = 64) -> KeyedTable:
    """A new table. Of two rows of a key the greater in ``order`` stays, the later merged of equals; without an order always the later."""
    spark.createDataFrame([(key, list(order), buckets, schema.json())], LAYOUT).coalesce(1).write.json(f"{path}/layout")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> KeyedTable:
    import json

    row = spark.read.schema(LAYOUT).json(f"{path}/layout").first()
    if row is None:
        raise ValueError("there is no table")
    return KeyedTable(path, row["key"], tuple(row["order"]), row["buckets"], StructType.fromJson(json.loads(row["schema"])))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The greatest row of each key by ``order`` and then by all that it says, so that the result doesn't depend on where rows were."""
    columns = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(columns, F.struct(*order, F.xxhash64(*rows.columns).alias("hash_"))).alias("row_")).select("row_.*")


def merge(spark: SparkSession, table: KeyedTable, rows: DataFrame, version: int, gone: DataFrame | None = None) -> dict[str, int]:
    """Puts ``rows`` into the table and takes the keys of ``gone`` out of it, as merge ``version``: {buckets, rows} written. A merge that was logged isn't made again.

    Rows of a key are reduced to one before they meet stored ones, so a key that comes often costs no more than another. Only buckets that a key of the merge falls into are read and written. Rows without a key are an
    error. A key that is in both comes out.
    """
    logged = table.log(spark).agg(F.max("version"), F.count_if(F.col("version") == version)).first()
    if logged[1]:
        return {"buckets": 0, "rows": 0}
    if logged[0] is not None and logged[0] > version:
        raise ValueError(f"merge {logged[0]} was made before {version}")
    names = table.schema.names
    key = F.col(table.key)
    bucket = F.pmod(F.xxhash64(table.key), F.lit(table.buckets)).cast("int")
    new = latest(rows.select(*names), table.key, list(table.order))
    new = cut(new.withColumn(table.key, F.when(key.isNotNull(), key).otherwise(F.raise_error(F.lit("a row has no key")))))
    left = None if gone is None else gone.select(table.key).distinct()
    keys = new.select(table.key) if left is None else new.select(table.key).unionByName(left)
    touched = {r[0] for r in keys.select(bucket.alias("b")).distinct().collect()}
    # Without an order the later merged wins: a stored row is less than any that comes in.
    both = table.read(spark, buckets=touched).withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    kept = latest(both, table.key, [*table.order, "new_"] if table.order else ["new_"]).drop("new_")
    if left is not None:
        kept = kept.join(left, table.key, "left_anti")
    folder = f"{table.path}/data/version={version}"
    kept.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    # A bucket that a merge empties has no files; it counts as written, with none.
    count = {r["bucket"]: r["n"] for r in spark.read.schema(StructType([*table.schema, StructField("bucket", IntegerType())])).parquet(folder).groupBy("bucket").agg(F.count("*").alias("n")).collect()} if touched else {}
    for b in touched - count.keys():
        spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(f"{folder}/bucket={b}")
    entries = [(version, b, count.get(b, 0)) for b in sorted(touched)] or [(version, None, 0)]
    spark.createDataFrame(entries, LOG).coalesce(1).write.mode("overwrite").json(f"{table.path}/log/{version}")
    return {"buckets": len(touched), "rows": sum(count.values())}
