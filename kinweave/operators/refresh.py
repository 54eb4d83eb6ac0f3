"""A corpus brought in step with its source: one row of each id, changed rows merged, membership recorded, and a certificate at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import corpus, rawrows
from kinweave.operators.common import cut
from kinweave.sources import tables

CERTIFICATE = "version long, appended long, replaced long, refreshed long, unchanged long, absent long, members long, examined long"


def refresh(spark: SparkSession, store: tables.KeyedTable, source: DataFrame, version: int, n: int | None = None, text: str = "text", retire: bool = False) -> DataFrame:
    """Brings ``store`` in step with ``source`` (the store's columns, ordinal, priority, and chronology if ``n`` is given) as merge ``version`` and certifies it: one row of counts.

    Of an id the row of the greatest priority counts; all rows or the ``n`` newest are chosen. Chosen rows that aren't stored are appended, those of another text replaced, those that differ otherwise refreshed; the rest isn't written.
    Stored rows that aren't chosen leave the membership; only with ``retire`` do they leave the store. Membership is (id, ordinal), a folder of each version. The certificate is written last and
    only if each member is stored once, so a refresh that broke is seen by its absence, and can be made again under its version. A larger ``n`` later only adds what is missing.
    """
    done = certified(spark, store).where(F.col("version") == version)
    if done.limit(1).count():
        return done
    chosen = cut(rawrows.selected(source, n))
    names = store.schema.names
    stored = store.read(spark, version - 1)
    actions = corpus.upsert_plan(stored, chosen, store.key, text)
    payload = lambda d: d.select(F.col(store.key), F.xxhash64(*[c for c in names if c not in (store.key, text)]).alias("h"))
    differs = payload(stored).withColumnRenamed("h", "old").join(payload(chosen).withColumnRenamed("h", "new"), store.key).where("old <> new").select(store.key, F.lit(True).alias("differs"))
    told = cut(actions.join(differs, store.key, "left").withColumn("action", F.when((F.col("action") == "refresh") & F.col("differs").isNull(), "unchanged").otherwise(F.col("action"))).drop("differs"))
    changed = chosen.join(told.where("action IN ('append', 'replace', 'refresh')").select(store.key), store.key, "left_semi").select(*names)
    absent = told.where("action = 'absent'").select(store.key)
    tables.merge(spark, store, changed, version, absent if retire else None)
    members = chosen.select("id", "ordinal")
    members.write.mode("overwrite").parquet(f"{store.path}/members/version={version}")
    held = spark.read.parquet(f"{store.path}/members/version={version}")
    examined = source.count()
    check = rawrows.certificate(held, store.read(spark, version).select("id"), examined).first()
    if not check["complete"]:
        raise ValueError(f"the refreshed corpus isn't whole: {check.asDict()}")
    n_of = {r["action"]: r["count"] for r in told.groupBy("action").count().collect()}
    row = (version, *[n_of.get(a, 0) for a in ("append", "replace", "refresh", "unchanged", "absent")], check["members"], examined)
    spark.createDataFrame([row], CERTIFICATE).coalesce(1).write.mode("overwrite").json(f"{store.path}/certificates/{version}")
    return certified(spark, store).where(F.col("version") == version)


def certified(spark: SparkSession, store: tables.KeyedTable) -> DataFrame:
    """The certificates of all refreshes that came to their end."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CERTIFICATE).json(f"{store.path}/certificates/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], CERTIFICATE)
        raise


def active(spark: SparkSession, store: tables.KeyedTable) -> DataFrame:
    """The stored rows of the members of the last certified refresh; ValueError before the first."""
    last = certified(spark, store).agg(F.max("version")).first()[0]
    if last is None:
        raise ValueError("the corpus was never certified")
    return store.read(spark, last).join(spark.read.parquet(f"{store.path}/members/version={last}").select("id"), "id", "left_semi")
