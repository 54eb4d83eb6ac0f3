"""Corpus maintenance: one row per id, newest rows, membership, and incremental changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_usable(rows: DataFrame, usable: Column, key: str = "id", position: str = "pos", limit: int | None = None) -> DataFrame:
    """The first usable row of each key in order of position, and of those the first ``limit``."""
    order = W.partitionBy(key).orderBy(position)
    one = rows.where(usable).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return one if limit is None else one.orderBy(position).limit(limit)


def latest_version(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row of each key: the latest update, then version, created, content; the first of equals. rows: id, updated, version, created, content, ordinal."""
    best = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in ("updated", "created", "content") else F.coalesce(F.col(c), F.lit(0)) for c in ("updated", "version", "created", "content")], -F.col("ordinal")))
    return rows.groupBy(key).agg(best.alias("row")).select("row.*")


def duplicate_counts(rows: DataFrame, key: str = "id") -> DataFrame:
    """examined, distinct_ids, duplicates, and ids whose duplicates differ in content."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("content").alias("contents"))
    return per.agg(F.sum("n").alias("examined"), F.count("*").alias("distinct_ids"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum(F.when(F.col("contents") > 1, 1).otherwise(0)).alias("ambiguous"))


def newest(rows: DataFrame, n: int, chronology: str = "chronology", ordinal: str = "ordinal") -> DataFrame:
    """The n newest: dated rows by chronology and then later ordinals first; undated rows follow, earlier ordinals first."""
    dated = F.col(chronology).isNotNull()
    return rows.orderBy((~dated).cast("int"), F.desc(chronology), F.when(dated, -F.col(ordinal)).otherwise(F.col(ordinal))).limit(n)


def active(rows: DataFrame, members: DataFrame, n: int | None = None, key: str = "id") -> DataFrame:
    """Rows whose key is a member: all, or the n newest of them."""
    inside = rows.join(members.select(key), key, "left_semi")
    return inside if n is None else newest(inside, n)


def dangling(members: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Members without a row. It should be empty."""
    return members.join(rows.select(key), key, "left_anti")


def integrity(rows: DataFrame, place: str = "row_idx") -> DataFrame:
    """count, distinct places, smallest and largest place, and whether they run without gaps from 0."""
    found = rows.agg(F.count("*").alias("n"), F.count_distinct(place).alias("places"), F.min(place).alias("first"), F.max(place).alias("last"))
    return found.withColumn("contiguous", F.coalesce((F.col("n") == F.col("places")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1), F.col("n") == 0))


def upsert_plan(stored: DataFrame, incoming: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, action): append, replace where the text's digest differs, refresh where only other data may, and absent where nothing came in."""
    old = stored.select(F.col(key), F.sha2(F.encode(text, "UTF-8"), 256).alias("old"))
    new = incoming.select(F.col(key), F.sha2(F.encode(text, "UTF-8"), 256).alias("new"))
    action = F.when(F.col("old").isNull(), "append").when(F.col("new").isNull(), "absent").when(F.col("old") == F.col("new"), "refresh").otherwise("replace")
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows take the place of stored rows of the same key; others stay."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def late_rows(incoming: DataFrame, stored: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Of the n newest incoming rows those that aren't stored yet."""
    return newest(incoming, n).join(stored.select(key), key, "left_anti")


def is_current(incoming: DataFrame, stored: DataFrame, chronology: str = "chronology") -> DataFrame:
    """Whether nothing that came in is newer than what is stored."""
    a = incoming.agg(F.max(chronology).alias("newest_incoming"))
    b = stored.agg(F.max(chronology).alias("newest_stored"))
    return a.crossJoin(b).withColumn("is_current", F.coalesce(F.col("newest_stored") >= F.col("newest_incoming"), F.col("newest_incoming").isNull()))


def corrected(rows: DataFrame, corrections: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Values of ``corrections`` where they aren't null; vectors and other columns stay."""
    new = corrections.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])
