"""Candidate pools: sources in a fixed order, budgets, admission, lookups and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Subjects that count as computing, beside those that begin with "cs.".
COMPUTING = ("computer science", "computing", "cs")
UNAVAILABLE, BIBLIOGRAPHY = "unavailable", "arxiv_references"


class SourcesUnavailable(RuntimeError):
    """Every source that was asked failed."""


#: The most that one source gives, and the share of a pool that recommendations and then references have.
MOST, RECOMMENDED, REFERRED = 100, 4, 3


def budgets(size: Column) -> Column:
    """struct<references, citations, recommendations>: a quarter of a pool for recommendations, a third of the rest, rounded up, for references, what is left for citations."""
    share = F.struct(F.least(F.greatest(F.floor(size / RECOMMENDED), F.lit(1)), F.lit(MOST)).cast("int").alias("recommendations"), size.alias("size"))
    two = F.transform(F.array(share), lambda s: F.struct(F.least(F.ceil(F.greatest(s["size"] - s["recommendations"], F.lit(0)) / REFERRED), F.lit(MOST)).cast("int").alias("references"), s["recommendations"].alias("recommendations"), s["size"].alias("size")))
    return F.get(F.transform(two, lambda s: F.struct(s["references"].alias("references"), F.greatest(s["size"] - s["recommendations"] - s["references"], F.lit(0)).cast("int").alias("citations"), s["recommendations"].alias("recommendations"))), F.lit(0))


def budget(spark: SparkSession, size: int) -> dict[str, int]:
    return spark.range(1).select(budgets(F.lit(size)).alias("b")).first()["b"].asDict()


def united(sources: dict[str, DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """One row of each record: its sources, its place in the first of them, and its best place in any. Each source has id and pos; order and limits are those given."""
    parts = []
    for n, (name, rows) in enumerate(sources.items()):
        one = rows.groupBy("id").agg(F.min("pos").alias("pos"))
        if limits and name in limits:
            one = one.orderBy("pos", "id").limit(limits[name])
        parts.append(one.select("id", "pos", F.lit(n).alias("n"), F.lit(name).alias("source")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("id").agg(F.min(F.struct("n", "pos")).alias("first"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("pos").alias("best"))


def admitted(pool: DataFrame, usable: Column, most: int) -> DataFrame:
    """The first ``most`` usable records in order of their first source and place in it. Records that several sources have take one slot."""
    return pool.where(usable).orderBy("first", "id").limit(most)


def with_fallback(rows: DataFrame, pool: str = "pool", first: str = "recent", second: str = "all-cs") -> DataFrame:
    """Rows of the first pool, or those of the second if it has none."""
    any_first = rows.where(F.col(pool) == first).limit(1).agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(any_first)).where(F.when(F.col("n") > 0, F.col(pool) == first).otherwise(F.col(pool) == second)).drop("n")


def subject_pool(categories: Column) -> Column:
    """all-cs for computing subjects and for none that is known, else recent."""
    known = F.filter(F.transform(categories, lambda c: F.lower(F.trim(c))), lambda c: (c != "") & (c != "unknown"))
    computing = F.exists(known, lambda c: c.isin(*COMPUTING) | c.startswith("cs."))
    return F.when((F.size(known) > 0) & ~computing, "recent").otherwise("all-cs")


def searched(rows: DataFrame, words: list[str], limit: int = 1000, text: str = "text") -> DataFrame:
    """The first row of each record whose text holds all words, in provider order."""
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(F.lower(text), F.lit(w.lower()))
    one = rows.where(hit).groupBy("id").agg(F.min("pos").alias("pos"))
    return one.orderBy("pos", "id").limit(limit)


def looked_up(wanted: DataFrame, cached: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Cached rows of the wanted keys, and fresh rows of those that aren't cached. Both tables may be large: Catalyst broadcasts ``wanted`` if it is small."""
    hits = cached.join(wanted.select(key).distinct(), key, "left_semi")
    missing = wanted.select(key).distinct().join(cached.select(key), key, "left_anti")
    return hits.unionByName(fresh.join(missing, key, "left_semi"), allowMissingColumns=True)


def reference_lists(links: DataFrame) -> DataFrame:
    """(id, refs): each record's references in order, without repeats. links: id, pos, ref."""
    return links.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"])).alias("refs"))


def with_references(records: DataFrame, lists: DataFrame) -> DataFrame:
    """Reference lists where a record has none of its own."""
    joined = records.join(lists.select("id", F.col("refs").alias("found")), "id", "left")
    own = F.coalesce(F.size("refs") > 0, F.lit(False))
    return joined.withColumn("refs", F.when(own, F.col("refs")).otherwise(F.coalesce("found", "refs"))).drop("found")


def enriched(corpus: DataFrame, provider: DataFrame, columns: list[str], conflict: Column) -> DataFrame:
    """Corpus rows with the provider's values where they are blank, unless the identifiers conflict. The condition reads provider columns as p_NAME."""
    p = provider.select("id", *[F.col(c).alias(f"p_{c}") for c in provider.columns if c != "id"])
    joined = corpus.join(p, "id", "left")
    take = lambda c: F.when(F.coalesce(conflict, F.lit(False)), F.col(c)).otherwise(F.coalesce(c, f"p_{c}"))
    return joined.select(*[take(c).alias(c) if c in columns else F.col(c) for c in corpus.columns])


def bound_spellings(entries: DataFrame) -> DataFrame:
    """(spelling, entry) of all spellings of entries that some shared spelling identifies: the smallest entry stands for those that share one. entries: entry, spelling."""
    first = entries.groupBy("spelling").agg(F.min("entry").alias("least"))
    heads = entries.join(first, "spelling").groupBy("entry").agg(F.min("least").alias("head"))
    return entries.join(heads, "entry").select("spelling", F.col("head").alias("entry")).distinct()


def without_focal(rows: DataFrame, focal: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share no key with the focal record."""
    for k in keys:
        rows = rows.join(focal.where(F.col(k).isNotNull()).select(k), k, "left_anti")
    return rows


def availability(status: DataFrame) -> DataFrame:
    """One row: asked, usable (how many sources gave an answer that counts) and missing, the names of those that were unavailable. status: source, state, papers.

    A bibliography that led to references stands for the provider's own, which then isn't missing; one that led to none counts for nothing.
    """
    led = status.agg(F.coalesce(F.bool_or((F.col("source") == BIBLIOGRAPHY) & (F.col("papers") > 0)), F.lit(False)).alias("led"))
    rows = status.crossJoin(F.broadcast(led))
    down = F.col("state") == UNAVAILABLE
    counts = ~down & ((F.col("source") != BIBLIOGRAPHY) | F.col("led"))
    missing = down & ~((F.col("source") == "references") & F.col("led"))
    return rows.agg(F.count("*").alias("asked"), F.count(F.when(counts, 1)).alias("usable"), F.array_sort(F.collect_set(F.when(missing, F.col("source")))).alias("missing"))


def require_available(status: DataFrame) -> list[str]:
    """The missing sources; an error if some were asked and none is usable."""
    row = availability(status).first()
    if row["asked"] and not row["usable"]:
        raise SourcesUnavailable(", ".join(row["missing"]))
    return row["missing"]


def recovered(references: DataFrame, limit: int) -> DataFrame:
    """Recovered references by score, citations and place, if there are more than the limit; all of them else."""
    return references.orderBy(F.desc("score"), F.desc("citations"), "pos").limit(limit)


def coverage(stored: Column, wanted: Column) -> Column:
    """How a stored corpus, "all" or "newest:N", stands to a request for so many rows, null for all of them.

    It is exact, or covers what is asked for, or extends to it by fetching more, or was made another way and is incompatible.
    """
    held = F.trim(F.coalesce(stored, F.lit("")))
    size = F.nullif(F.regexp_extract(held, "^newest:([0-9]+)$", 1), F.lit("")).cast("long")
    to_all = F.when(held == "all", "exact").when(size.isNotNull(), "extends")
    to_some = F.when((held == "all") | (size > wanted), "covers").when(size == wanted, "exact").when(size < wanted, "extends")
    return F.coalesce(F.when(wanted.isNull(), to_all).otherwise(to_some), F.lit("incompatible"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = F.when(F.col("year") > 0, F.col("year"))
    n = nodes.agg(F.count("*").alias("nodes"), F.min(known).alias("first_year"), F.max(known).alias("last_year"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")))


def namespaces(files: DataFrame) -> DataFrame:
    """Number of files and bytes of each namespace, and in all. files: namespace, bytes."""
    return files.rollup("namespace").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def placed_once(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("pos"))).where("n = 1").drop("n")
