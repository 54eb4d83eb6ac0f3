"""Identity of records: aliases, unique matches, folded versions and merged metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.operators.common import numbered


def alias_owners(aliases: DataFrame) -> DataFrame:
    """(alias, id) of aliases that exactly one record has. aliases: id, alias."""
    return aliases.where(F.col("alias").isNotNull()).groupBy("alias").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").select("alias", "id")


def resolved(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted: name. Adds the id that it means: as it stands if one record has it, else in lower case; null if none or several have it."""
    exact = alias_owners(aliases).select(F.col("alias").alias("name"), F.col("id").alias("exact"))
    folded = alias_owners(aliases.select("id", F.lower("alias").alias("alias")).distinct()).select(F.col("alias").alias("folded_name"), F.col("id").alias("folded"))
    both = wanted.join(exact, "name", "left").join(folded, F.lower("name") == F.col("folded_name"), "left")
    return both.select(*wanted.columns, F.coalesce("exact", "folded").alias("id"))


def focal_record(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """The stored row that a name means, by id first and then by an alias that one record has; it is looked up in all rows, whatever view of the corpus is active. rows: id and others; aliases: id, alias."""
    wanted = rows.sparkSession.createDataFrame([(name,)], "name string")
    own = wanted.join(rows.select(F.col("id").alias("own")), F.col("name") == F.col("own"), "left")
    found = resolved(own, aliases).select(F.coalesce("own", "id").alias("id")).where("id IS NOT NULL").distinct()
    return rows.join(F.broadcast(found), "id", "left_semi")


def unique_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(left_id, right_id) of records that agree on the keys and have no other partner on either side.

    Both sides are counted by key before the join, so a key that many records share makes no pairs.
    """
    a = left.groupBy(*keys).agg(F.min("id").alias("left_id"), F.max("id").alias("left_other")).where("left_id = left_other")
    b = right.groupBy(*keys).agg(F.min("id").alias("right_id"), F.max("id").alias("right_other")).where("right_id = right_other")
    return a.join(b, keys).select("left_id", "right_id")


def bibliography_matches(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries (entry, title, author, year) matched with records (id, title, author, year, preprint) by key; a preprint may also be a year older. Matches must be the only ones."""
    years = F.explode(F.when(F.col("preprint"), F.array("year", F.col("year") + 1)).otherwise(F.array("year")))
    offered = records.select("id", "title", "author", years.alias("year")).groupBy("title", "author", "year").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    return entries.join(offered, ["title", "author", "year"]).select("entry", "id")


def folded_versions(records: DataFrame) -> DataFrame:
    """(preprint_id, publication_id): the only preprint and the only publication of a title and first author, the latter of the same or the next year, without conflicting DOIs.

    records: id, title, author, year, doi, preprint.
    """
    pre = records.where("preprint").select("id", "title", "author", "doi", F.explode(F.array("year", F.col("year") + 1)).alias("year"))
    pub = records.where("NOT preprint").select("id", "title", "author", "doi", "year")
    keys = ["title", "author", "year"]
    a = pre.groupBy(*keys).agg(F.min("id").alias("preprint_id"), F.max("id").alias("p2"), F.min("doi").alias("doi_a")).where("preprint_id = p2")
    b = pub.groupBy(*keys).agg(F.min("id").alias("publication_id"), F.max("id").alias("q2"), F.min("doi").alias("doi_b")).where("publication_id = q2")
    found = a.join(b, keys).where(~F.coalesce(F.col("doi_a") != F.col("doi_b"), F.lit(False))).select("preprint_id", "publication_id").distinct()
    per_pre = found.groupBy("preprint_id").agg(F.min("publication_id").alias("publication_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    per_pub = found.groupBy("publication_id").agg(F.count("*").alias("n")).where("n = 1").select("publication_id")
    return per_pre.join(per_pub, "publication_id", "left_semi").select("preprint_id", "publication_id")


def merged(rows: DataFrame, key: str = "member", order: str = "pos") -> DataFrame:
    """One row of each member: the first title, abstract and venue that aren't blank, the most citations, sources and references without repeats in order.

    rows: member, pos, title, abstract, venue, citations, references (array), source.
    """
    filled = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col(order)))
    lists = F.array_sort(F.collect_list(F.when(F.size("references") > 0, F.struct(F.col(order).alias("pos"), F.col("references").alias("r")))))
    return rows.groupBy(key).agg(
        filled("title").alias("title"), filled("abstract").alias("abstract"), filled("venue").alias("venue"), F.max("citations").alias("citations"),
        F.array_distinct(F.flatten(F.transform(lists, lambda x: x["r"]))).alias("references"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(order).alias("best_rank"),
    )


def relation(is_focal: Column, cites: Column, cited: Column) -> Column:
    """focal, both, reference, citation or semantic_only, from what any of a record's rows says."""
    return F.when(is_focal, "focal").when(cites & cited, "both").when(cited, "reference").when(cites, "citation").otherwise("semantic_only")


def conflicting(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Keys whose rows differ in content; duplicates that don't may be dropped."""
    return rows.groupBy(key).agg(F.count_distinct(content).alias("contents")).where("contents > 1").select(key)


def evidence(rows: DataFrame, key: str = "id") -> DataFrame:
    """contexts: the distinct passages of a record, white space made one; influential: true if any row says so, null if none says anything. rows: id, pos, context, influential."""
    passage = F.nullif(F.trim(F.regexp_replace("context", r"\s+", " ")), F.lit(""))
    kept = F.array_sort(F.collect_list(F.when(passage.isNotNull(), F.struct(F.col("pos"), passage.alias("c")))))
    return rows.groupBy(key).agg(F.array_distinct(F.transform(kept, lambda x: x["c"])).alias("contexts"), F.bool_or("influential").alias("influential"))


def ranked_once(rows: DataFrame, usable: Column, key: str = "id", limit: int | None = None) -> DataFrame:
    """Provider order without repeats: the first usable row of each key, numbered anew, and of those the first ``limit``."""
    one = rows.where(usable).groupBy(key).agg(F.min("pos").alias("pos"))
    return numbered(one if limit is None else one.orderBy("pos", key).limit(limit), [F.col("pos"), F.col(key)], "rank", limit)
