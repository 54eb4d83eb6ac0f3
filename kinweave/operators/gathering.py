"""Papers of a citation or recommendation graph, in slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.common import cut, numbered
from kinweave.operators.corpus import first_usable
from kinweave.operators.identity import ranked_once, relation


def citation_slots(references: DataFrame, citers: DataFrame, focal: Column, most: int, most_references: int, most_citers: int) -> DataFrame:
    """(id, relation, slot) of at most ``most`` papers: the focal one in slot 0, then references and then citers in their order. Both tables: id, pos.

    References come first, up to their limit and the free slots; citers are then asked for as many as are still free, up to theirs.
    A record counts once a source, by its first place. A citer that is a reference too keeps that slot, as "both". The focal
    record takes no slot besides its own.
    """
    told = F.col("id").isNotNull()
    cited = cut(first_usable(references, told, limit=min(most - 1, most_references)).where(F.col("id") != focal).select("id", F.col("pos").alias("cited_pos")))
    free = most - 1 - cited.count()
    citing = first_usable(citers, told, limit=min(free, most_citers)).where(F.col("id") != focal).select("id", F.col("pos").alias("cites_pos"))
    pool = cut(cited.join(citing, "id", "full"))
    placed = numbered(pool, [F.col("cited_pos").isNull(), F.coalesce("cited_pos", "cites_pos"), F.col("id")], "slot")
    found = placed.select("id", relation(F.lit(False), F.col("cites_pos").isNotNull(), F.col("cited_pos").isNotNull()).alias("relation"), "slot")
    start = pool.sparkSession.range(1).select(focal.cast(found.schema["id"].dataType).alias("id"), F.lit("focal").alias("relation"), F.lit(0).alias("slot"))
    return start.unionByName(found)


def recommendation_slots(rows: DataFrame, focal: Column, most: int) -> DataFrame:
    """(id, slot) of at most ``most`` papers: the focal one in slot 0, then those in the provider's order that have a title and an abstract. rows: id, title, abstract, pos."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    usable = F.col("id").isNotNull() & (F.col("id") != focal) & filled(F.col("title")) & filled(F.col("abstract"))
    found = ranked_once(rows, usable, limit=most - 1).select("id", F.col("rank").alias("slot"))
    start = rows.sparkSession.range(1).select(focal.cast(found.schema["id"].dataType).alias("id"), F.lit(0).alias("slot"))
    return start.unionByName(found)
