"""What a reader sees of a ranked graph: filtered and sorted lists, tiers, leads and exported nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.common import numbered

TIERS = ((3, "top"), (8, "high"), (15, "middle"))
#: Weights no further apart are equal.
TIED = 1e-9


def scope(which: str, year: Column, focal_year: Column, relation: Column, is_focal: Column) -> Column:
    """prior: references, and else records no newer than the focal one; derivative: citations, and else no older. The focal record and unknown years stay."""
    if which == "all":
        return F.lit(True)
    known = F.when(relation == ("reference" if which == "prior" else "citation"), True).when(relation == ("citation" if which == "prior" else "reference"), False)
    by_year = (year <= focal_year) if which == "prior" else (year >= focal_year)
    return is_focal | F.coalesce(known, F.when((year == 0) | year.isNull(), True).otherwise(by_year), F.lit(True))


def visible(nodes: DataFrame, first_year: int | None = None, last_year: int | None = None, sources: list[str] | None = None, text: str | None = None) -> DataFrame:
    keep: Column = F.lit(True)
    if first_year is not None:
        keep = keep & ((F.col("year") >= first_year) | F.col("is_focal"))
    if last_year is not None:
        keep = keep & ((F.col("year") <= last_year) | F.col("is_focal"))
    if sources is not None:
        keep = keep & F.col("source").isin(sources)
    if text:
        keep = keep & F.contains(F.lower(F.concat_ws(" ", "title", F.array_join("authors", " "))), F.lit(text.lower()))
    return nodes.where(keep)


def listed(nodes: DataFrame, key: str = "citations") -> DataFrame:
    """The focal record first, then by the key, citations, newer years and id; pos numbers the rows of the list."""
    order = [F.desc("is_focal"), F.desc(key), F.desc("citations"), F.desc_nulls_last("year"), F.asc("id")]
    return numbered(nodes, order, "pos")


def tier(nodes: DataFrame) -> DataFrame:
    """The tier of a node's size by its place in citations."""
    out: Column = F.lit("low")
    for most, name in reversed(TIERS):
        out = F.when(F.col("place") <= most, name).otherwise(out)
    return numbered(nodes, [F.desc("citations"), F.asc("id")], "place").withColumn("tier", out)


def leads(ranked: DataFrame, kept: DataFrame, most: int = 10) -> DataFrame:
    """References of two passages or more in fused order, and records of the corpus alone by query cosine, that the graph left out."""
    out = ranked.join(kept.select("id"), "id", "left_anti")
    cited = out.where("is_reference AND contexts >= 2").orderBy("rank").limit(most).select("id", F.lit("reference").alias("lead"))
    corpus = out.where("NOT is_reference AND NOT cites_focal AND recommendation_rank IS NULL").orderBy(F.desc("cos_q"), "id").limit(most).select("id", F.lit("corpus").alias("lead"))
    return cited.unionByName(corpus)


def year_scale(nodes: DataFrame) -> DataFrame:
    """Place of a year between the earliest and the latest, 0.5 if there is none or but one."""
    bounds = nodes.where("year > 0").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    known = (F.col("year") > 0) & (F.col("hi") > F.col("lo"))
    return nodes.crossJoin(F.broadcast(bounds)).withColumn("shade", F.when(known, (F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)).drop("lo", "hi")


def relative_strength(edges: DataFrame, *graph: str) -> DataFrame:
    """``strength``: where a weight lies between the least and the greatest of its graph, which the columns ``graph`` name; 0.5 if those are as good as equal."""
    bounds = edges.groupBy(*graph).agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    both = edges.join(bounds, list(graph)) if graph else edges.crossJoin(F.broadcast(bounds))
    span = F.col("hi") - F.col("lo")
    return both.withColumn("strength", F.when(span > TIED, (F.col("weight") - F.col("lo")) / span).otherwise(0.5)).drop("lo", "hi")
