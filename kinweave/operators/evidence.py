"""What speaks for each record of a graph, as one nested document: where it came from, how it relates to the focal record, its ranks and features, its passages and its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fields


def capped_list(x: Column, most: int) -> Column:
    return F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, most)


def documents(nodes: DataFrame, relevance: DataFrame, passages: DataFrame, focal: Column, strategy: str, most_passages: int = 20) -> DataFrame:
    """One row for each of ``nodes``, with nested columns provenance, relation, relevance, reference_evidence, discovery and links.

    nodes: id, source (semantic, citation, both or null), relation (or null), rank, score, cos_dd, cos_q, ctx, list_ranks, arxiv, doi, local; relevance: id, relevance; passages: id, contexts, influential. Nodes are bounded by the graph, and so are what joins them;
    of a record's passages the first ``most_passages`` are kept, and ``n_passages`` tells how many there are.

    The focal record is its own provenance and relation and has no evidence. A record without a source has the strategy's. One that is semantic only and has no relation is told so. Evidence that nothing is known of is null, as are discovery and rank of
    records that weren't ranked.
    """
    is_focal = F.col("id") == focal
    base = F.coalesce("source", fields.default_provenance(F.lit(strategy)))
    relation = F.when(is_focal, "focal").otherwise(F.coalesce(F.nullif("relation", F.lit("")), F.when(base == "semantic", "semantic_only"), F.lit("")))
    told = nodes.join(relevance.select("id", "relevance"), "id", "left").join(passages.select("id", "contexts", "influential"), "id", "left")
    cited = F.when(~is_focal & (F.col("contexts").isNotNull() | F.col("influential").isNotNull()), F.struct(capped_list(F.col("contexts"), most_passages).alias("contexts"), F.coalesce(F.size("contexts"), F.lit(0)).alias("n_passages"), "influential"))
    features = F.struct("cos_dd", "cos_q", "ctx")
    found = F.when(~is_focal & F.col("rank").isNotNull(), F.struct("rank", "score", features.alias("features"), "list_ranks"))
    return told.select(
        "id", is_focal.alias("is_focal"), F.when(is_focal, "focal").otherwise(base).alias("provenance"), base.alias("provenance_base"), relation.alias("relation"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        cited.alias("reference_evidence"), found.alias("discovery"), fields.links(F.col("id").cast("string"), F.col("arxiv"), F.col("doi"), F.col("local")).alias("links"),
    )


def written(rows: DataFrame, path: str) -> None:
    """The documents as lines of JSON, nulls and all, in order of their ids."""
    rows.orderBy("id").write.option("ignoreNullFields", "false").json(path)


def read_back(rows: DataFrame, path: str) -> DataFrame:
    """Documents that were written from rows of this form; a line that isn't one raises."""
    return rows.sparkSession.read.schema(rows.schema).option("mode", "FAILFAST").json(path)
