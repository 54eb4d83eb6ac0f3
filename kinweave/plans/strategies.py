"""Graphs of each strategy over its own papers: what cites and is cited, what a provider recommends, and what is nearest in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import scores
from kinweave.operators import evidence, graph, identity, knn
from kinweave.operators.common import cut
from kinweave.operators.identity import relation
from kinweave.plans.discovery import COS, GATE, MAX_PAPERS, PAGERANK_CTE, P, edges_of, kept, ranked, scored_pairs, walk
from kinweave.plans.discovery import FOCAL as STORE_FOCAL
from kinweave.plans.gathering import CITATION_SLOTS, FOCAL, RECOMMENDATION_SLOTS, citation_slots, recommendation_slots
from kinweave.plans.tables import focal_vector, papers, read

CAP = 3


def with_papers(slots: DataFrame, spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Records of the papers in slots; every fourth gives no references, and authors are shared by some."""
    store = papers(spark, sf_dir).withColumn("refs", F.when(F.col("id") % 4 != 1, F.col("refs")).otherwise(F.array().cast("array<bigint>"))).withColumn("authors", F.array(F.col("id") % 7, 100 + F.col("id") % 5))
    return cut(store.join(slots.select("id"), "id").withColumn("source", F.lit(source)).coalesce(1))


def pairs_sql(slots: str) -> str:
    """Tables that end in x, the scored pairs of the papers of a query's ids."""
    return f"""{P}, k AS (SELECT id, vector, year, citations, CASE WHEN id % 4 <> 1 THEN refs ELSE [] END AS refs, categories, [id % 7, 100 + id % 5] AS authors FROM p WHERE id IN (SELECT id FROM ({slots}))),
q AS (SELECT a.id AS a, b.id AS b, {COS} AS cosine,
  CASE WHEN a.year IS NULL OR b.year IS NULL THEN 0.5 WHEN abs(a.year - b.year) > 5 THEN 0.1 ELSE 1.0 - abs(a.year - b.year) / 5.0::DOUBLE * 0.8 END AS temporal,
  CASE WHEN a.citations > 0 AND b.citations > 0 THEN 1.0 - abs(log10(a.citations + 1) - log10(b.citations + 1)) / greatest(log10(a.citations + 1), log10(b.citations + 1)) ELSE 0.3 END AS citation,
  len(a.refs) > 0 AND len(b.refs) > 0 AS both_, CASE WHEN both_ THEN len(list_intersect(list_distinct(a.refs), list_distinct(b.refs))) / sqrt(len(list_distinct(a.refs)) * len(list_distinct(b.refs))) ELSE 0 END AS coupling,
  len(list_intersect(list_distinct(a.categories), list_distinct(b.categories)))::DOUBLE / len(list_distinct(list_concat(a.categories, b.categories))) AS category, list_has_any(a.authors, b.authors) AS shared
  FROM k a JOIN k b ON a.id < b.id)"""


def edges(nodes: DataFrame, score: str, rule, focal: int | None, cap: int = CAP) -> DataFrame:
    pairs = scored_pairs(nodes).where(rule(F.col(score))).select("a", "b", F.col(score).alias("weight"))
    found = graph.capped(graph.canonical(pairs), cap, None if focal is None else F.lit(focal))
    return found.select("left", "right", F.round("weight", 9).alias("weight"))


def capped_sql(slots: str, score: str, rule: str, focal: int | None, cap: int = CAP) -> str:
    """The greedy walk of ``walk`` names the store's first record; here the focal one is another."""
    walked = walk("e", cap, focal is not None)
    if focal is not None:
        walked = walked.replace(f'"left" = {STORE_FOCAL}', f'"left" = {focal}').replace(f'"right" = {STORE_FOCAL}', f'"right" = {focal}')
    return f'''WITH RECURSIVE {pairs_sql(slots)}, e AS (SELECT a AS "left", b AS "right", CAST({score} AS DOUBLE) AS weight FROM q WHERE {rule.format(score=score)}), {walked} SELECT "left", "right", round(weight, 9) AS weight FROM kept'''


SPEAKS = "CASE WHEN cosine <= 0 AND coupling <= 0 THEN 0 WHEN both_ THEN {0} ELSE {1} END"


def citation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(with_papers(citation_slots(spark, sf_dir), spark, sf_dir, "citation"), "citing", lambda s: scores.default_edge(s, 0.2), FOCAL)


CITATION_GRAPH = capped_sql(CITATION_SLOTS, SPEAKS.format("0.40 * greatest(cosine, 0) + 0.20 * temporal + 0.40 * coupling", "0.65 * greatest(cosine, 0) + 0.20 * temporal + 0.15 * citation"), "{score} >= 0.2", FOCAL)


def recommendation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(with_papers(recommendation_slots(spark, sf_dir), spark, sf_dir, "recommendation"), "recommended", lambda s: scores.default_edge(s, 0.2), FOCAL)


RECOMMENDATION_GRAPH = capped_sql(RECOMMENDATION_SLOTS, f'least(1, {SPEAKS.format("0.60 * greatest(cosine, 0) + 0.15 * temporal + 0.25 * coupling", "0.75 * greatest(cosine, 0) + 0.25 * temporal")})', "{score} >= 0.2", FOCAL)


def nearest_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focal record and the nearest of the corpus."""
    store = papers(spark, sf_dir)
    near = knn.exact(store.where(F.col("id") != FOCAL), focal_vector(store, FOCAL), MAX_PAPERS - 1).select("id")
    return near.unionByName(store.where(F.col("id") == FOCAL).select("id"))


def embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared author raises a score by half, up to 1."""
    return edges(with_papers(nearest_papers(spark, sf_dir), spark, sf_dir, "semantic"), "embedding", scores.embedding_edge, None, 4)


NEAREST = f"SELECT {FOCAL} AS id UNION ALL SELECT id FROM (SELECT b.id FROM p a, p b WHERE a.id = {FOCAL} AND b.id <> {FOCAL} ORDER BY {COS} DESC, b.id LIMIT {MAX_PAPERS - 1})"
EMBEDDING_GRAPH = capped_sql(NEAREST, f"CASE WHEN cosine < {GATE} THEN 0 ELSE least(1, (0.5 * cosine + 0.2 * temporal + 0.2 * category) * CASE WHEN shared THEN 1.5 ELSE 1 END) END", "{score} > 0.1", None, 4)

def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's records with all that speaks for them: users' events stand for citing passages."""
    nodes = kept(spark, sf_dir)
    linked = edges_of(nodes)
    list_ranks = cut(ranked(spark, sf_dir).where(F.col("rank") < MAX_PAPERS).select("id", "cos_dd", "cos_q", "ctx", "list_ranks", relation(F.lit(False), F.col("cites_focal"), F.col("is_reference")).alias("relation")))
    rows = nodes.select("id", F.when(F.col("id") % 5 != 3, F.col("source")).alias("source"), F.when(F.col("rank") > 0, F.col("rank")).alias("rank"), "score").join(list_ranks, "id", "left")
    rows = rows.withColumn("relation", F.when(F.col("relation") != "semantic_only", F.col("relation"))).withColumns({
        "arxiv": F.when(F.col("id") % 3 == 0, F.concat(F.lit("2101."), F.lpad(F.col("id").cast("string"), 5, "0"))), "doi": F.lit(None).cast("string"), "local": F.col("id") % 2 == 0,
    })
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.concat_ws(" ", "event_type", (F.col("event_id") % 5).cast("string")).alias("context"), F.when(F.col("event_type") == "purchase", F.col("value") > 50).alias("influential"))
    passages = identity.evidence(events.join(F.broadcast(nodes.select("id")), "id", "left_semi"))
    rank = graph.pagerank(nodes.select("id"), linked, F.lit(STORE_FOCAL)).select("id", F.col("rank").alias("relevance"))
    told = evidence.documents(rows, rank, passages, F.lit(STORE_FOCAL), "hybrid", 3)
    e, d = F.col("reference_evidence"), F.col("discovery")
    lists = F.array_join(F.transform(F.array_sort(F.map_entries(d["list_ranks"])), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return told.select(
        "id", "provenance", "provenance_base", "relation", F.round("relevance", 9).alias("relevance"), F.array_join(e["contexts"], "|").alias("contexts"), e["n_passages"].cast("long").alias("n_passages"), e["influential"].alias("influential"),
        d["rank"].alias("discovery_rank"), F.round(d["score"], 12).alias("discovery_score"), F.round(d["features"]["cos_dd"], 9).alias("cos_dd"), F.round(d["features"]["ctx"], 9).alias("ctx"), lists.alias("list_ranks"),
        F.col("links.arxiv_abs").alias("arxiv_abs"), F.col("links.provider").alias("provider"),
    )


EVIDENCE_DOCUMENTS = f"""WITH RECURSIVE {PAGERANK_CTE},
ev AS (SELECT user_id AS id, event_id, event_type || ' ' || event_id % 5 AS c, CASE WHEN event_type = 'purchase' THEN value > 50 END AS i FROM events),
pc AS (SELECT id, c, min(event_id) AS pos FROM ev GROUP BY id, c),
pl AS (SELECT id, string_agg(c, '|' ORDER BY pos) FILTER (WHERE n <= 3) AS contexts, count(*) AS n_passages FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM pc) GROUP BY id),
pi AS (SELECT id, bool_or(i) AS influential FROM ev GROUP BY id),
t AS (SELECT k.id, CASE WHEN k.id % 5 <> 3 THEN k.source ELSE 'citation' END AS base, CASE WHEN r.cites_focal AND r.is_reference THEN 'both' WHEN r.is_reference THEN 'reference' WHEN r.cites_focal THEN 'citation' END AS rel FROM k LEFT JOIN ranked r USING (id))
SELECT t.id, CASE WHEN t.id = {STORE_FOCAL} THEN 'focal' ELSE base END AS provenance, base AS provenance_base, CASE WHEN t.id = {STORE_FOCAL} THEN 'focal' ELSE coalesce(rel, CASE WHEN base = 'semantic' THEN 'semantic_only' ELSE '' END) END AS relation, round(pr.r, 9) AS relevance,
  CASE WHEN t.id <> {STORE_FOCAL} THEN pl.contexts END AS contexts, CASE WHEN t.id <> {STORE_FOCAL} THEN n_passages END AS n_passages, CASE WHEN t.id <> {STORE_FOCAL} THEN pi.influential END AS influential,
  CAST(r.rank AS INT) AS discovery_rank, round(r.score, 12) AS discovery_score, round(r.cos_dd, 9) AS cos_dd, round(r.ctx, 9) AS ctx,
  (SELECT string_agg(n || '=' || v, ',' ORDER BY n) FROM (VALUES ('semantic', r.rank_semantic), ('reference_context', r.rank_reference_context), ('direct', r.rank_direct), ('recommended', r.rank_recommended), ('focal_reference', r.rank_focal_reference)) x(n, v) WHERE v IS NOT NULL) AS list_ranks,
  CASE WHEN t.id % 3 = 0 THEN 'https://arxiv.org/abs/2101.' || lpad(CAST(t.id AS VARCHAR), 5, '0') END AS arxiv_abs, CASE WHEN t.id % 2 = 1 THEN 'https://www.semanticscholar.org/paper/' || t.id END AS provider
FROM t JOIN pr ON pr.id = t.id AND pr.t = 200 LEFT JOIN ranked r ON r.id = t.id AND r.rank < {MAX_PAPERS} AND t.id <> {STORE_FOCAL} LEFT JOIN pl ON pl.id = t.id LEFT JOIN pi ON pi.id = t.id"""

QUERIES = {f.__name__: f for f in (citation_graph, recommendation_graph, embedding_graph, evidence_documents)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
