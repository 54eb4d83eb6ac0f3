"""Queries on vectors, rankings and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import fields as N
from kinweave.functions import scores as S
from kinweave.functions import vectors as V
from kinweave.operators import graph, knn, ranking, textsim, views
from kinweave.operators.common import cut
from kinweave.plans.tables import PAPERS_SQL, focal_vector, papers, read

FOCAL, QUERY, K, MAX_PAPERS, EDGE_CAP, WIDTH = 0, 1, 20, 45, 5, 64
#: No two records of the driver's vectors come near the gate of a trained encoder, so the graph queries pass a lower one.
GATE = 0.1
COS = "list_inner_product(a.vector, b.vector) / (sqrt(list_inner_product(a.vector, a.vector)) * sqrt(list_inner_product(b.vector, b.vector)))"
P = f"p AS ({PAPERS_SQL})"


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = papers(spark, sf_dir)
    return knn.exact(store, focal_vector(store, FOCAL), K).select("id", "label", F.round("score", 9).alias("score"))


KNN_COSINE = f"WITH {P} SELECT b.id, b.label, round({COS}, 9) AS score FROM p a, p b WHERE a.id = {FOCAL} ORDER BY {COS} DESC, b.id LIMIT {K}"


def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum(V.valid(F.col("vector"), WIDTH).cast("int")).cast("long").alias("n_valid"))


VECTOR_VALIDITY = f"WITH {P} SELECT label, count(*) AS n, CAST(sum(CASE WHEN len(vector) = {WIDTH} AND sqrt(list_inner_product(vector, vector)) > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM p GROUP BY label"


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = papers(spark, sf_dir).withColumn("unit", V.normalized(F.col("vector")))
    return unit.select("id", F.round(V.norm(F.col("vector")), 9).alias("norm"), F.round(V.norm(F.col("unit")), 9).alias("unit_norm"), F.round(F.get("unit", F.lit(0)), 9).alias("first"))


VECTOR_NORMS = f"WITH {P} SELECT id, round(sqrt(list_inner_product(vector, vector)), 9) AS norm, 1.0::DOUBLE AS unit_norm, round(vector[1] / sqrt(list_inner_product(vector, vector)), 9) AS first FROM p"


def whole_calibration(store: DataFrame) -> DataFrame:
    return knn.calibration(store, sample=None)


def vector_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_calibration(papers(spark, sf_dir)).select(F.posexplode("ranges").alias("place", "r")).select("place", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


VECTOR_CALIBRATION = f"WITH {P} SELECT CAST(i - 1 AS INT) AS place, min(x) AS lo, CASE WHEN max(x) - min(x) < 1e-6 THEN min(x) + 1e-6 ELSE max(x) END AS hi FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM p) GROUP BY i"
CODES = f"""{P}, r AS (SELECT i, min(x) AS lo, CASE WHEN max(x) - min(x) < 1e-6 THEN min(x) + 1e-6 ELSE max(x) END AS hi FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM p) GROUP BY i),
c AS (SELECT id, i, x, lo, hi, greatest(0, least(255, floor((x - lo) / ((hi - lo) / 255.0::DOUBLE)))) - 128 AS q FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM p) JOIN r USING (i)),
d AS (SELECT id, list(y ORDER BY i) AS vector, list(CASE WHEN y > 0 THEN 1 ELSE 0 END ORDER BY i) AS signs, sum(q) AS codes, max(abs(y - x)) AS worst, count(*) FILTER (WHERE x < lo OR x > hi) AS n_clipped
      FROM (SELECT *, least(lo + (q + 128.5::DOUBLE) * ((hi - lo) / 255.0::DOUBLE), hi) AS y FROM c) GROUP BY id)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = papers(spark, sf_dir)
    return knn.encoded(store, whole_calibration(store), WIDTH)


def vector_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = coded(spark, sf_dir).withColumn("back", V.dequantized(F.col("codes"), F.col("ranges")))
    worst = F.array_max(F.zip_with("back", "vector", lambda a, b: F.abs(a - b)))
    return back.select("id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, q: s + q).alias("codes"), F.round(worst, 9).alias("worst"), F.col("n_clipped").cast("long").alias("n_clipped"))


VECTOR_QUANTIZED = f"WITH {CODES} SELECT id, CAST(codes AS BIGINT) AS codes, round(worst, 9) AS worst, n_clipped FROM d"


def knn_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.quantized(coded(spark, sf_dir), focal_vector(papers(spark, sf_dir), FOCAL), K).select("id", F.round("score", 9).alias("score"))


KNN_INT8 = f"WITH {CODES} SELECT b.id, round({COS}, 9) AS score FROM p a, d b WHERE a.id = {FOCAL} ORDER BY {COS} DESC, b.id LIMIT {K}"


def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.shortlist(coded(spark, sf_dir), focal_vector(papers(spark, sf_dir), FOCAL), K * knn.RESCORE_MULTIPLIER).select("id", F.col("distance").cast("long").alias("distance"))


HAMMING = f"(SELECT d.id, CAST(list_sum(list_transform(list_zip(d.signs, list_transform(a.vector, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM p a, d WHERE a.id = {FOCAL})"
KNN_HAMMING = f"WITH {CODES} SELECT * FROM {HAMMING} ORDER BY distance, id LIMIT {K * knn.RESCORE_MULTIPLIER}"


def knn_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.prefiltered(coded(spark, sf_dir), focal_vector(papers(spark, sf_dir), FOCAL), K).select("id", F.round("score", 9).alias("score"))


KNN_PREFILTERED = f"WITH {CODES}, s AS (SELECT * FROM {HAMMING} ORDER BY distance, id LIMIT {max(K * knn.RESCORE_MULTIPLIER, knn.RESCORE_FLOOR)}) SELECT b.id, round({COS}, 9) AS score FROM p a, d b WHERE a.id = {FOCAL} AND b.id IN (SELECT id FROM s) ORDER BY {COS} DESC, b.id LIMIT {K}"


def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.recall(knn_int8(spark, sf_dir), knn_cosine(spark, sf_dir))


KNN_RECALL = f"WITH t AS ({KNN_COSINE}), f AS ({KNN_INT8}) SELECT (SELECT count(*) FROM f WHERE id IN (SELECT id FROM t)) AS hits, (SELECT count(*) FROM t) AS wanted, (SELECT count(*) FROM f WHERE id IN (SELECT id FROM t)) / (SELECT count(*) FROM t) AS recall"


def pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float], list[float]]:
    store = papers(spark, sf_dir)
    return store.where(F.col("id") != FOCAL), focal_vector(store, FOCAL), focal_vector(store, QUERY)


def rrf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, document, query = pool(spark, sf_dir)
    found = ranking.features(rows, document, query)
    return found.select("id", *[F.round(c, 9).alias(c) for c in ("cos_dd", "cos_q", "ctx")], "direct", "eligible")


FEATURES = f"""{P}, u AS (SELECT *, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) AS unit FROM p),
near AS (SELECT a.id, list_inner_product(a.unit, b.unit) AS c, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.unit, b.unit) DESC) AS n FROM u a JOIN u b ON a.id <> b.id AND b.is_reference AND b.id <> {FOCAL}),
ctx AS (SELECT id, CASE WHEN count(*) = 5 THEN avg(c) END AS ctx FROM near WHERE n <= 5 GROUP BY id),
f AS (SELECT a.*, list_inner_product(a.unit, (SELECT unit FROM u WHERE id = {FOCAL})) AS cos_dd, list_inner_product(a.unit, (SELECT unit FROM u WHERE id = {QUERY})) AS cos_q, ctx,
      a.is_reference OR a.cites_focal AS direct, a.is_reference AND (a.contexts >= 2 OR a.influential) AS eligible FROM u a LEFT JOIN ctx USING (id) WHERE a.id <> {FOCAL})"""
RRF_FEATURES = f"WITH {FEATURES} SELECT id, round(cos_dd, 9) AS cos_dd, round(cos_q, 9) AS cos_q, round(ctx, 9) AS ctx, direct, eligible FROM f"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, document, query = pool(spark, sf_dir)
    return ranking.rank_candidates(rows, document, query)


def rrf_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("id", "rank", F.round("score", 12).alias("score"), *[F.coalesce(f"rank_{n}", F.lit(0)).alias(f"rank_{n}") for n in ranking.LISTS])


RANKED = f"""{FEATURES}, w AS (SELECT *, row_number() OVER (ORDER BY cos_dd DESC, cos_q DESC, id) AS rank_semantic,
  CASE WHEN ctx IS NOT NULL THEN row_number() OVER (PARTITION BY ctx IS NOT NULL ORDER BY ctx DESC, cos_q DESC, id) END AS rank_reference_context,
  CASE WHEN direct THEN row_number() OVER (PARTITION BY direct ORDER BY cos_dd DESC, id) END AS rank_direct,
  CASE WHEN recommendation_rank IS NOT NULL THEN row_number() OVER (PARTITION BY recommendation_rank IS NOT NULL ORDER BY recommendation_rank, id) END AS rank_recommended,
  CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY contexts DESC, influential DESC, cos_dd DESC, cos_q DESC, id) END AS rank_focal_reference FROM f),
s AS (SELECT *, round(coalesce(1::DOUBLE / (60 + rank_semantic), 0) + coalesce(1::DOUBLE / (60 + rank_reference_context), 0) + coalesce(1::DOUBLE / (60 + rank_direct), 0) + coalesce(1::DOUBLE / (60 + rank_recommended), 0) + coalesce(0.5::DOUBLE / (60 + rank_focal_reference), 0), 15) AS score FROM w),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s)"""
RRF_RANKED = f"WITH {RANKED} SELECT id, CAST(rank AS INT) AS rank, round(score, 12) AS score, CAST(coalesce(rank_semantic, 0) AS INT) AS rank_semantic, CAST(coalesce(rank_reference_context, 0) AS INT) AS rank_reference_context, CAST(coalesce(rank_direct, 0) AS INT) AS rank_direct, CAST(coalesce(rank_recommended, 0) AS INT) AS rank_recommended, CAST(coalesce(rank_focal_reference, 0) AS INT) AS rank_focal_reference FROM ranked"


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focal record and the best of the ranking: MAX_PAPERS rows, with where they came from."""
    best = ranked(spark, sf_dir).where(F.col("rank") < MAX_PAPERS)
    source = F.when(F.col("direct") & (F.col("rank_semantic") <= 100), "both").when(F.col("direct"), "citation").otherwise("semantic")
    columns = ["id", "vector", "year", "citations", "refs", "categories", "label"]
    focal = papers(spark, sf_dir).where(F.col("id") == FOCAL).select(*columns, F.lit("both").alias("source"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("direct"))
    # The result is small and used many times.
    return cut(focal.unionByName(best.select(*columns, source.alias("source"), "rank", "score", "direct")).coalesce(1))


def scored_pairs(nodes: DataFrame) -> DataFrame:
    """All pairs of a node table that was cut to MAX_PAPERS rows, with the four scores; it is broadcast, as its size is a parameter. Nodes may have authors."""
    if "authors" not in nodes.columns:
        nodes = nodes.withColumn("authors", F.array().cast("array<string>"))
    a, b = (nodes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "vector", "year", "citations", "refs", "categories", "source", "authors")]) for x in "ab")
    pairs = a.join(F.broadcast(b), F.col("id_a") < F.col("id_b"))
    pairs = pairs.select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), V.cosine(F.col("vector_a"), F.col("vector_b")).alias("cosine"), S.temporal(F.col("year_a"), F.col("year_b")).alias("temporal"),
        S.citation(F.col("citations_a"), F.col("citations_b")).alias("citation"), S.coupling(F.col("refs_a"), F.col("refs_b")).alias("coupling"), S.jaccard(F.col("categories_a"), F.col("categories_b")).alias("category"),
        "source_a", "source_b", N.share_authors(F.col("authors_a"), F.col("authors_b")).alias("shared_author"), ((F.size("refs_a") > 0) & (F.size("refs_b") > 0)).alias("both"),
    )
    c = {n: F.col(n) for n in ("cosine", "temporal", "citation", "coupling", "category")}
    both = F.col("both")
    return pairs.withColumns({
        "hybrid": S.hybrid_strategy(c["cosine"], c["temporal"], c["citation"], c["coupling"], F.col("source_a"), F.col("source_b"), GATE),
        "embedding": S.embedding_strategy(c["cosine"], c["temporal"], c["category"], F.col("shared_author"), GATE),
        "citing": S.citation_strategy(F.greatest(c["cosine"], F.lit(0.0)), c["temporal"], c["citation"], c["coupling"], both),
        "recommended": S.recommendation_strategy(F.greatest(c["cosine"], F.lit(0.0)), c["temporal"], c["citation"], c["coupling"], both),
    })


SCORES = ("cosine", "temporal", "citation", "coupling", "category", "hybrid", "embedding", "citing", "recommended")


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(kept(spark, sf_dir)).select("a", "b", *[F.round(s, 9).alias(s) for s in SCORES])


PAIRS = f"""{RANKED}, k AS (SELECT id, vector, year, citations, refs, categories, CASE WHEN direct AND rank_semantic <= 100 THEN 'both' WHEN direct THEN 'citation' ELSE 'semantic' END AS source FROM ranked WHERE rank < {MAX_PAPERS}
  UNION ALL SELECT id, vector, year, citations, refs, categories, 'both' FROM p WHERE id = {FOCAL}),
q AS (SELECT a.id AS a, b.id AS b, a.source AS sa, b.source AS sb, {COS} AS cosine,
  CASE WHEN a.year IS NULL OR b.year IS NULL THEN 0.5 WHEN abs(a.year - b.year) > 5 THEN 0.1 ELSE 1.0 - abs(a.year - b.year) / 5.0::DOUBLE * 0.8 END AS temporal,
  CASE WHEN a.citations > 0 AND b.citations > 0 THEN 1.0 - abs(log10(a.citations + 1) - log10(b.citations + 1)) / greatest(log10(a.citations + 1), log10(b.citations + 1)) ELSE 0.3 END AS citation,
  len(list_intersect(list_distinct(a.refs), list_distinct(b.refs))) / sqrt(len(list_distinct(a.refs)) * len(list_distinct(b.refs))) AS coupling,
  len(list_intersect(list_distinct(a.categories), list_distinct(b.categories)))::DOUBLE / len(list_distinct(list_concat(a.categories, b.categories))) AS category
  FROM k a JOIN k b ON a.id < b.id),
x AS (SELECT *, CASE WHEN cosine < {GATE} AND coupling <= 0 THEN 0 ELSE least(1, CASE
    WHEN sa <> 'citation' AND sb <> 'citation' AND NOT (sa = 'both' AND sb = 'both') THEN 0.6 * cosine + 0.2 * temporal + 0.1 * citation + 0.1 * coupling
    WHEN sa <> 'semantic' AND sb <> 'semantic' AND NOT (sa = 'both' AND sb = 'both') THEN 0.3 * cosine + 0.3 * temporal + 0.2 * citation + 0.2 * coupling
    ELSE 0.4 * cosine + 0.3 * temporal + 0.2 * citation + 0.1 * coupling END) END AS hybrid,
  CASE WHEN cosine < {GATE} THEN 0 ELSE least(1, 0.5 * cosine + 0.2 * temporal + 0.2 * category) END AS embedding,
  CASE WHEN cosine <= 0 AND coupling <= 0 THEN 0 ELSE 0.40 * greatest(cosine, 0) + 0.20 * temporal + 0.40 * coupling END AS citing,
  CASE WHEN cosine <= 0 AND coupling <= 0 THEN 0 ELSE least(1, 0.60 * greatest(cosine, 0) + 0.15 * temporal + 0.25 * coupling) END AS recommended FROM q)"""
PAIR_SCORES = f"WITH {PAIRS} SELECT a, b, {', '.join(f'round(CAST({s} AS DOUBLE), 9) AS {s}' for s in SCORES)} FROM x"


def hybrid_candidates(nodes: DataFrame) -> DataFrame:
    pairs = scored_pairs(nodes).withColumn("focal", (F.col("a") == FOCAL) | (F.col("b") == FOCAL))
    return pairs.where(S.hybrid_edge(F.col("hybrid"), F.col("focal"))).select("a", "b", F.col("hybrid").alias("weight"), "focal")


def hybrid_edges_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_candidates(kept(spark, sf_dir)).select("a", "b", F.round("weight", 9).alias("weight"))


HYBRID_EDGES_UNCAPPED = f"WITH {PAIRS} SELECT a, b, round(CAST(hybrid AS DOUBLE), 9) AS weight FROM x WHERE hybrid >= 0.2 AND hybrid > CASE WHEN a = {FOCAL} OR b = {FOCAL} THEN 0.4 ELSE 0.5 END"


def edges_of(nodes: DataFrame) -> DataFrame:
    """The degree-capped edges; the focal record's slots go by turns to its own references and citers, and to others."""
    return graph.capped(graph.canonical(hybrid_candidates(nodes)), EDGE_CAP, F.lit(FOCAL), nodes.where("direct").select("id"))


def hybrid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(kept(spark, sf_dir)).select("left", "right", F.round("weight", 9).alias("weight"))


def walk(edges: str, cap: int, focal: bool, preferred: str = "false") -> str:
    """Tables that end in ``kept``: the edges that a greedy walk over the named ones keeps, in their order. The walk's state is the list of the ends taken."""
    other = f'CASE WHEN "left" = {FOCAL} THEN "right" ELSE "left" END'
    at = f'("left" = {FOCAL} OR "right" = {FOCAL})' if focal else "false"
    return f"""w0 AS (SELECT *, {at} AS at_focal, {at} AND {preferred.format(other=other)} AS pre FROM {edges}),
w1 AS (SELECT *, CASE WHEN at_focal THEN row_number() OVER (PARTITION BY at_focal, pre ORDER BY weight DESC, "left", "right") ELSE 0 END AS place FROM w0),
w2 AS (SELECT *, row_number() OVER (ORDER BY NOT at_focal, place, NOT pre, -weight, "left", "right") AS n FROM w1),
walked(n, taken, chosen) AS (SELECT 0, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT w2.n, CASE WHEN fits THEN list_concat(taken, ["left", "right"]) ELSE taken END, CASE WHEN fits THEN list_append(chosen, w2.n) ELSE chosen END
  FROM (SELECT w2.*, walked.taken, walked.chosen, len(list_filter(walked.taken, lambda x: x = w2."left")) < {cap} AND len(list_filter(walked.taken, lambda x: x = w2."right")) < {cap} AS fits FROM walked JOIN w2 ON w2.n = walked.n + 1) w2),
kept AS (SELECT "left", "right", weight FROM w2 WHERE list_contains((SELECT chosen FROM walked ORDER BY n DESC LIMIT 1), n))"""


HYBRID_KEPT = f"""{PAIRS.replace("WITH ", "", 1)}, he AS (SELECT a AS "left", b AS "right", CAST(hybrid AS DOUBLE) AS weight FROM x WHERE hybrid >= 0.2 AND hybrid > CASE WHEN a = {FOCAL} OR b = {FOCAL} THEN 0.4 ELSE 0.5 END),
{walk("he", EDGE_CAP, True, f"({{other}}) IN (SELECT id FROM ranked WHERE direct AND rank < {MAX_PAPERS})")}"""
HYBRID_EDGES = f'WITH RECURSIVE {HYBRID_KEPT} SELECT "left", "right", round(weight, 9) AS weight FROM kept'


def hybrid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each kept record with its rank, degree, relevance, distance to the focal record, and three strongest links."""
    all_columns = kept(spark, sf_dir)
    edges = edges_of(all_columns)
    nodes = all_columns.select("id", "label", "year", "citations", "source", "rank", F.round("score", 12).alias("score"))
    focal = F.lit(FOCAL)
    links = graph.strongest(edges).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "other"))).alias("l"))
    links = links.select(F.col("node").alias("id"), F.array_join(F.transform("l", lambda x: x["other"].cast("string")), ",").alias("links"))
    relevance = graph.pagerank(nodes, edges, focal).select("id", F.round("rank", 9).alias("relevance"))
    found = nodes.join(graph.degrees(nodes, edges), "id").join(relevance, "id").join(graph.distances(nodes, edges, focal).select("id", "distance"), "id")
    return found.join(links, "id", "left")


def embedding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scored_pairs(kept(spark, sf_dir)).where(S.embedding_edge(F.col("embedding"))).select("a", "b", F.col("embedding").alias("weight"))
    return graph.capped(graph.canonical(pairs), 4)


EMBEDDING_EDGES = f'''WITH RECURSIVE {PAIRS}, e AS (SELECT a AS "left", b AS "right", CAST(embedding AS DOUBLE) AS weight FROM x WHERE embedding > 0.1), {walk("e", 4, False)} SELECT * FROM kept'''


def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scored_pairs(kept(spark, sf_dir)).where(S.default_edge(F.col("citing"), 0.2)).select("a", "b", F.col("citing").alias("weight"))
    return graph.capped(graph.canonical(pairs), 3, F.lit(FOCAL))


CITATION_EDGES = f'''WITH RECURSIVE {PAIRS}, e AS (SELECT a AS "left", b AS "right", CAST(citing AS DOUBLE) AS weight FROM x WHERE citing >= 0.2), {walk("e", 3, True)} SELECT * FROM kept'''


def recommendation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scored_pairs(kept(spark, sf_dir)).where(S.default_edge(F.col("recommended"), 0.2)).select("a", "b", F.col("recommended").alias("weight"))
    return graph.capped(graph.canonical(pairs), 3, F.lit(FOCAL))


RECOMMENDATION_EDGES = f'''WITH RECURSIVE {PAIRS}, e AS (SELECT a AS "left", b AS "right", CAST(recommended AS DOUBLE) AS weight FROM x WHERE recommended >= 0.2), {walk("e", 3, True)} SELECT * FROM kept'''


def additional_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    return views.leads(rows, rows.where(F.col("rank") < MAX_PAPERS))


ADDITIONAL_LEADS = f"""WITH {RANKED}, o AS (SELECT * FROM ranked WHERE rank >= {MAX_PAPERS})
SELECT * FROM (SELECT id, 'reference' AS lead FROM o WHERE is_reference AND contexts >= 2 ORDER BY rank LIMIT 10)
UNION ALL SELECT * FROM (SELECT id, 'corpus' AS lead FROM o WHERE NOT is_reference AND NOT cites_focal AND recommendation_rank IS NULL ORDER BY cos_q DESC, id LIMIT 10)"""


def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    citing = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ref"))
    return textsim.coupling_pairs(citing).select("left", "right", "shared", F.round("score", 9).alias("score"))


COUPLING_PAIRS = """WITH l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM lineitem), n AS (SELECT id, count(*) AS n FROM l GROUP BY id),
s AS (SELECT a.id AS "left", b.id AS "right", count(*) AS shared FROM l a JOIN l b ON a.ref = b.ref AND a.id < b.id GROUP BY ALL)
SELECT "left", "right", shared, round(shared / sqrt(a.n * b.n), 9) AS score FROM s JOIN n a ON a.id = "left" JOIN n b ON b.id = "right" """


def place_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers by nation, nations by region."""
    t = {n: read(spark, sf_dir, n) for n in ("customer", "supplier", "nation")}
    edges = (
        t["customer"].select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
        .unionByName(t["supplier"].select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b")))
        .unionByName(t["nation"].select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")))
        .withColumn("weight", F.lit(1.0))
    )
    edges = graph.canonical(edges)
    return edges.select(F.explode(F.array("left", "right")).alias("id")).distinct(), edges


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*place_graph(spark, sf_dir))


PLACES = """e AS (SELECT 'c' || c_custkey AS id, c_nationkey AS n, 2 AS depth FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey, 2 FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 1 FROM nation),
r AS (SELECT id, depth, n_regionkey AS region FROM e JOIN nation ON n = n_nationkey UNION SELECT 'r' || n_regionkey, 0, n_regionkey FROM nation)"""
GRAPH_COMPONENTS = f"WITH {PLACES} SELECT id, min(id) OVER (PARTITION BY region) AS component FROM r"


def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(*place_graph(spark, sf_dir), F.lit("r0")).select("id", F.coalesce("distance", F.lit(-1)).alias("distance"))


GRAPH_DISTANCES = f"WITH {PLACES} SELECT id, CASE WHEN region = 0 THEN CAST(depth AS INT) ELSE -1 END AS distance FROM r"


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*place_graph(spark, sf_dir))


GRAPH_DEGREES = """WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id"""


def graph_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between nations' groups: their regions are what they have in common."""
    nodes, edges = place_graph(spark, sf_dir)
    groups = nodes.select("id", F.substring("id", 1, 1).alias("component"))
    return graph.meta_graph(edges, groups)


GRAPH_META = """SELECT 'c' AS "left", 'n' AS "right", CAST(count(*) AS DOUBLE) AS weight FROM customer UNION ALL SELECT 'n', 's', count(*) FROM supplier UNION ALL SELECT 'n', 'r', count(*) FROM nation"""


def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = kept(spark, sf_dir)
    return graph.pagerank(nodes.select("id"), edges_of(nodes), F.lit(FOCAL)).select("id", F.round("rank", 9).alias("relevance"))


#: Rounds after which 0.85 to their power is far below what is compared.
PAGERANK_CTE = f"""{HYBRID_KEPT}, both_ AS (SELECT "left" AS node, "right" AS other, weight FROM kept UNION ALL SELECT "right", "left", weight FROM kept),
flow AS (SELECT node, other, weight / sum(weight) OVER (PARTITION BY node) AS share FROM both_ UNION ALL SELECT id, {FOCAL}, 1.0 FROM k WHERE id NOT IN (SELECT node FROM both_) UNION ALL SELECT id, id, 0.0 FROM k),
pr(t, id, r) AS (SELECT 0, id, CASE WHEN id = {FOCAL} THEN 1.0::DOUBLE ELSE 0.0 END FROM k UNION ALL SELECT t + 1, other, 0.85 * sum(r * share) + CASE WHEN other = {FOCAL} THEN 0.15 ELSE 0 END FROM pr JOIN flow ON pr.id = flow.node WHERE t < 200 GROUP BY t, other)"""
GRAPH_PAGERANK = f"WITH RECURSIVE {PAGERANK_CTE} SELECT id, round(r, 9) AS relevance FROM pr WHERE t = 200"


def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = kept(spark, sf_dir)
    return graph.communities(nodes.select("id"), edges_of(nodes))


HYBRID_GRAPH = f"""WITH RECURSIVE {PAGERANK_CTE}, steps(id, d) AS (SELECT {FOCAL}::BIGINT, 0 UNION SELECT other, d + 1 FROM steps JOIN both_ ON steps.id = both_.node WHERE d < {MAX_PAPERS}),
s3 AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS place FROM both_ QUALIFY place <= 3)
SELECT k.id, p.label, k.year, k.citations, k.source, CAST(coalesce(r.rank, 0) AS INT) AS rank, round(r.score, 12) AS score, (SELECT count(*) FROM both_ WHERE node = k.id) AS degree,
  round(pr.r, 9) AS relevance, (SELECT min(d) FROM steps WHERE steps.id = k.id) AS distance, (SELECT string_agg(CAST(other AS VARCHAR), ',' ORDER BY place) FROM s3 WHERE node = k.id) AS links
FROM k JOIN p ON p.id = k.id JOIN pr ON pr.id = k.id AND pr.t = 200 LEFT JOIN ranked r ON r.id = k.id"""

QUERIES = {f.__name__: f for f in (
    knn_cosine, vector_validity, vector_norms, vector_calibration, vector_quantized, knn_int8, knn_hamming, knn_prefiltered, knn_recall, rrf_features, rrf_ranked, pair_scores,
    hybrid_edges_uncapped, hybrid_edges, hybrid_graph, embedding_edges, citation_edges, recommendation_edges, additional_leads, coupling_pairs, graph_components, graph_distances, graph_degrees,
    graph_meta, graph_pagerank, graph_communities,
)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
