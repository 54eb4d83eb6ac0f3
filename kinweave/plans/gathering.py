"""Queries on gathered papers, on rows that a provider repeats or contradicts, and on what edges and identities have to meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import ids, scores
from kinweave.operators import corpus, gathering, identity, pool, views
from kinweave.plans.tables import read

FOCAL, MOST, REFERENCES, CITERS = 3, 60, 40, 30


def citation_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    record = F.floor(v / 4).alias("id")
    references, citers = rows.where(v % 3 == 1).select(record, v.alias("pos")), rows.where(v % 5 == 2).select(record, v.alias("pos"))
    citers = citers.unionByName(rows.where(v % 40 == 7).select((v + 2).alias("id"), (v + 3).alias("pos")))
    return gathering.citation_slots(references, citers, F.lit(FOCAL), MOST, REFERENCES, CITERS)


CITATION_SLOTS = f"""
WITH r AS (SELECT vec_id // 4 AS id, min(vec_id) AS a FROM embeddings WHERE vec_id % 3 = 1 GROUP BY 1 ORDER BY a LIMIT {min(MOST - 1, REFERENCES)}),
references_ AS (SELECT * FROM r WHERE id <> {FOCAL}),
offered AS (SELECT vec_id // 4 AS id, vec_id AS pos FROM embeddings WHERE vec_id % 5 = 2 UNION ALL SELECT vec_id + 2, vec_id + 3 FROM embeddings WHERE vec_id % 40 = 7),
c AS (SELECT id, min(pos) AS b, row_number() OVER (ORDER BY min(pos)) AS n FROM offered GROUP BY id),
citers AS (SELECT id, b FROM c WHERE id <> {FOCAL} AND n <= least({CITERS}, {MOST - 1} - (SELECT count(*) FROM references_)))
SELECT CAST({FOCAL} AS BIGINT) AS id, 'focal' AS relation, 0 AS slot
UNION ALL
SELECT id, CASE WHEN a IS NULL THEN 'citation' WHEN b IS NULL THEN 'reference' ELSE 'both' END, CAST(row_number() OVER (ORDER BY a IS NULL, coalesce(a, b), id) AS INT) FROM references_ FULL JOIN citers USING (id)
"""


def recommendation_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        F.floor(d / 3).alias("id"), F.when(d % 5 != 0, F.concat(F.lit("Title "), d.cast("string"))).otherwise(" ").alias("title"), F.when(d % 7 != 0, F.col("source")).alias("abstract"), (-d).alias("pos")
    )
    return gathering.recommendation_slots(rows, F.lit(FOCAL), MOST)


RECOMMENDATION_SLOTS = f"""
WITH one AS (SELECT doc_id // 3 AS id, min(-doc_id) AS pos FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND trim(source) <> '' AND doc_id // 3 <> {FOCAL} GROUP BY 1 ORDER BY pos LIMIT {MOST - 1})
SELECT CAST({FOCAL} AS BIGINT) AS id, 0 AS slot UNION ALL SELECT id, CAST(row_number() OVER (ORDER BY pos, id) AS INT) FROM one
"""


def usable_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the order of their first order that is worth anything."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), "o_totalprice")
    return identity.ranked_once(rows, F.col("o_totalprice") > 100_000)


USABLE_RANKS = """
SELECT id, pos, CAST(row_number() OVER (ORDER BY pos, id) AS INT) AS rank
FROM (SELECT o_custkey AS id, min(o_orderkey) AS pos FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
"""


def conflicting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines bear several return flags."""
    return identity.conflicting(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag"), "id", F.col("l_returnflag"))


CONFLICTING_ROWS = "SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1"


def corrected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("venue"), F.col("c_nationkey").cast("int").alias("year"), F.col("c_acctbal").alias("kept"))
    new = read(spark, sf_dir, "customer").where(k % 3 == 0).select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("venue "), k.cast("string"))).alias("venue"), F.when(k % 5 != 0, F.lit(2020)).alias("year"))
    return corpus.corrected(rows, new, ["venue", "year"])


CORRECTED_ROWS = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'venue ' || c_custkey ELSE c_name END AS venue,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 2020 ELSE CAST(c_nationkey AS INT) END AS year, c_acctbal AS kept
FROM customer
"""


def references_without_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share neither brand nor type with the first one."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")
    return pool.without_focal(rows, rows.where("id = 1"), ["p_brand", "p_type"])


REFERENCES_WITHOUT_FOCAL = """
SELECT p_partkey AS id, p_brand, p_type FROM part
WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey = 1) AND p_type NOT IN (SELECT p_type FROM part WHERE p_partkey = 1)
"""


def edge_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations as edges: relative strength among those of a nation, of which some have one supplier, and which rules of edges their scores pass."""
    edges = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("left"), F.col("s_nationkey").alias("right"), ((F.col("s_suppkey") * 37) % 101 / 100).alias("weight"))
    w = F.col("weight")
    rules = {"by_default": scores.default_edge(w, 0.3), "by_embedding": scores.embedding_edge(w), "by_hybrid": scores.hybrid_edge(w, F.col("left") % 4 == 0)}
    return views.relative_strength(edges, "right").select("left", "right", "weight", "strength").withColumns(rules)


EDGE_STRENGTHS = """
WITH e AS (SELECT s_suppkey AS "left", s_nationkey AS "right", (s_suppkey * 37) % 101 / 100.0::DOUBLE AS weight FROM supplier),
b AS (SELECT "right", min(weight) AS lo, max(weight) AS hi FROM e GROUP BY "right")
SELECT "left", "right", weight, CASE WHEN hi - lo > 1e-9 THEN (weight - lo) / (hi - lo) ELSE 0.5 END AS strength, weight > 0 AND weight >= 0.3::DOUBLE AS by_default, weight > 0.1::DOUBLE AS by_embedding,
       weight >= 0.2::DOUBLE AND weight > CASE WHEN "left" % 4 = 0 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS by_hybrid
FROM e JOIN b USING ("right")
"""


def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two sources give for an order, as namespaces, and whether they agree."""
    k = F.col("o_orderkey")
    paper = lambda n, v: F.concat(F.lit("arXiv:24"), F.lpad((1 + n % 12).cast("string"), 2, "0"), F.lit("."), F.lpad((n % 7).cast("string"), 5, "0"), F.lit(v))
    left = F.when(k % 3 == 0, paper(k, "v2")).when(k % 3 == 1, F.concat(F.lit("https://doi.org/10.1000/W"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("content:"), k.cast("string")))
    right = F.when(k % 2 == 0, paper(k, "")).otherwise(F.concat(F.lit("10.1000/w"), (k % 4).cast("string")))
    rows = read(spark, sf_dir, "orders").select(k.alias("id"), left.alias("left"), right.alias("right"))
    told = rows.select("id", ids.local_only(F.col("left")).alias("local"), ids.namespaces(F.col("left")).alias("a"), ids.namespaces(F.col("right")).alias("b"))
    return told.select("id", "local", F.col("a.arxiv").alias("arxiv"), F.col("a.doi").alias("doi"), ids.same_identity(F.col("a"), F.col("b")).alias("same"), ids.conflict(F.col("a"), F.col("b")).alias("conflicting"))


IDENTITY_CHECKS = """
WITH n AS (SELECT o_orderkey AS k, '24' || lpad(CAST(1 + o_orderkey % 12 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 5, '0') AS paper FROM orders),
t AS (SELECT k, CASE WHEN k % 3 = 0 THEN paper END AS arxiv, CASE WHEN k % 3 = 1 THEN '10.1000/w' || (k % 5) END AS doi, CASE WHEN k % 2 = 0 THEN paper END AS arxiv2,
             CASE WHEN k % 2 = 1 THEN '10.1000/w' || (k % 4) END AS doi2 FROM n),
c AS (SELECT *, coalesce(arxiv <> arxiv2, false) OR coalesce(doi <> doi2, false) AS conflicting FROM t)
SELECT k AS id, k % 3 = 2 AS "local", arxiv, doi, (coalesce(arxiv = arxiv2, false) OR coalesce(doi = doi2, false)) AND NOT conflicting AS same, conflicting FROM c
"""

QUERIES = {f.__name__: f for f in (citation_slots, recommendation_slots, usable_ranks, conflicting_rows, corrected_rows, references_without_focal, edge_strengths, identity_checks)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
