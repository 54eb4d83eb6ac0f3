"""Queries on candidate pools and drawn positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import geometry, pool
from kinweave.plans.tables import WORKS_SQL, read, works

W = f"w AS ({WORKS_SQL})"


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Line items as three ordered lists of parts: those returned, those accepted, and the others."""
    l = read(spark, sf_dir, "lineitem")
    part = lambda flag: l.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return {"references": part("R"), "citations": part("A"), "recommendations": part("N")}


SOURCES = """l AS (SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS n FROM lineitem GROUP BY l_partkey, l_returnflag)"""


def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pool.united(sources(spark, sf_dir))
    return found.select("id", F.col("first.n").alias("n"), F.col("first.pos").alias("pos"), F.array_join("sources", ",").alias("sources"), "best")


POOL_UNION = f"WITH {SOURCES} SELECT id, CAST(min(n) AS INT) AS n, arg_min(pos, n) AS pos, string_agg(CASE n WHEN 0 THEN 'references' WHEN 1 THEN 'citations' ELSE 'recommendations' END, ',' ORDER BY CASE n WHEN 0 THEN 'references' WHEN 1 THEN 'citations' ELSE 'recommendations' END) AS sources, min(pos) AS best FROM l GROUP BY id"


def pool_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 400, by budget, of which 40 are admitted."""
    found = pool.united(sources(spark, sf_dir), pool.budget(spark, 400))
    return pool.admitted(found, F.col("id") > 0, 40).select("id", F.array_join("sources", ",").alias("sources"))


POOL_ADMISSION = f"""WITH {SOURCES}, b AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY pos, id) AS r FROM l QUALIFY r <= CASE n WHEN 0 THEN 100 WHEN 1 THEN 200 ELSE 100 END)
SELECT id, string_agg(CASE n WHEN 0 THEN 'references' WHEN 1 THEN 'citations' ELSE 'recommendations' END, ',' ORDER BY CASE n WHEN 0 THEN 'references' WHEN 1 THEN 'citations' ELSE 'recommendations' END) AS sources FROM b WHERE id > 0 GROUP BY id ORDER BY min(n), arg_min(pos, n), id LIMIT 40"""


def recommendation_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No order is "recent", so the second pool's rows come back."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "all-cs").otherwise("other").alias("pool"))
    return pool.with_fallback(rows).select("id")


RECOMMENDATION_POOL = "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'"


def subject_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), pool.subject_pool(F.array(F.when(F.col("p_size") % 3 == 0, " CS.LG ").when(F.col("p_size") % 3 == 1, "unknown").otherwise("math"))).alias("pool"))


SUBJECT_POOLS = "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 2 THEN 'recent' ELSE 'all-cs' END AS pool FROM part"


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text")
    return pool.searched(rows, ["the", "License"]).select("id")


KEYWORD_SEARCH = "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license') ORDER BY doc_id LIMIT 1000"


def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of line items: those of status F are cached, others come fresh."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    wanted = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    cached = o.where("status = 'F'").withColumn("origin", F.lit("cache"))
    return pool.looked_up(wanted, cached, o.withColumn("origin", F.lit("fresh")))


BATCH_LOOKUP = "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 'cache' ELSE 'fresh' END AS origin FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"


def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.col("l_partkey").alias("ref"))
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array().cast("array<bigint>").alias("refs"))
    found = pool.with_references(records, pool.reference_lists(l))
    return found.select("id", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


REFERENCE_LISTS = """WITH f AS (SELECT l_orderkey AS id, l_partkey AS ref, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS id, coalesce(string_agg(CAST(ref AS VARCHAR), ',' ORDER BY pos, ref), '') AS refs FROM orders LEFT JOIN f ON id = o_orderkey GROUP BY o_orderkey"""


def enriched_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as corpus rows without a venue; customers of the same key supply it, unless their nations differ."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("venue"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("venue"))
    return pool.enriched(s, c, ["venue"], F.col("nation") % 2 != F.col("p_nation") % 2).select("id", F.coalesce("venue", F.lit("")).alias("venue"))


ENRICHED_WORKS = "SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = c_nationkey % 2 THEN c_mktsegment ELSE '' END AS venue FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey"


def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.explode(F.array("p_name", "p_type")).alias("spelling"))
    return pool.bound_spellings(entries)


ALIAS_UNION = """WITH e AS (SELECT p_partkey AS entry, p_name AS spelling FROM part UNION ALL SELECT p_partkey, p_type FROM part), f AS (SELECT spelling, min(entry) AS least FROM e GROUP BY spelling),
h AS (SELECT entry, min(least) AS head FROM e JOIN f USING (spelling) GROUP BY entry) SELECT DISTINCT spelling, head AS entry FROM e JOIN h USING (entry)"""


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("weight"))
    return pool.summary(works(spark, sf_dir), edges).withColumn("weight", F.round("weight", 2))


GRAPH_SUMMARY = f"WITH {W} SELECT count(*) AS nodes, min(year) AS first_year, max(year) AS last_year, (SELECT count(*) FROM lineitem) AS edges, (SELECT round(sum(l_quantity), 2) FROM lineitem) AS weight FROM w"


def namespace_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), "n_chars")
    return pool.namespaces(rows.withColumnRenamed("n_chars", "bytes")).select(F.coalesce("namespace", F.lit("all")).alias("namespace"), "files", "bytes")


NAMESPACE_SIZES = "SELECT coalesce(source, 'all') AS namespace, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def layout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.normalized(positions(spark, sf_dir)).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


LAYOUT_POSITIONS = """WITH b AS (SELECT min(p_size)::DOUBLE AS lx, max(p_size)::DOUBLE AS hx, min(p_retailprice) AS ly, max(p_retailprice) AS hy FROM part)
SELECT p_partkey AS id, round((p_size - (lx + hx) * 0.5) / (greatest(hx - lx, hy - ly) * 0.5) * 0.9, 9) AS x, round((p_retailprice - (ly + hy) * 0.5) / (greatest(hx - lx, hy - ly) * 0.5) * 0.9, 9) AS y FROM part, b"""


def layout_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.emptiest_corner(positions(spark, sf_dir)).withColumn("crowding", F.round("crowding", 6))


LAYOUT_CORNER = """WITH b AS (SELECT min(p_size)::DOUBLE AS lx, max(p_size)::DOUBLE AS hx, min(p_retailprice) AS ly, max(p_retailprice) AS hy FROM part),
u AS (SELECT (p_size - lx) / (hx - lx) AS x, (p_retailprice - ly) / (hy - ly) AS y FROM part, b), c(ord, corner, cx, cy) AS (VALUES (0, 'lower_left', 0.05, 0.05), (1, 'lower_right', 0.95, 0.05), (2, 'upper_left', 0.05, 0.95), (3, 'upper_right', 0.95, 0.95))
SELECT corner, round(sum(CASE WHEN abs(x - cx) < 0.22 AND abs(y - cy) < 0.22 THEN 1 ELSE 0 END) + 1.0 - avg(abs(x - cx) + abs(y - cy)), 6)::DOUBLE AS crowding FROM u, c GROUP BY ord, corner ORDER BY crowding, ord LIMIT 1"""


def edge_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    joined = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name", geometry.curve(F.col("n_name"), F.col("r_name")).alias("curve"), geometry.shade(F.col("n_nationkey"), F.lit(0), F.lit(24), (0, 16, 32), (255, 128, 64)).alias("shade"))


EDGE_CURVES = """WITH k AS (SELECT n_name, r_name, n_nationkey AS n, least(n_name, r_name) || '|' || greatest(n_name, r_name) AS key FROM nation JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT *, list_reduce(list_concat([0::BIGINT], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 33 + c) % 4294967296) AS h FROM k)
SELECT n_name, r_name, CASE WHEN h % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS curve,
  '#' || list_aggregate(list_transform([[0, 255], [16, 128], [32, 64]], lambda e: lpad(lower(to_hex(CAST(floor(e[1] + (CASE WHEN n > 0 THEN n / 24::DOUBLE ELSE 0.5 END) * (e[2] - e[1]) + 0.5) AS INT))), 2, '0')), 'string_agg', '') AS shade FROM h"""


def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in a plane of size and price, by how often they are ordered."""
    w = works(spark, sf_dir)
    price = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 2000.0).alias("y"))
    return geometry.labelled(w.join(price, "id").select("id", "is_focal", "citations", "year", "x", "y")).select("id", "place")


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sources of a region's pool: those of odd keys are unavailable."""
    n = read(spark, sf_dir, "nation")
    status = n.select(F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 2 == 1, "unavailable").otherwise("complete").alias("state"), F.col("n_regionkey").alias("papers"))
    return pool.availability(status).withColumn("missing", F.array_join("missing", ","))


AVAILABILITY = "SELECT count(*) AS asked, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS usable, string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 2 = 1) AS missing FROM nation"


def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of many sizes against corpora of many."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stored = F.when(k % 4 == 0, "all").when(k % 4 == 1, F.concat(F.lit("newest:"), (k % 10).cast("string"))).when(k % 4 == 2, "odd")
    wanted = F.when(k % 3 != 0, k % 7)
    return p.select(k.alias("id"), pool.coverage(stored, wanted).alias("coverage"), pool.budgets(k.cast("int"))["citations"].alias("citations"))


CORPUS_COVERAGE = """WITH s AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'newest' ELSE 'odd' END AS s, p_partkey % 10 AS n, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 7 END AS w, least(100, greatest(1, p_partkey // 4)) AS r FROM part)
SELECT k AS id, CASE WHEN s = 'odd' THEN 'incompatible' WHEN s = 'all' THEN CASE WHEN w IS NULL THEN 'exact' ELSE 'covers' END WHEN w IS NULL THEN 'extends' WHEN n = w THEN 'exact' WHEN n > w THEN 'covers' ELSE 'extends' END AS coverage,
  CAST(greatest(0, k - r - least(100, ceil(greatest(0, k - r) / 3.0::DOUBLE))) AS INT) AS citations FROM s"""

QUERIES = {f.__name__: f for f in (
    pool_union, pool_admission, recommendation_pool, subject_pools, keyword_search, batch_lookup, reference_lists, enriched_works, alias_union, graph_summary, namespace_sizes, layout_positions,
    layout_corner, edge_curves, shown_labels, availability, corpus_coverage,
)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
