"""Queries on raw rows, the fields of records, and a corpus that follows its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import fields as N
from kinweave.operators import knn, rawrows
from kinweave.plans.tables import PAPERS_SQL, focal_vector, papers, read

#: Raw rows of differing habits, made of the documents' keys; the same text for both engines. Lists are texts with | and ; between their parts.
RAW = """
SELECT doc_id AS ordinal,
  CASE doc_id % 4 WHEN 0 THEN concat(lpad(CAST(10 + doc_id % 15 AS STRING), 2, '0'), lpad(CAST(1 + doc_id % 14 AS STRING), 2, '0'), '.', lpad(CAST(doc_id AS STRING), 5, '0'), 'v', CAST(1 + doc_id % 3 AS STRING))
    WHEN 1 THEN ' ' WHEN 2 THEN concat('key-', CAST(doc_id % 97 AS STRING)) END AS id,
  CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Untitled' ELSE concat(' Title ', CAST(doc_id % 50 AS STRING), '  of ', lang, ' ') END AS title,
  CASE doc_id % 5 WHEN 0 THEN '  ' ELSE concat('About ', source) END AS abstract,
  CASE doc_id % 3 WHEN 0 THEN '' ELSE concat('Summary ', CAST(doc_id AS STRING)) END AS summary,
  CASE doc_id % 6 WHEN 0 THEN 'V' END AS venue, CASE doc_id % 4 WHEN 0 THEN ' ' ELSE 'J' END AS journal_ref, 'K' AS journal_dash_ref, 'L' AS journal,
  CASE doc_id % 4 WHEN 0 THEN 'Ann Lee, , Bo Chu' WHEN 1 THEN NULL ELSE concat('A', CAST(doc_id % 7 AS STRING), ' X, B', CAST(doc_id % 5 AS STRING)) END AS authors,
  CASE doc_id % 6 WHEN 0 THEN 'Lee;Ann;|;;|Chu; Bo ;Jr' WHEN 1 THEN ';;' END AS triples,
  CASE doc_id % 3 WHEN 0 THEN 'cs.CL, cs.LG cs.CL' WHEN 1 THEN '' ELSE concat('math.', CAST(doc_id % 9 AS STRING)) END AS categories,
  CASE doc_id % 6 WHEN 0 THEN concat('10.1000/ABC', CAST(doc_id AS STRING), ',') WHEN 1 THEN concat('doi: 10.1000/x', CAST(doc_id % 40 AS STRING), ' extra') WHEN 2 THEN concat('https://doi.org/10.1000/y', CAST(doc_id AS STRING), '; 10.2000/z') WHEN 3 THEN 'junk' ELSE '' END AS doi,
  CASE doc_id % 5 WHEN 0 THEN '2014' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN ' 2015 ' END AS year,
  CASE doc_id % 4 WHEN 0 THEN '2020-01-02' WHEN 1 THEN '2020-01-02T03:04:05Z' WHEN 2 THEN 'Mon, 2 Apr 2007 19:18:42 GMT' ELSE 'bad' END AS update_date,
  concat('v1;Mon, 2 Apr 2007 19:18:42 GMT|v', CAST(doc_id % 3 AS STRING), ';2020-01-0', CAST(1 + doc_id % 9 AS STRING), '|x;') AS versions
FROM {documents}
"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RAW, documents=read(spark, sf_dir, "documents"))
    version = lambda v: F.struct(F.get(F.split(v, ";"), F.lit(0)).alias("version"), F.get(F.split(v, ";"), F.lit(1)).alias("created"))
    triples = F.transform(F.split("triples", r"\|"), lambda t: F.split(t, ";"))
    return rows.withColumns({"authors_parsed": triples, "versions": F.transform(F.split("versions", r"\|"), version)}).drop("triples").withColumnRenamed("journal_dash_ref", "journal-ref")


ARXIV = r"regexp_matches(id, '^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$')"
STAMP = "CASE WHEN {x} ~ '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN {x} || 'T00:00:00.000000+00:00' WHEN {x} LIKE '%Z' THEN replace({x}, 'Z', '.000000+00:00') WHEN {x} LIKE '%GMT' THEN strftime(try_strptime({x}, '%a, %-d %b %Y %H:%M:%S GMT'), '%Y-%m-%dT%H:%M:%S') || '.000000+00:00' ELSE '' END"
RAW_CTE = rf"""raw AS ({RAW.format(documents="documents")}),
n0 AS (SELECT *, CASE WHEN {ARXIV} THEN 'arxiv:' || regexp_replace(id, 'v[0-9]+$', '') ELSE nullif(trim(id), '') END AS stated,
  CASE WHEN {ARXIV} AND CAST(id[3:4] AS INT) BETWEEN 1 AND 12 THEN (2000 + CAST(id[1:2] AS BIGINT)) * 10000000 + CAST(id[3:4] AS INT) * 100000 + CAST(regexp_extract(id, '\.([0-9]+)', 1) AS INT) END AS chronology,
  CASE WHEN trim(abstract) <> '' THEN abstract WHEN trim(summary) <> '' THEN summary ELSE '' END AS abs,
  CASE WHEN trim(coalesce(venue, '')) <> '' THEN venue WHEN trim(journal_ref) <> '' THEN journal_ref ELSE journal_dash_ref END AS place,
  CASE WHEN doc6 = 0 THEN ['Ann Lee', 'Bo Chu Jr'] ELSE list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: trim(x)), lambda x: x <> '') END AS people,
  list_filter(string_split(CASE WHEN categories LIKE 'cs.CL,%' THEN 'cs.CL cs.LG' ELSE categories END, ' '), lambda x: x <> '') AS labels,
  CASE doc6 WHEN 0 THEN lower(replace(doi, ',', '')) WHEN 1 THEN '10.1000/x' || (ordinal % 40) WHEN 2 THEN '10.1000/y' || ordinal ELSE '' END AS own_doi,
  CASE WHEN regexp_matches(trim(year), '^[0-9]+$') THEN CAST(trim(year) AS INT) END AS own_year,
  trim(regexp_replace(CASE WHEN coalesce(title, '') = 'Untitled' THEN '' ELSE coalesce(title, '') END, '\s+', ' ', 'g')) AS clean
  FROM (SELECT *, ordinal % 6 AS doc6 FROM raw)),
n1 AS (SELECT *, coalesce(own_year, CAST(chronology // 10000000 AS INT)) AS y FROM n0),
n AS (SELECT *, coalesce(stated, CASE WHEN clean <> '' OR trim(abs) <> '' THEN 'content:' || sha256(clean || chr(31) || trim(regexp_replace(abs, '\s+', ' ', 'g')) || chr(31) || array_to_string(people, chr(30)) || chr(31) || coalesce(CAST(y AS VARCHAR), '') || chr(31) || own_doi) END) AS key,
  {STAMP.format(x="update_date")} AS updated,
  greatest(1, ordinal % 3, CASE WHEN {ARXIV} THEN 1 + ordinal % 3 ELSE 0 END) AS number FROM n1)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rawrows.normalized(raw(spark, sf_dir))
    return rows.select("ordinal", "id", "title", "abstract", "venue", "arxiv", "doi", "year", F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"), "chronology")


RAW_RECORDS = f"""WITH {RAW_CTE} SELECT ordinal, key AS id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'Unknown' ELSE title END AS title, abs AS abstract, place AS venue,
  CASE WHEN {ARXIV} THEN regexp_replace(id, 'v[0-9]+$', '') END AS arxiv, nullif(own_doi, '') AS doi, y AS year, array_to_string(people, '|') AS authors, array_to_string(labels, '|') AS categories, CAST(chronology AS BIGINT) AS chronology FROM n"""


def raw_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawrows.normalized(raw(spark, sf_dir)).select("ordinal", "priority.updated", "priority.number")


RAW_PRIORITIES = f"WITH {RAW_CTE} SELECT ordinal, updated, CAST(number AS INT) AS number FROM n"


def raw_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest ids, each by its winning row. Rows of one key differ in their priority or are told apart by their content."""
    rows = rawrows.normalized(raw(spark, sf_dir)).where("arxiv IS NOT NULL")
    return rawrows.selected(rows, 200).select("id", "ordinal")


RAW_SELECTION = f"WITH {RAW_CTE} SELECT key AS id, ordinal FROM n WHERE {ARXIV} ORDER BY chronology IS NULL, chronology DESC, CASE WHEN chronology IS NULL THEN ordinal ELSE -ordinal END LIMIT 200"


def role_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw(spark, sf_dir)
    return r.select("ordinal", *[N.role_text(k, F.col("title"), F.col("abstract"), F.col("id")).alias(k) for k in ("query", "document", "similarity")])


ROLE_TEXTS = rf"""WITH raw AS ({RAW.format(documents="documents")}), c AS (SELECT ordinal, coalesce(nullif(trim(id), ''), 'unknown-paper') AS name, trim(abstract) AS a,
  trim(regexp_replace(CASE WHEN coalesce(title, '') = 'Untitled' THEN '' ELSE coalesce(title, '') END, '\s+', ' ', 'g')) AS t FROM raw),
s AS (SELECT *, coalesce(nullif(concat_ws('. ', nullif(t, ''), nullif(a, '')), ''), name) AS similarity FROM c)
SELECT ordinal, 'task: search result | query: ' || similarity AS query, 'title: ' || CASE WHEN t <> '' THEN t WHEN a <> '' THEN 'none' ELSE name END || ' | text: ' || a AS document, similarity FROM s"""


def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, years, lists and weights that texts hold."""
    p = read(spark, sf_dir, "part")
    k, x = F.col("p_partkey"), F.concat(F.lit("["), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), "p_brand", F.lit('", " ", "b"'))).otherwise("oops"), F.lit("]"))
    text = F.when(k % 4 == 0, F.lit("1.5 ")).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.lit("none"))
    weight = F.col("p_retailprice") * F.when(k % 5 == 0, -1).otherwise(1)
    return p.select(
        k.alias("id"), N.number(text, -1.0).alias("number"), N.publication_year(text).alias("year"), F.to_json(N.text_list(x)).alias("items"), N.as_json_list(N.text_list(x)).alias("kept"),
        N.edge_weight(weight).alias("weight"), F.round(N.layout_distance(N.edge_weight(weight)), 9).alias("distance"), N.length_bucket(F.col("p_name")).alias("bucket"),
        N.default_provenance(F.when(k % 2 == 0, "embedding").otherwise("citation")).alias("provenance"),
    )


COERCED_VALUES = r"""SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN 1.5 WHEN 1 THEN p_partkey ELSE -1 END AS DOUBLE) AS number, CAST(CASE p_partkey % 4 WHEN 1 THEN p_partkey ELSE 0 END AS INT) AS year,
  CASE WHEN p_partkey % 3 = 0 THEN '["' || p_brand || '"," ","b"]' ELSE '[]' END AS items, CASE WHEN p_partkey % 3 = 0 THEN '["' || p_brand || '","b"]' ELSE '[]' END AS kept,
  CASE WHEN p_partkey % 5 = 0 OR p_retailprice <= 0 THEN 1e-6::DOUBLE ELSE p_retailprice END AS weight, round(1.0::DOUBLE / (1e-6::DOUBLE + CASE WHEN p_partkey % 5 = 0 OR p_retailprice <= 0 THEN 1e-6::DOUBLE ELSE p_retailprice END), 9) AS distance,
  CAST(greatest(len(regexp_split_to_array(trim(p_name), '\s+')), length(trim(p_name)) // 4, 1) AS INT) AS bucket, CASE WHEN p_partkey % 2 = 0 THEN 'semantic' ELSE 'citation' END AS provenance FROM part"""


def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of records, and the guard, badge and label beside them."""
    k = F.col("page_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("arxiv:2101."), F.lpad(k.cast("string"), 5, "0"), F.lit("v2"))).when(k % 4 == 1, F.concat(F.lit("10.1000/a b*"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("10.1000/(a)~"), k.cast("string"))).otherwise("other")
    stated = F.when(k % 8 == 5, F.lit(" 10.1/q+[x]%? "))
    found = N.links(name, F.lit(None).cast("string"), stated, k % 3 == 0)
    relation = F.element_at(F.array(*[F.lit(x) for x in ("semantic_only", " overlap ", "cites_focal", "odd")]), (k % 4).cast("int") + 1)
    return read(spark, sf_dir, "pages").select(
        k.alias("id"), found["arxiv_abs"].alias("arxiv_abs"), found["arxiv_pdf"].alias("arxiv_pdf"), found["doi"].alias("doi"), found["provider"].alias("provider"), N.web_link(F.when(k % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))).alias("url"),
        N.relation_badge(k == 1, relation).alias("badge"), N.source_label(F.when(k % 2 == 0, "focal").otherwise("both"), F.lit("semantic")).alias("source"),
    )


EXTERNAL_LINKS = r"""SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'https://arxiv.org/abs/2101.' || lpad(CAST(page_id AS VARCHAR), greatest(5, 5), '0') END AS arxiv_abs,
  CASE WHEN page_id % 4 = 0 THEN 'https://arxiv.org/pdf/2101.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || '.pdf' END AS arxiv_pdf,
  CASE WHEN page_id % 8 = 5 THEN 'https://doi.org/10.1/q%2B[x]%25%3F' WHEN page_id % 4 = 2 THEN 'https://doi.org/10.1000/(a)~' || page_id END AS doi,
  CASE WHEN page_id % 3 <> 0 OR page_id % 2 = 0 THEN 'https://www.semanticscholar.org/paper/' || CASE page_id % 4 WHEN 0 THEN 'arxiv%3A2101.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || 'v2' WHEN 1 THEN '10.1000%2Fa%20b%2A' || page_id WHEN 2 THEN '10.1000%2F%28a%29~' || page_id ELSE 'other' END END AS provider,
  CASE WHEN page_id % 3 <> 0 AND regexp_matches(trim(url), '(?i)^https?://[^\s/]') THEN trim(url) ELSE '' END AS url,
  CASE WHEN page_id = 1 THEN 'Focal paper' ELSE CASE page_id % 4 WHEN 0 THEN 'No direct citation recorded' WHEN 1 THEN 'Cites and is cited by focal paper' WHEN 2 THEN 'Cites focal paper' ELSE '' END END AS badge,
  CASE WHEN page_id % 2 = 0 THEN 'Semantic' ELSE 'Citation and semantic' END AS source FROM pages"""


def provider_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in payloads of several shapes, the venue and the number that a journal tells, lookup ids and aliases."""
    k = F.col("s_suppkey")
    key = F.concat(F.lit("r"), k.cast("string"))
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    json = F.when(k % 4 == 0, q('"', key, '"')).when(k % 4 == 1, q('{"paperId": null, "paper_id": "', key, '"}')).when(k % 4 == 2, q('{"paper": {"paperId": "', key, '"}}')).otherwise("{}")
    volume = F.when(k % 3 == 0, q("abs/2101.0000", (k % 9).cast("string"), "v1")).when(k % 3 == 1, "abs/a:b").otherwise("12")
    name = F.when(k % 5 == 0, "query:x").when(k % 5 == 1, "arxiv_7").when(k % 5 == 2, "10.1000/Z").otherwise(" key ")
    return read(spark, sf_dir, "supplier").select(
        k.alias("id"), N.reference_id(json).alias("reference"), N.first_filled(F.lit(" "), F.when(k % 2 == 0, "V"), F.lit("W")).alias("venue"), N.arxiv_of_journal(F.lit(" ArXiv "), volume).alias("arxiv"),
        N.lookup_id(name, F.when(k % 7 == 0, "2101.00001v3"), F.lit(None).cast("string"), k % 2 == 0).alias("lookup"), F.array_join(N.aliases(name, F.when(k % 7 == 0, "2101.00001v3"), F.lit("doi:10.1000/A")), "|").alias("aliases"),
    )


PROVIDER_FIELDS = """WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'query:x' WHEN 1 THEN 'arxiv_7' WHEN 2 THEN '10.1000/Z' ELSE 'key' END AS name FROM supplier)
SELECT id, CASE WHEN id % 4 < 3 THEN 'r' || id END AS reference, CASE WHEN id % 2 = 0 THEN 'V' ELSE 'W' END AS venue, CASE WHEN id % 3 = 0 THEN '2101.0000' || (id % 9) ELSE '' END AS arxiv,
  CASE WHEN name = 'query:x' THEN NULL WHEN id % 2 = 0 THEN CASE WHEN id % 7 = 0 THEN 'arxiv:2101.00001' WHEN name = '10.1000/Z' THEN '10.1000/z' END WHEN name = 'arxiv_7' THEN NULL ELSE name END AS lookup,
  array_to_string(list_sort(list_concat([name, '10.1000/a'], CASE WHEN id % 7 = 0 THEN ['arxiv:2101.00001'] ELSE [] END)), '|') AS aliases FROM s"""


def legacy_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by position of rows that their content names now."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("content:"), F.sha2(F.encode("text", "UTF-8"), 256)).alias("content_id"), F.concat(F.lit("arxiv_"), F.col("doc_id").cast("string")).alias("id"))
    return d.groupBy("content_id").agg(F.array_join(F.array_sort(F.collect_set("id")), "|").alias("ids"))


LEGACY_ALIASES = "SELECT 'content:' || sha256(text) AS content_id, string_agg(DISTINCT 'arxiv_' || doc_id, '|' ORDER BY 'arxiv_' || doc_id) AS ids FROM documents GROUP BY text"

FOCAL, QUERY, K = 0, 1, 20
P = f"p AS ({PAPERS_SQL})"
COS = "list_inner_product(a.vector, b.vector) / (sqrt(list_inner_product(a.vector, a.vector)) * sqrt(list_inner_product(b.vector, b.vector)))"


def corpus_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest records with a year, in the roles of a document and of a query."""
    store = papers(spark, sf_dir)
    return rawrows.two_roles(store, focal_vector(store, FOCAL), focal_vector(store, QUERY), K, F.col("year").isNotNull())


def _role(key: int, name: str) -> str:
    return f"(SELECT b.id, CAST(row_number() OVER (ORDER BY {COS} DESC, b.id) AS INT) AS {name} FROM p a, p b WHERE a.id = {key} AND b.year IS NOT NULL QUALIFY {name} <= {K})"


CORPUS_ROLES = f"WITH {P} SELECT id, rank_document, rank_query, least(rank_document, rank_query) AS best FROM {_role(FOCAL, 'rank_document')} FULL JOIN {_role(QUERY, 'rank_query')} USING (id)"


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each tenth row, of those that the view of records with a year holds, with the records that claim them."""
    store = papers(spark, sf_dir)
    coded = knn.encoded(store, knn.calibration(store, 1 << 30), 64)
    wanted = rawrows.in_view(store.where("id % 10 = 0").select("id"), store, store.where("year IS NOT NULL"))
    found = rawrows.gathered(wanted, coded, store.select("id", "row_idx").unionByName(store.where("id % 40 = 0").select((F.col("id") + 1_000_000).alias("id"), "row_idx")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return found.select("id", "row_idx", F.col("owners").cast("long").alias("owners"), F.round(length, 9).alias("length"))


STORED_VECTORS = f"WITH {P} SELECT id, row_idx, CASE WHEN id % 40 = 0 THEN 2 ELSE 1 END::BIGINT AS owners, 1.0::DOUBLE AS length FROM p WHERE id % 10 = 0 AND year IS NOT NULL"


def recovered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider gave no reference, so the 15 of the bibliography that are nearest to the focal record."""
    store = papers(spark, sf_dir)
    found = store.where("is_reference").select("id", "vector", F.col("row_idx").alias("pos"))
    return rawrows.with_bibliography(store.where("id < 0").select("id"), found, focal_vector(store, FOCAL), 15)


RECOVERED_REFERENCES = f"WITH {P} SELECT b.id, 'bibliography' AS origin FROM p a, p b WHERE a.id = {FOCAL} AND b.is_reference ORDER BY {COS} DESC, b.row_idx LIMIT 15"


def corpus_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are members, ordered ones are stored."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    return rawrows.certificate(parts, lines, parts.count())


CORPUS_CERTIFICATE = """WITH s AS (SELECT count(*) AS members, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) AS stored FROM part)
SELECT members, stored, members - stored AS dangling, 0::BIGINT AS repeated, members AS examined, members = stored AS complete FROM s"""


def corpus_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored orders after the source's status came in, those that a broken run left out, and members that are chosen still."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("status"))
    stored = o.where("id % 3 <> 0").withColumn("status", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("status")))
    refreshed = rawrows.refreshed(stored, o.where("id % 7 <> 0"), ["status"]).select("id", "status", F.when(F.col("changed"), "changed").otherwise("kept").alias("state"))
    missing = rawrows.unfinished(o, stored).select("id", "status", F.lit("missing").alias("state"))
    members = rawrows.retained(o.select("id", (F.col("ordinal") + (F.col("id") % 2)).alias("ordinal")), o).select("id", F.lit(None).cast("string").alias("status"), F.lit("member").alias("state"))
    return refreshed.unionByName(missing).unionByName(members).groupBy("state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count_distinct("status").alias("statuses"))


CORPUS_FOLLOWED = """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders), r AS (
  SELECT id, CASE WHEN id % 5 = 0 AND id % 7 = 0 THEN 'old' ELSE status END AS status, CASE WHEN id % 5 = 0 AND id % 7 <> 0 THEN 'changed' ELSE 'kept' END AS state FROM o WHERE id % 3 <> 0
  UNION ALL SELECT id, status, 'missing' FROM o WHERE id % 3 = 0 UNION ALL SELECT id, NULL, 'member' FROM o WHERE id % 2 = 0)
SELECT state, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, count(DISTINCT status) AS statuses FROM r GROUP BY state"""


def clip_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as writes, late line items as values that were clipped."""
    l = read(spark, sf_dir, "lineitem")
    writes = l.groupBy(F.year("l_shipdate").alias("batch")).agg(F.sum(F.when(F.col("l_quantity") > 49, 1).otherwise(0)).alias("clipped"), F.count("*").alias("total"))
    return rawrows.saturation(writes).withColumn("ratio", F.round("ratio", 9))


CLIP_TOTALS = """WITH w AS (SELECT CAST(year(l_shipdate) AS INT) AS batch, count(*) FILTER (WHERE l_quantity > 49) AS c, count(*) AS t FROM lineitem GROUP BY 1)
SELECT batch, CAST(sum(c) OVER (ORDER BY batch) AS BIGINT) AS clipped, CAST(sum(t) OVER (ORDER BY batch) AS BIGINT) AS total, c >= 0.005 * t AS warns, round(sum(c) OVER (ORDER BY batch)::DOUBLE / sum(t) OVER (ORDER BY batch), 9) AS ratio FROM w"""

QUERIES = {f.__name__: f for f in (
    raw_records, raw_priorities, raw_selection, role_texts, coerced_values, external_links, provider_fields, legacy_aliases, corpus_roles, stored_vectors, recovered_references,
    corpus_certificate, corpus_followed, clip_totals,
)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
