"""Queries on records: identity, corpus maintenance, texts, lists and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import ids as I
from kinweave.functions import text as T
from kinweave.operators import corpus, identity, textsim, views
from kinweave.plans.tables import WORKS_SQL, read, works
from kinweave.session import ship
from kinweave.sources import files
from kinweave.streaming import upserts

W = f"w AS ({WORKS_SQL})"
#: Stop words of the TF-IDF query, so that both engines have the same.
STOP = ["the", "of", "and", "to", "in", "is", "that", "for", "as", "with"]


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One winner of each text, with the number of its copies."""
    return read(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


EXACT_DUPLICATES = "SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY text"


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.one_line(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("content:"), F.sha2(F.encode("text", "UTF-8"), 256)).alias("content_id"), F.concat(F.lit("query:"), F.substring(F.sha1(F.encode("text", "UTF-8")), 1, 8)).alias("query_id"), F.length(text).cast("long").alias("clean_chars"))


CONTENT_IDS = r"SELECT doc_id, 'content:' || sha256(text) AS content_id, 'query:' || substr(sha1(text), 1, 8) AS query_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_chars FROM documents"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("alias")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("alias"))).unionByName(
        c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("alias"))
    )


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case names, which only the folded lookup finds, and market segments, which many records have."""
    rows = named(spark, sf_dir)
    wanted = rows.select(F.upper("alias").alias("name")).distinct()
    return identity.resolved(wanted, rows).select("name", F.coalesce("id", F.lit("")).alias("id"))


ALIAS_RESOLUTION = """WITH a AS (SELECT 'c' || c_custkey AS id, c_name AS alias FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer),
e AS (SELECT alias, min(id) AS id FROM a GROUP BY alias HAVING count(DISTINCT id) = 1), f AS (SELECT lower(alias) AS alias, min(id) AS id FROM a GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT n.name, coalesce(e.id, f.id, '') AS id FROM (SELECT DISTINCT upper(alias) AS name FROM a) n LEFT JOIN e ON e.alias = n.name LEFT JOIN f ON f.alias = lower(n.name)"""


def version_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works: an odd size is a preprint, brand and type are the author and the title."""
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), (1975 + F.col("p_size")).alias("year"), F.lit(None).cast("string").alias("doi"), (F.col("p_partkey") % 2 == 1).alias("preprint"))
    return identity.folded_versions(rows)


VERSION_FOLDING = """WITH r AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author, 1975 + p_size AS year, p_partkey % 2 = 1 AS preprint FROM part),
a AS (SELECT title, author, y AS year, min(id) AS pre FROM (SELECT *, unnest([year, year + 1]) AS y FROM r WHERE preprint) GROUP BY ALL HAVING count(DISTINCT id) = 1),
b AS (SELECT title, author, year, min(id) AS pub FROM r WHERE NOT preprint GROUP BY ALL HAVING count(DISTINCT id) = 1),
f AS (SELECT DISTINCT pre, pub FROM a JOIN b USING (title, author, year))
SELECT pre AS preprint_id, pub AS publication_id FROM f WHERE pre IN (SELECT pre FROM f GROUP BY pre HAVING count(*) = 1) AND pub IN (SELECT pub FROM f GROUP BY pub HAVING count(*) = 1)"""


def unique_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that are the only ones of their nation and balance, to the thousand."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("balance"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("balance"))
    return identity.unique_pairs(c, s, ["nation", "balance"])


UNIQUE_MATCHES = """WITH c AS (SELECT c_nationkey AS n, floor(c_acctbal / 100) AS b, min(c_custkey) AS left_id FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) = 1),
s AS (SELECT s_nationkey AS n, floor(s_acctbal / 100) AS b, min(s_suppkey) AS right_id FROM supplier GROUP BY 1, 2 HAVING count(DISTINCT s_suppkey) = 1) SELECT left_id, right_id FROM c JOIN s USING (n, b)"""


def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the rows that several sources have of a part."""
    l = read(spark, sf_dir, "lineitem")
    blank = F.col("l_returnflag") == "N"
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = l.select(
        F.col("l_partkey").alias("member"), pos.alias("pos"), F.when(blank, " ").otherwise(F.concat_ws(" ", "l_returnflag", pos.cast("string"))).alias("title"), F.lit("").alias("abstract"), F.col("l_linestatus").alias("venue"),
        F.col("l_quantity").cast("long").alias("citations"), F.array("l_suppkey").alias("references"), F.col("l_returnflag").alias("source"),
    )
    m = identity.merged(rows)
    return m.select("member", F.coalesce("title", F.lit("")).alias("title"), "venue", "citations", F.array_join(F.transform("references", lambda r: r.cast("string")), ",").alias("refs"), F.array_join("sources", ",").alias("sources"), "best_rank")


MERGED_METADATA = """WITH r AS (SELECT l_partkey AS member, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag || ' ' || (l_orderkey * 10 + l_linenumber) END AS title, l_linestatus AS venue, CAST(l_quantity AS BIGINT) AS citations, l_suppkey AS ref, l_returnflag AS source FROM lineitem),
f AS (SELECT member, ref, min(pos) AS pos FROM r GROUP BY ALL), g AS (SELECT member, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY pos, ref) AS refs FROM f GROUP BY member)
SELECT member, coalesce(arg_min(title, pos) FILTER (WHERE trim(title) <> ''), '') AS title, arg_min(venue, pos) AS venue, max(citations) AS citations, any_value(refs) AS refs, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(pos) AS best_rank FROM r JOIN g USING (member) GROUP BY member"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("cites"), F.bool_or(F.col("l_returnflag") == "R").alias("cited"))
    return flags.select(F.col("l_partkey").alias("id"), identity.relation(F.col("l_partkey") == 1, F.col("cites"), F.col("cited")).alias("relation"))


RELATIONS = """SELECT l_partkey AS id, CASE WHEN l_partkey = 1 THEN 'focal' WHEN bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') THEN 'both' WHEN bool_or(l_returnflag = 'R') THEN 'reference' WHEN bool_or(l_returnflag = 'A') THEN 'citation' ELSE 'semantic_only' END AS relation FROM lineitem GROUP BY l_partkey"""


def passage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.concat(F.lit("  "), F.col("event_type"), F.lit(" \n ")).alias("context"), F.when(F.col("event_type") == "purchase", F.col("value") > 50).alias("influential"))
    found = identity.evidence(rows)
    return found.select("id", F.array_join("contexts", "|").alias("contexts"), F.coalesce(F.col("influential").cast("string"), F.lit("unknown")).alias("influential"))


PASSAGE_EVIDENCE = """WITH c AS (SELECT user_id AS id, event_type AS c, min(event_id) AS pos FROM events GROUP BY ALL)
SELECT id, string_agg(c, '|' ORDER BY pos) AS contexts, (SELECT coalesce(CAST(bool_or(CASE WHEN event_type = 'purchase' THEN value > 50 END) AS VARCHAR), 'unknown') FROM events WHERE user_id = id) AS influential FROM c GROUP BY id"""


def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_quantity")
    return corpus.first_usable(rows, F.col("l_quantity") > 10, limit=1000).select("id", "pos")


FIRST_RECORDS = "SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem WHERE l_quantity > 10 GROUP BY 1 ORDER BY pos LIMIT 1000"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyyMM").cast("long")).alias("chronology"), F.col("o_orderpriority").alias("content"))


DATED = "o AS (SELECT o_orderkey AS id, o_orderkey AS ordinal, CASE WHEN o_orderstatus <> 'P' THEN CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) END AS chronology FROM orders)"


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.newest(dated(spark, sf_dir), 500).select("id", F.coalesce("chronology", F.lit(0)).alias("chronology"))


NEWEST_ORDERS = f"WITH {DATED} SELECT id, coalesce(chronology, 0) AS chronology FROM o ORDER BY chronology IS NULL, chronology DESC, CASE WHEN chronology IS NULL THEN ordinal ELSE -ordinal END LIMIT 500"


def active_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return corpus.active(dated(spark, sf_dir), members).select("id")


ACTIVE_VIEW = f"WITH {DATED} SELECT id FROM o WHERE id IN (SELECT l_orderkey FROM lineitem)"


def dangling_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    with_orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return corpus.dangling(members, with_orders)


DANGLING_MEMBERS = "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


def store_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.integrity(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx")))


STORE_INTEGRITY = 'SELECT count(*) AS n, count(DISTINCT vec_id) AS places, min(vec_id) AS "first", max(vec_id) AS "last", count(*) = count(DISTINCT vec_id) AND min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AS contiguous FROM embeddings'


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("updated"), F.floor("value").alias("version"), F.date_format("ts", "HH:mm").alias("created"), F.col("event_type").alias("content"), F.col("event_id").alias("ordinal"))


def source_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.latest_version(source_rows(spark, sf_dir)).select("id", "ordinal")


ROWS = "e AS (SELECT user_id AS id, strftime(ts, '%Y-%m-%d') AS updated, CAST(floor(value) AS BIGINT) AS version, strftime(ts, '%H:%M') AS created, event_type AS content, event_id AS ordinal FROM events)"
SOURCE_WINNERS = f"WITH {ROWS} SELECT id, ordinal FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated DESC, version DESC, created DESC, content DESC, ordinal) = 1"


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_counts(source_rows(spark, sf_dir))


SOURCE_COUNTS = f"WITH {ROWS} SELECT CAST(sum(n) AS BIGINT) AS examined, count(*) AS distinct_ids, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous FROM (SELECT id, count(*) AS n, count(DISTINCT content) AS c FROM e GROUP BY id)"


def incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored: all documents but the French. Incoming: all but the German, of which the Spanish have changed."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    new = d.where("lang <> 'de'").withColumn("text", F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return d.where("lang <> 'fr'"), new


def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.upsert_plan(*incoming(spark, sf_dir))


UPSERT_ACTIONS = "SELECT doc_id AS id, CASE lang WHEN 'fr' THEN 'append' WHEN 'de' THEN 'absent' WHEN 'es' THEN 'replace' ELSE 'refresh' END AS action FROM documents"


def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.upserted(*incoming(spark, sf_dir)).select("id", F.length("text").cast("long").alias("chars"))


UPSERTED_ROWS = "SELECT doc_id AS id, length(text) + CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS chars FROM documents"


def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dated(spark, sf_dir)
    stored = rows.where("content <> '1-URGENT'")
    return corpus.late_rows(rows, stored, 2000).select("id")


LATE_ORDERS = f"WITH {DATED} SELECT id FROM (SELECT * FROM o ORDER BY chronology IS NULL, chronology DESC, CASE WHEN chronology IS NULL THEN ordinal ELSE -ordinal END LIMIT 2000) WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"


def corpus_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dated(spark, sf_dir)
    return corpus.is_current(rows, rows.where("content <> '1-URGENT'"))


CORPUS_CURRENCY = f"WITH {DATED}, s AS (SELECT max(chronology) AS m FROM o WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')) SELECT max(chronology) AS newest_incoming, any_value(m) AS newest_stored, any_value(m) >= max(chronology) AS is_current FROM o, s"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upserts.windowed_counts(read(spark, sf_dir, "events"))
    return found.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


EVENT_WINDOWS = "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made of order dates and keys, in both styles and as DOIs."""
    o = read(spark, sf_dir, "orders")
    yymm, n = F.date_format("o_orderdate", "yyMM"), F.col("o_orderkey")
    raw = F.when(n % 3 == 0, F.concat(F.lit("arXiv:"), yymm, F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit("v2"))).when(n % 3 == 1, F.concat(F.lit("hep-th/"), yymm, F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("https://doi.org/10.48550/arXiv."), yymm, F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0")))
    x = F.col("raw")
    return o.select(n.alias("id"), raw.alias("raw")).select(
        "id", F.coalesce(I.recognized(x, bare=True), I.arxiv_of_doi(x), F.lit("")).alias("arxiv"), F.coalesce(I.doi(x), F.lit("")).alias("doi"), F.coalesce(I.chronology(x), F.lit(0)).alias("chronology"),
    )


ARXIV_IDS = r"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 3 AS kind, strftime(o_orderdate, '%y%m') AS ym, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS s5, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS s3 FROM orders),
c AS (SELECT *, CASE WHEN CAST(left(ym, 2) AS INT) >= 91 THEN 1900 ELSE 2000 END + CAST(left(ym, 2) AS INT) AS y, CAST(right(ym, 2) AS INT) AS m FROM r)
SELECT id, CASE kind WHEN 0 THEN 'arxiv:' || ym || '.' || s5 WHEN 1 THEN 'arxiv:hep-th/' || ym || s3 ELSE 'arxiv:' || ym || '.' || s5 END AS arxiv, CASE WHEN kind = 2 THEN '10.48550/arxiv.' || ym || '.' || s5 ELSE '' END AS doi,
CASE kind WHEN 0 THEN y * 10000000::BIGINT + m * 100000 + CAST(s5 AS INT) WHEN 1 THEN y * 10000000::BIGINT + m * 100000 + CAST(s3 AS INT) ELSE 0 END AS chronology FROM c"""


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = I.host(F.col("url"))
    return read(spark, sf_dir, "pages").groupBy(host.alias("host"), I.in_domain(host, "example.com").alias("in_domain")).agg(F.count("*").alias("n"))


PAGE_HOSTS = r"SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host, host = 'example.com' OR host LIKE '%.example.com' AS in_domain, count(*) AS n FROM pages GROUP BY ALL"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.bibliography(read(spark, sf_dir, "pages")).select("page_id", "pos", "href")


PAGE_LINKS = r"""SELECT page_id, CAST(i - 1 AS INT) AS pos, h AS href FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages))"""


def tfidf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return textsim.similar_to(textsim.weights(docs, 5000, STOP), F.lit(0), 20).select("id", F.round("score", 8).alias("score"))


TFIDF_NEIGHBOURS = rf"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP}, w)) AS w FROM documents),
u AS (SELECT id, unnest(w) AS term FROM t UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
c AS (SELECT id, term, count(*) AS tf FROM u GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents WHERE trim(text) <> '')) / (1 + df)) + 1) AS x FROM c JOIN v USING (term)),
w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x)
SELECT b.id, round(sum(a.w * b.w), 8) AS score FROM w a JOIN w b USING (term) WHERE a.id = 0 AND b.id <> 0 GROUP BY b.id ORDER BY sum(a.w * b.w) DESC, b.id LIMIT 20"""


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), T.folded_words(F.col("p_name")).alias("title_key"), T.plain_words(F.col("p_type")).alias("type_key"), F.coalesce(T.composed(T.without_placeholder(F.col("p_name")), F.col("p_type")), F.lit("")).alias("composed"),
        T.surname(F.col("p_name")).alias("surname"), T.label(F.array("p_name"), F.col("p_size")).alias("label"),
    )


TITLE_KEYS = r"""SELECT p_partkey AS id, array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), ' ') AS title_key, array_to_string(regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+'), ' ') AS type_key, trim(p_name) || '. ' || trim(p_type) AS composed,
regexp_extract(trim(p_name), '(\S+)$', 1) AS surname, regexp_extract(trim(p_name), '(\S+)$', 1) || ', ' || p_size AS label FROM part"""


def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.visible(works(spark, sf_dir), 1980, 2015, ["semantic", "both"])
    return views.listed(shown).select("id", "year", "citations", "pos")


WORK_LIST = f"WITH {W} SELECT id, year, citations, CAST(row_number() OVER (ORDER BY is_focal DESC, citations DESC, year DESC, id) AS INT) AS pos FROM w WHERE (year >= 1980 OR is_focal) AND (year <= 2015 OR is_focal) AND source IN ('semantic', 'both')"


def work_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.year_scale(views.tier(works(spark, sf_dir))).select("id", "tier", F.round("shade", 9).alias("shade"))


WORK_TIERS = f"WITH {W}, n AS (SELECT *, row_number() OVER (ORDER BY citations DESC, id) AS place FROM w) SELECT id, CASE WHEN place <= 3 THEN 'top' WHEN place <= 8 THEN 'high' WHEN place <= 15 THEN 'middle' ELSE 'low' END AS tier, round((year - (SELECT min(year) FROM w)) / ((SELECT max(year) FROM w) - (SELECT min(year) FROM w))::DOUBLE, 9) AS shade FROM n"


def work_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir).withColumn("relation", F.when(F.col("source") == "semantic", "semantic_only").when(F.col("source") == "citation", "citation").otherwise("reference"))
    which = [views.scope(s, F.col("year"), F.lit(2000), F.col("relation"), F.col("is_focal")).alias(s) for s in ("prior", "derivative")]
    return w.select("id", *which)


WORK_SCOPES = f"WITH {W} SELECT id, CASE WHEN is_focal OR source = 'both' THEN true WHEN source = 'citation' THEN false ELSE year <= 2000 END AS prior, CASE WHEN is_focal OR source = 'citation' THEN true WHEN source = 'both' THEN false ELSE year >= 2000 END AS derivative FROM w"


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir).select("id", F.concat(F.lit("="), "title").alias("title"), "authors", "year")
    return files.csv_rows(w)


CSV_EXPORT = f"""WITH {W} SELECT id, '"' || id || '","''=' || replace(title, '"', '""') || '","' || array_to_string(authors, '; ') || '","' || year || '"' AS line FROM w"""


def bibtex_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir).select("id", F.concat("title", F.lit(" & 50%")).alias("title"), "authors", "year", "venue", F.lit("10.1/{x}").alias("doi"))
    return files.bibtex(w)


BIBTEX_EXPORT = rf"""WITH {W}, e AS (SELECT *, regexp_replace(title || ' & 50%', '([&%$#_{{}}])', '\\\1', 'g') AS t, regexp_replace(array_to_string(authors, ' and '), '([&%$#_{{}}])', '\\\1', 'g') AS a, regexp_replace(venue, '([&%$#_{{}}])', '\\\1', 'g') AS v FROM w)
SELECT id, '@article{{' || id || ',' || chr(10) || '  title = {{' || t || '}},' || chr(10) || '  author = {{' || a || '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10) || '  journal = {{' || v || '}},' || chr(10) || '  doi = {{10.1/x}}' || chr(10) || '}}' AS entry FROM e"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), T.slug(F.col("p_name")).alias("slug"), T.human_bytes(F.col("p_partkey") * 4096).alias("size"))


SLUGS = r"""SELECT p_partkey AS id, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 40) || '-' || left(sha256(p_name), 8) AS slug,
CASE WHEN p_partkey * 4096 >= 1073741824 THEN format('{:,.1f} GB', p_partkey * 4096 / 1073741824::DOUBLE) WHEN p_partkey * 4096 >= 1048576 THEN format('{:,.1f} MB', p_partkey * 4096 / 1048576::DOUBLE) WHEN p_partkey > 0 THEN format('{:,.1f} KB', p_partkey * 4096 / 1024::DOUBLE) ELSE '0 B' END AS size FROM part"""

QUERIES = {f.__name__: f for f in (
    exact_duplicates, content_ids, alias_resolution, version_folding, unique_matches, merged_metadata, relations, passage_evidence, first_records, newest_orders, active_view, dangling_members,
    store_integrity, source_winners, source_counts, upsert_actions, upserted_rows, late_orders, corpus_currency, event_windows, arxiv_ids, page_hosts, page_links, tfidf_neighbours, title_keys,
    work_list, work_tiers, work_scopes, csv_export, bibtex_export, slugs,
)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES}
