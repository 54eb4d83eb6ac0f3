"""Snapshots and exported graphs as files: written by Spark, read back and checked."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as T

FORMAT = 1


def write_snapshot(rows: DataFrame, path: str, shards: int = 8, place: str = "row_number", **manifest: str) -> None:
    """Rows in ranges of their place, zstd-compressed, then the manifest: a reader that finds one finds all rows."""
    rows.repartitionByRange(shards, place).sortWithinPartitions(place).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    spark = rows.sparkSession
    n = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(FORMAT, n, rows.schema.json(), dict(manifest))], "format int, rows long, schema string, contract map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str):
    return spark.read.schema("format int, rows long, schema string, contract map<string,string>").json(f"{path}/manifest").first()


def read_snapshot(spark: SparkSession, path: str, place: str = "row_number", key: str = "id", **contract: str) -> DataFrame:
    """The rows, once count, places, keys and contract are as the manifest says; else ValueError."""
    manifest = read_manifest(spark, path)
    if manifest is None or manifest["format"] != FORMAT:
        raise ValueError("the snapshot has no manifest of this format")
    wrong = {k for k, v in contract.items() if manifest["contract"].get(k) != v}
    if wrong:
        raise ValueError(f"the snapshot was made for another {', '.join(sorted(wrong))}")
    rows = spark.read.parquet(f"{path}/rows")
    n, places, keys, first, last, nulls = rows.agg(
        F.count("*"), F.count_distinct(place), F.count_distinct(key), F.min(place), F.max(place), F.sum(F.when(F.col(place).isNull() | F.col(key).isNull(), 1).otherwise(0))
    ).first()
    if n != manifest["rows"] or places != n or keys != n or nulls or (n and (first, last) != (0, n - 1)):
        raise ValueError("the snapshot's rows aren't complete, unique and contiguous")
    return rows


IMPORT_LOG = "shard long, rows long, digest decimal(38,0)"
#: Rows that a job of an import writes, unless a number of shards is asked for.
JOB_ROWS = 64 * 65_536


def shards_told(rows: DataFrame) -> DataFrame:
    """(shard, rows, digest): a digest that doesn't depend on the order of rows."""
    columns = [c for c in rows.columns if c != "shard"]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))


def log_shards(spark: SparkSession, entries: list[tuple], destination: str) -> None:
    spark.createDataFrame(entries, IMPORT_LOG).coalesce(1).write.mode("append").json(f"{destination}/log")


def import_snapshot(spark: SparkSession, path: str, destination: str, batch_rows: int = 65_536, at_once: int | None = None, place: str = "row_number", key: str = "id", **contract: str) -> int:
    """Brings a checked snapshot into ``destination`` shard by shard and returns how many shards were written; an import that broke goes on where it was.

    A shard is ``batch_rows`` places. ``at_once`` shards, or as many as hold JOB_ROWS, are written by a job, read back from their own folders, compared with the snapshot by count and digest, and logged; those in the log aren't read or written again. The manifest comes last. Shards that were
    logged with another digest, or of another size, raise: the snapshot isn't the one that the import began with.
    """
    rows = read_snapshot(spark, path, place, key, **contract).withColumn("shard", F.floor(F.col(place) / batch_rows))
    manifest = read_manifest(spark, path)
    try:
        done = {r["shard"]: (r["rows"], r["digest"]) for r in spark.read.schema(IMPORT_LOG).json(f"{destination}/log").collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = {}
    told = lambda d: {r["shard"]: (r["rows"], r["digest"]) for r in shards_told(d).collect()}
    # The snapshot is digested once, not once more for each job.
    wanted = told(rows)
    if any(wanted.get(s) != d for s, d in done.items()):
        raise ValueError("the import was begun with other rows")
    missing = [s for s in range(-(-manifest["rows"] // batch_rows)) if s not in done]
    step = at_once or max(1, JOB_ROWS // batch_rows)
    for at in range(0, len(missing), step):
        group = missing[at : at + step]
        first, last = group[0] * batch_rows, (group[-1] + 1) * batch_rows
        part = rows.where((F.col(place) >= first) & (F.col(place) < last))
        if group[-1] - group[0] >= len(group):
            part = part.where(F.col("shard").isin(*group))
        part.repartition("shard").sortWithinPartitions("shard", place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(f"{destination}/rows")
        back = told(spark.read.schema(rows.schema).option("basePath", f"{destination}/rows").parquet(*[f"{destination}/rows/shard={s}" for s in group]))
        if back != {s: wanted[s] for s in group}:
            raise ValueError(f"shards {group[0]} to {group[-1]} weren't written as they are")
        log_shards(spark, [(s, *back[s]) for s in group], destination)
    if missing or not done:
        spark.createDataFrame([(FORMAT, manifest["rows"], manifest["schema"], manifest["contract"])], "format int, rows long, schema string, contract map<string,string>").coalesce(1).write.mode("overwrite").json(f"{destination}/manifest")
    return len(missing)


def graph_payload(nodes: DataFrame, edges: DataFrame, strategy: str, focal: str) -> DataFrame:
    """One row, payload: a JSON document of a graph that has been cut to size. nodes and edges are sorted."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ("id", *[c for c in nodes.columns if c != "id"])]))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("left", "right", "weight"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(FORMAT).alias("version"), F.lit(strategy).alias("strategy"), F.lit(focal).alias("focal"), "nodes", "edges")).alias("payload"))


def read_graph(payload: DataFrame, node_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a payload; ids that aren't unique, and edges without both nodes, are errors."""
    parsed = payload.select(F.from_json("payload", f"version int, strategy string, focal string, nodes array<struct<{node_schema}>>, edges array<struct<left:string,right:string,weight:double>>").alias("p"))
    nodes, edges = parsed.select(F.inline("p.nodes")), parsed.select(F.inline("p.edges"))
    n, distinct = nodes.agg(F.count("*"), F.count_distinct("id")).first()
    ends = edges.select(F.col("left").alias("id")).unionByName(edges.select(F.col("right").alias("id")))
    if n != distinct or ends.join(nodes, "id", "left_anti").limit(1).count():
        raise ValueError("the graph's ids aren't unique or an edge has no node")
    return nodes, edges


def csv_rows(nodes: DataFrame) -> DataFrame:
    """One text column, line, for each node: all columns quoted, lists joined by "; ", formulas guarded."""

    def cell(c: str, kind: str) -> Column:
        x = F.array_join(c, "; ") if kind.startswith("array") else F.col(c).cast("string")
        return F.concat(F.lit('"'), F.replace(T.csv_guarded(F.coalesce(x, F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))

    return nodes.select("id", F.concat_ws(",", *[cell(c, k) for c, k in nodes.dtypes]).alias("line"))


#: The columns of a table of nodes, in order.
CSV_COLUMNS = (
    "id", "title", "year", "authors", "citation_count", "venue", "arxiv_id", "doi", "categories", "is_focal", "provenance", "focal_relation", "focal_relevance",
    "arxiv_url", "doi_url", "semantic_scholar_url", "abstract",
)


def csv_table(nodes: DataFrame) -> DataFrame:
    """The fixed columns as texts: lists joined by "; ", formulas guarded, relevance with six places. Null and absent columns are empty, a count is 0 and a flag false; others go."""
    kinds, empty = dict(nodes.dtypes), {"citation_count": "0", "is_focal": "false", "focal_relevance": "0.000000"}

    def cell(c: str) -> Column:
        x, kind, default = F.col(c), kinds.get(c), F.lit(empty.get(c, ""))
        if kind is None:
            return default
        if c == "focal_relevance":
            return F.coalesce(F.format_string("%.6f", F.coalesce(x.cast("double"), F.lit(0.0))), default)
        told = F.coalesce(F.array_join(x, "; ") if kind.startswith("array") else x.cast("string"), default)
        return T.csv_guarded(told) if kind == "string" or kind.startswith("array") else told

    return nodes.select(*[cell(c).alias(c) for c in CSV_COLUMNS])


def write_csv(nodes: DataFrame, path: str) -> None:
    """A folder of CSV files of ``csv_table``, each with a line of column names. Lines end in a bare newline, as the writer turns line ends inside values into those of the file."""
    csv_table(nodes).write.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def bibtex(nodes: DataFrame) -> DataFrame:
    """(id, entry). nodes: id, title, authors, year, venue, doi."""
    esc = T.bibtex_escaped
    field = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), x, F.lit("}")))
    key = F.regexp_replace(F.col("id").cast("string"), "[^A-Za-z0-9_:.-]", "_")
    body = F.concat_ws(
        ",\n", field("title", esc("title")), field("author", esc(F.array_join("authors", " and "))), field("year", F.col("year").cast("string")),
        field("journal", esc("venue")), field("doi", F.regexp_replace("doi", r"[{}\\]", "")),
    )
    return nodes.select("id", F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}")).alias("entry"))


#: Names of the format's types, by Spark's; anything else is a string.
GRAPHML_TYPES = {"boolean": "boolean", "int": "int", "bigint": "long", "float": "double", "double": "double"}


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, line) of a GraphML document, which its lines are in order of part and ord. nodes: id and others; edges: left, right and others.

    Other columns become data of their own type; lists are joined by ", ", nulls left out, and characters that XML doesn't allow too.
    """
    kind = lambda k: GRAPHML_TYPES.get(k, "string")
    about = [("node", c, k) for c, k in nodes.dtypes if c != "id"] + [("edge", c, k) for c, k in edges.dtypes if c not in ("left", "right")]
    keys = [F.concat(F.lit(f'<key id="{w}_{n}" for="{w}" attr.name="'), T.xml_safe(F.lit(c)), F.lit(f'" attr.type="{kind(k)}"/>')) for n, (w, c, k) in enumerate(about)]
    place = {(w, c): f"{w}_{n}" for n, (w, c, _) in enumerate(about)}

    def data(which: str, frame: DataFrame) -> Column:
        def one(c: str, k: str) -> Column:
            x = F.col(f"`{c}`")
            x = F.array_join(x, ", ") if k.startswith("array") else F.to_json(x) if k.startswith(("struct", "map")) else x.cast("string")
            return F.concat(F.lit(f'<data key="{place[which, c]}">'), T.xml_safe(x), F.lit("</data>"))

        return F.concat_ws("", *[one(c, k) for c, k in frame.dtypes if (which, c) in place])

    text = lambda c: T.xml_safe(F.col(c).cast("string"))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("ord"), F.concat(F.lit('<node id="'), text("id"), F.lit('">'), data("node", nodes), F.lit("</node>")).alias("line"))
    ends = F.concat_ws(" ", "left", "right")
    e = edges.select(F.lit(2).alias("part"), ends.alias("ord"), F.concat(F.lit('<edge source="'), text("left"), F.lit('" target="'), text("right"), F.lit('">'), data("edge", edges), F.lit("</edge>")).alias("line"))
    head = F.concat_ws("\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), *keys, F.lit('<graph edgedefault="undirected">'))
    frame = nodes.sparkSession.range(1)
    first, last = frame.select(F.lit(0).alias("part"), F.lit("").alias("ord"), head.alias("line")), frame.select(F.lit(3).alias("part"), F.lit("").alias("ord"), F.lit("</graph>\n</graphml>").alias("line"))
    return first.unionByName(n).unionByName(e).unionByName(last)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of text files; one after another in order of their names they are the document."""
    graphml(nodes, edges).orderBy("part", "ord").select("line").write.text(path)


def collection_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Graphs keyed by strategy and focal record: incoming ones replace stored ones."""
    return incoming.unionByName(stored.join(incoming.select("strategy", "focal"), ["strategy", "focal"], "left_anti"))


def provider_records(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of provider JSON. A missing id drops the row; a citation count or year that isn't a number becomes 0 or null."""
    kind = "paperId string, title string, abstract string, venue string, year string, citationCount string, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string>"
    p = raw.select(F.from_json(payload, kind).alias("p")).select("p.*").where(F.trim("paperId") != "")
    return p.select(
        F.trim("paperId").alias("id"), "title", "abstract", "venue", F.expr("try_cast(year AS int)").alias("year"), F.greatest(F.coalesce(F.expr("try_cast(citationCount AS bigint)"), F.lit(0)), F.lit(0)).alias("citations"),
        F.coalesce(F.filter(F.transform("authors", lambda a: F.trim(a["name"])), lambda n: n != ""), F.array().cast("array<string>")).alias("authors"), F.lower("externalIds.DOI").alias("doi"), F.col("externalIds.ArXiv").alias("arxiv"),
    )


def bibliography(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of the links of HTML pages, by expressions: every quoted href in order."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))
