"""Lines that stand in several documents stay in the first one only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import LOWER, UPPER, let, read, text_or_empty, whole_row, written

#: What is stripped from a line's ends: white space of ASCII.
BLANKS = " \t\n\x0b\x0c\r"
#: A key with more than this share of what is counted is joined apart: there are no more than HOT_SHARE such keys. Its lines are dealt over SALTS tasks.
HOT_SHARE, SALTS = 1000, 64


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: A-Z in lower case, white space at the ends stripped."""
    return F.transform(split_lines(F.translate(text, UPPER, LOWER)), lambda line: F.btrim(line, F.lit(BLANKS)))


def dropped_places(docs: DataFrame, min_length: int, min_docs: int) -> DataFrame:
    """(doc, version, places) of documents that lose lines. docs: doc, version (a hash of the text), text.

    Lines are exploded and shuffled as hashes of 128 bits. Documents of each hash are counted once, by partial sums: first each (hash, document), then each hash. Hashes of ``min_docs`` documents
    or more are written down with their first document and joined with the lines again; those that hold over a thousandth of all such pairs, of which there are a thousand at most, are salted.
    """
    keys = docs.select("doc", "version", F.posexplode(line_keys(F.col("text"))).alias("place", "line")).where(F.length("line") >= min_length)
    lines = keys.select("doc", "version", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    holders = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    # Documents without a key are one document, after all others.
    first = F.min("doc").alias("first")
    shared = written(holders.groupBy("h1", "h2").agg(F.count("*").alias("n"), first).where(F.col("n") >= min_docs))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(shared.where(F.col("n") * HOT_SHARE > total).select("h1", "h2", F.lit(True).alias("hot")))
    salted = lines.join(hot, ["h1", "h2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "version"), F.lit(SALTS)).cast("int")).otherwise(0))
    every = F.when(F.col("n") * HOT_SHARE > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    offered = shared.select("h1", "h2", "first", F.explode(every).alias("salt"))
    lost = salted.join(offered, ["h1", "h2", "salt"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    return lost.groupBy("doc", "version").agg(F.collect_set("place").alias("places"))


def deduplicate(docs: DataFrame, min_length: int = 10, min_docs: int = 2, key: str = "doc_id", text: str = "text", row: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_lines, n_dropped, kept (the text without the lines it loses).

    Lines are what \\n parts. Lines whose key (white space of ASCII stripped at both ends, A-Z in lower case) has ``min_length`` code points and stands in ``min_docs`` documents or more go, except those of
    the document with the smallest key; the others stay as they were, in order, joined by \\n. A text that loses all its lines is empty.

    A null text is one empty line. Rows with one key are one document, so they don't count twice, and all lose or keep a line alike; rows without a key are one document, after all others. With ``row``, all
    columns of a row come along as one struct, whatever their names are; other columns aren't read otherwise. An empty table gives no rows. Of a document, only places of lost lines are gathered.
    """
    if min_docs < 2:
        raise ValueError("a line of a single document isn't repeated")
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("doc"), text_or_empty(f"`{text}`").alias("text"), *([whole_row(docs)] if row else []))
    rows = rows.withColumn("version", F.xxhash64("text"))
    lost = dropped_places(rows.select("doc", "version", "text"), min_length, min_docs).select(F.col("doc").alias("lost_doc"), F.col("version").alias("lost_version"), "places")
    joined = rows.join(lost, F.col("doc").eqNullSafe(F.col("lost_doc")) & (F.col("version") == F.col("lost_version")), "left")

    def reassembled(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
        return F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n")

    out = joined.select(
        F.col("doc").alias(key), F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(let(split_lines(F.col("text")), reassembled)).alias("kept"), *(["row"] if row else []),
    )
    return out


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos, trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS line, unnest(range(len(parts))) AS pos) u
), held AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS docs FROM lines WHERE length(key) >= 10 GROUP BY key)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE docs >= 2 AND l.doc_id <> first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(docs >= 2 AND l.doc_id <> first, false)), '')) AS kept_sha256
FROM lines l LEFT JOIN held USING (key) GROUP BY l.doc_id
"""
