"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled shared tokens until their buckets are small."""

from __future__ import annotations

import functools
import hashlib
import math
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_rows, checkpointed, read, text_or_empty, whole_row
from kinweave.llm.pairs import block_pairs, components, dealt, forest_of, grouped_arrow
from kinweave.llm.wumanber import words

#: Tokens (i, i-th minimum) that stand for a set while paths are chosen.
TOKENS = 64
CHILDREN = 2


class Hashes(dict):
    """64-bit hashes of words; it starts anew beyond a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = Hashes()
ODD = np.random.default_rng(20_011).integers(1, 1 << 63, TOKENS, np.uint64) | np.uint64(1)
ADD = np.random.default_rng(20_012).integers(1, 1 << 63, TOKENS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; fewer words, but not none, are one shingle."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """The set's least values under TOKENS hash functions."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, (s[at : at + 4096, None] * ODD + ADD).min(axis=0))
    return least


def runs_for(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold has shared a token, and then a child at each of four levels, with probability ``recall``."""
    one = threshold * (1 - (1 - threshold) ** CHILDREN) ** 4
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def signed_rows(docs: DataFrame, n: int, runs: int, text: str, key: str) -> DataFrame:
    """(key, text_key, n_shingles, d1, d2, starts, tokens) of each row; d1 and d2 are the digest of its set, and null if it is empty.

    tokens are the lowest bytes of the minima; starts names the bucket of each run by its whole minimum.
    """
    salts = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def make():
        def step(batch):
            sets = [shingles(t, n) for t in batch.column(2).to_pylist()]
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None) for s in sets]
            least = [minima(s) if len(s) else None for s in sets]
            return {
                "key": batch.column(0), "text_key": batch.column(1), "n_shingles": [len(s) for s in sets],
                "d1": [d[0] for d in digests], "d2": [d[1] for d in digests],
                "starts": [None if x is None else mixed(x[np.arange(runs) % TOKENS] ^ salts).view(np.int64) for x in least],
                "tokens": [None if x is None else (x >> np.uint64(32)).astype(np.uint8).tobytes() for x in least],
            }

        return step

    body = text_or_empty(text)
    return arrow_rows(docs.select(docs[key].cast("long"), F.xxhash64(body), body), make, "key long, text_key long, n_shingles long, d1 long, d2 long, starts array<long>, tokens binary")


def candidates(classes: DataFrame, limit: int, levels: int, least: int) -> DataFrame:
    """Edges (a, b) that span, in each bucket, the classes whose tokens agree in ``least`` places or more. classes: node, starts, tokens."""
    schema = "a long, b long"

    def make():
        def step(batch):
            node, own = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "block"))
            tokens = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("tokens")).to_pylist()), np.uint8).reshape(len(node), TOKENS)
            links = np.zeros((len(node), len(node)), bool)
            for k in range(len(node)):
                links[k] = (tokens[k] == tokens).sum(axis=1) >= least
            if own.min() != own.max():
                links &= own[:, None] != own
            edges = forest_of(links)
            return [{"a": [node[x] for x, _ in edges], "b": [node[y] for _, y in edges]}] if edges else None

        return step

    def compared(part: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("size") / limit).cast("long")
        members = part.select("node", F.col("path").alias("component"), blocks.alias("blocks")).join(active, "node")
        return checkpointed(grouped_arrow(dealt(members, "blocks"), ["component", "i", "j"], make, schema))

    found = []
    rows = classes.select("node", F.explode("starts").alias("path"), F.lit(None).cast("long").alias("parent"))
    active = None
    for level in range(levels + 1):
        sizes = checkpointed(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))
        kept = checkpointed(rows.join(sizes, "path"))
        if active is None:
            active = checkpointed(classes.select("node", "tokens").join(kept.select("node").distinct(), "node", "left_semi"))
        # A bucket that a split didn't halve holds near copies, which no split parts.
        ready = F.lit(True) if level == levels else (F.col("size") <= limit) | F.coalesce(F.col("size") * 2 > F.col("parent"), F.lit(False))
        found.append(compared(kept.where(ready)))
        large = kept.where(~ready)
        if level == levels or large.limit(1).count() == 0:
            break
        place = F.pmod(F.xxhash64("path", "c"), F.lit(TOKENS)).cast("int") + 1
        rows = large.join(active, "node").withColumn("c", F.explode(F.array(*[F.lit(c) for c in range(CHILDREN)])))
        rows = rows.select("node", F.xxhash64("path", "c", F.substring("tokens", place, F.lit(1))).alias("path"), F.col("size").alias("parent"))
    return functools.reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, limit: int = 2048, levels: int = 4, block_bytes: int = 2 << 20, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: key, text_key (xxhash64 of the text), n_shingles, class_id, n_links, kept.

    Rows with equal sets of word shingles are one class first. A class stands in one bucket a run, named by a sampled token of
    its set; buckets over ``limit`` classes are split on further sampled tokens, CHILDREN for each class, ``levels`` times at
    most, and what is still larger, or isn't halved by a split, is compared by pairs of blocks: nothing is dropped. Inside a bucket the tokens tell which
    classes may be near; a spanning forest of those goes on. Every pair of classes that this connects is then compared exactly,
    on the whole sets, by pairs of blocks. ``runs_for`` gives the number of runs.

    n_links counts the other rows whose similarity is at least the threshold, copies included; class_id is the smallest key
    reachable by links; one row of each class, with that key, is kept. Null and wordless texts have no shingles and link with
    nothing. A text of fewer than n words is one shingle. Repeated rows are rows of their own, of which at most one is kept.
    Null keys stay null and name a class only if it has no other. Other columns aren't read; an empty table gives no rows.
    """
    num, den = Fraction(str(threshold)).as_integer_ratio()
    least = math.floor(TOKENS * threshold - 4.2 * math.sqrt(TOKENS * threshold * (1 - threshold)))
    signed = checkpointed(signed_rows(docs, n, runs_for(threshold, recall), text, key).withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("key").isNull(), "key", "uid", "text_key"))
    classes = signed.where(F.col("d1").isNotNull()).groupBy("d1", "d2").agg(F.count("*").alias("copies"), first.alias("first"), F.min(F.struct("starts", "tokens")).alias("sign"))
    classes = checkpointed(classes.select("d1", "d2", "copies", "sign.starts", "sign.tokens", F.col("first.uid").alias("node"), F.col("first.key").alias("key"), F.col("first.text_key").alias("text_key")))
    loose = components(candidates(classes.select("node", "starts", "tokens"), limit, levels, least))
    near = classes.join(loose, "node").select("node", "component", "copies", "key", "text_key")
    body = docs.select(docs[key].cast("long").alias("key"), F.xxhash64(text_or_empty(text)).alias("text_key"), text_or_empty(text).alias("text"))
    same = near.withColumnsRenamed({"key": "k", "text_key": "t"})
    texts = same.join(body, F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("text_key"))).dropDuplicates(["node"])
    members = texts.select("node", "component", "copies", "text", (F.octet_length("text") + 64).cast("long").alias("weight"))

    def make():
        def step(batch):
            node, copies, own, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "copies", "block", "i", "j"))
            sets = [shingles(t.as_py(), n) for t in batch.column(batch.schema.get_field_index("text"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            links = shared_counts(sets) * (num + den) >= num * (sizes[:, None] + sizes)
            np.fill_diagonal(links, False)
            if i[0] != j[0]:
                links &= own[:, None] != own
            edges = forest_of(links)
            yield {"node": node, "other": [None] * len(node), "links": links @ copies}
            if edges:
                yield {"node": node[[x for x, _ in edges]], "other": node[[y for _, y in edges]], "links": np.zeros(len(edges), np.int64)}

        return step

    compared = checkpointed(grouped_arrow(block_pairs(members, "weight", block_bytes), ["component", "i", "j"], make, "node long, other long, links long"))
    linked = compared.groupBy("node").agg(F.sum("links").alias("links"))
    tight = components(compared.where(F.col("other").isNotNull()), "node", "other")
    named = classes.join(linked, "node", "left").join(tight, "node", "left")
    named = checkpointed(named.select("d1", "d2", "node", "copies", "key", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("key").isNull(), "key", "node")).alias("head"))
    resolved = named.join(checkpointed(heads), "component").select("d1", "d2", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("head.key").alias("class_id"), F.col("head.node").alias("head"))
    out = signed.drop("starts", "tokens").join(resolved, ["d1", "d2"], "left")
    return out.select(
        F.col("key").alias(key), "text_key", "n_shingles", F.when(F.col("head").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.coalesce("head", "uid") == F.col("uid")).alias("kept"),
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **parameters) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each class, with all its columns. Of rows with one key and text the first in order of their other columns stays."""
    kept = near_duplicates(docs, text=text, key=key, **parameters).where("kept").select(F.col(key).alias("kept_key"), F.col("text_key").alias("kept_text"))
    rows = docs.select(whole_row(docs), docs[key].cast("long").alias("own_key"), F.xxhash64(text_or_empty(text)).alias("own_text"))
    same = F.col("kept_key").eqNullSafe(F.col("own_key")) & (F.col("kept_text") == F.col("own_text"))
    found = rows.join(kept.groupBy("kept_key", "kept_text").agg(F.count("*").alias("copies")), same)
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns) if c != text]))
    once = found.withColumn("place", F.row_number().over(W.partitionBy("own_key", "own_text").orderBy(others))).where("place <= copies")
    return once.select("row.*")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a matrix. Tokens of one set only don't enter; the rest are counted in slices of bounded width."""
    k = len(sets)
    out = np.zeros((k, k), np.int64)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    column = np.cumsum(often) - 1
    use = often[at]
    owner, at = owner[use], column[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = max(1024, (16 << 20) // max(1, k))
    for low in range(0, int(often.sum()), width):
        a, z = np.searchsorted(at, [low, low + width])
        m = np.zeros((k, min(width, int(often.sum()) - low)), np.float32)
        m[owner[a:z], at[a:z] - low] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_shingles", "kept")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT uid, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT uid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT uid, count(*) AS n FROM s GROUP BY uid),
shared AS (SELECT x.uid AS a, y.uid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.uid <> y.uid GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.uid = a JOIN sizes y ON y.uid = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT uid, uid FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT r.a AS uid, min(d.doc_id) AS class_id FROM reach r JOIN d ON d.uid = r.b GROUP BY r.a),
deg AS (SELECT a AS uid, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, d.doc_id = class_id AS kept
FROM d JOIN comp USING (uid) LEFT JOIN deg USING (uid) LEFT JOIN sizes USING (uid)
"""
