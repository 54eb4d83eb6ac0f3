"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import FOLD, WORD, arrow_rows, checkpointed, read, text_or_empty, whole_row

find_words = re.compile(WORD).findall


def words(text: str) -> list[str]:
    return find_words(text.translate(FOLD) if not text.isascii() else text.lower())


class Search:
    """All places of the windows of some texts: runs of ``window`` words, or all words of a text that has fewer.

    Windows of one length m share tables, and are known by their place in the texts' words, which are held once. A block is two words
    (one, if m is 1). ``shift`` tells how far the search may move when a block stands at a window's end: blocks that no window has
    allow m - 1. Where the shift is 0 the bucket of the last and first block names the few windows that are compared word by word.
    """

    def __init__(self, texts: Iterable[tuple[str | None, str]], window: int):
        self.words: list[str] = []
        self.begins: list[int] = []
        self.names: list[str | None] = []
        self.more: dict[int, list[str]] = {}
        tables: dict[int, tuple[dict[str, int], dict[int, list[int]]]] = {}
        for name, text in texts:
            own = words(text)
            if not own:
                continue
            at, m = len(self.words), min(len(own), window)
            self.begins.append(at)
            self.names.append(name)
            self.words += own
            b = min(2, m)
            shift, buckets = tables.setdefault(m, ({}, {}))
            blocks = own if b == 1 else [*map(" ".join, zip(own, own[1:], strict=False))]
            for i, block in enumerate(blocks):  # the soonest that a window which holds the block can end
                shift[block] = min(shift.get(block, m), max(0, m - b - i))
            for i in range(len(own) - m + 1):
                bucket = buckets.setdefault(hash((blocks[i + m - b], blocks[i])), [])
                same = next((p for p in bucket if self.words[p : p + m] == own[i : i + m]), None)
                if same is None:
                    bucket.append(at + i)
                elif name is not None and name not in self.owners(same)[-1:]:
                    self.more.setdefault(same, []).append(name)
        self.tables = [(m, min(2, m), *tables[m]) for m in sorted(tables)]

    def owners(self, place: int) -> list[str]:
        """The names of the texts that hold the window at ``place``."""
        name = self.names[bisect.bisect_right(self.begins, place) - 1]
        return ([name] if name is not None else []) + self.more.get(place, [])

    def places(self, text: list[str]) -> list[tuple[int, int, int]]:
        """(start, length, the window's place) of every occurrence."""
        found = []
        n = len(text)
        for m, b, shift, buckets in self.tables:
            if n < m:
                continue
            blocks = text if b == 1 else [*map(" ".join, zip(text, text[1:], strict=False))]
            get, beyond, end = shift.get, m - b + 1, m - b
            last = n - b
            while end <= last:
                step = get(blocks[end], beyond)
                if step:
                    end += step
                    continue
                start = end - m + b
                for p in buckets.get(hash((blocks[end], blocks[start])), ()):
                    if text[start : start + m] == self.words[p : p + m]:
                        found.append((start, m, p))
                end += 1
        return found


_built: dict[str, Search] = {}


def built(block: str, texts: Callable[[], list[tuple[str | None, str]]], window: int) -> Search:
    """The tables of a block; a worker process keeps those that it met last."""
    if block not in _built:
        _built.clear()
        _built[block] = Search(texts(), window)
    return _built[block]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id", block_bytes: int = 4 << 20, row: bool = False
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated, starts, ends, items and, if asked, row, a struct of all its columns.

    The benchmark is the stated query set. It is searched in blocks of about ``block_bytes`` bytes of its texts, which is what the
    driver holds at once; a worker holds a block's tables, of some 50 times that size, and builds them once for all its tasks. Every
    document meets every block, without a shuffle; between blocks the rows are written to the checkpoint folder. starts and ends are those of the merged runs of hit words, as word positions with exclusive ends.

    Null texts have no words, nor do null items. A null item id stands for no item: its windows hit words, and it's in no list.
    Items that have the same id are one item. An empty benchmark hits nothing. Other columns aren't read.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_or_empty("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    schema = "key long, text string, n_words long, starts array<int>, ends array<int>, items array<string>"
    out = docs.select(
        docs[key].cast("long").alias("key"), text_or_empty(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("items"), *[whole_row(docs)][:row],
    )
    context = docs.sparkSession.sparkContext
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared, name = context.broadcast([(r[0], r[1]) for r in part.toLocalIterator()]), uuid.uuid4().hex

        def make(shared=shared, name=name):
            search = built(name, lambda: shared.value, window)

            def step(batch):
                n_words, starts, ends, found = [], [], [], []
                for body, s, e, i in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True):
                    text = words(body)
                    n_words.append(len(text))
                    places = search.places(text)
                    if places:
                        spans = sorted([*zip(s, e, strict=True), *((at, at + m) for at, m, _ in places)])
                        s, e = [spans[0][0]], [spans[0][1]]
                        for a, z in spans[1:]:
                            if a > e[-1]:
                                s.append(a)
                                e.append(z)
                            elif z > e[-1]:
                                e[-1] = z
                        i = sorted({*i, *(x for p in {p for *_, p in places} for x in search.owners(p))})
                    starts.append(s)
                    ends.append(e)
                    found.append(i)
                return {"key": batch.column(0), "text": batch.column(1), "n_words": n_words, "starts": starts, "ends": ends, "items": found}

            return step

        out = arrow_rows(out, make, schema)
        if block + 1 < blocks:  # else each block would hold a Python worker of every task at once
            out = checkpointed(out)

    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda n, x: n + x)
    return out.select(
        F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"), "starts", "ends", "items", *["row"][:row],
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS pattern
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM p),
g AS (
  SELECT uid, m, i, array_to_string(w[i : i + m - 1], ' ') AS pattern
  FROM (SELECT uid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)
), hits AS (SELECT g.uid, g.i, g.m, p.item FROM g JOIN p ON g.pattern = p.pattern AND g.m = p.m),
hit_words AS (SELECT uid, count(DISTINCT pos) AS n_hit FROM (SELECT uid, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT uid, i, m FROM hits)) GROUP BY uid),
hit_items AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM hits WHERE item IS NOT NULL) GROUP BY uid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (uid) LEFT JOIN hit_items USING (uid)
"""
