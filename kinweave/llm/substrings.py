"""Substring dedup by content-defined chunks: a gear rolling hash sets the cuts, chunks that stand in two documents are the only candidates, and passages are measured exactly on windows of words around them."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_rows, let, read, running, text_or_empty, written

GEAR = np.random.default_rng(31_337).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
#: A digest with more than one of so many chunks is known to every task, and its chunks are counted apart, by partial sums; there are no more than HOT_SHARE of them.
HOT_SHARE = 1000


def rolling(data: np.ndarray, reach: int) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + GEAR[byte] over the last ``reach`` bytes, a power of two up to 32. Sums are doubled."""
    h, s = GEAR[data], 1
    while s < min(reach, len(h)):
        out = h.copy()
        out[s:] += h[:-s] << np.uint32(s)
        h, s = out, s * 2
    return h


def window_sizes(min_words: int) -> tuple[int, int]:
    """The bytes that a hash tells of, and the words of which one ends a chunk, so that equal windows of ``min_words`` words hold a whole chunk in common, wherever they stand.

    A hash of R bytes is that of the window alone from its word R / 2 on, as a word and what follows it have two bytes or more. A word's place among those of w windows of w words is then told
    by the window alone if w - 1 such words are on both sides, and 2 * w of these hold two cuts. So 4 * w + R / 2 - 2 words are enough.
    """
    reach = 1 << max(0, min(5, (2 * min_words // 3).bit_length() - 1))
    return reach, max(1, (min_words + 2 - reach // 2) // 4)


def slid(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    return best(values[: len(values) - (width - done)], values[width - done :])


def last_words(data: np.ndarray, end: np.ndarray, reach: int, width: int) -> np.ndarray:
    """The words after which a chunk ends: those whose hash is the greatest of some ``width`` words in a row, the last of equals.

    Any ``width`` words hold one. A word's choice depends on the words and bytes around it alone, so an insertion changes the chunks near it and no others.
    """
    if len(end) < width:
        return np.zeros(0, np.int64)
    keys = (rolling(data, reach)[end - 1].astype(np.uint64) << np.uint64(32)) | np.arange(len(end), dtype=np.uint64)
    chosen = np.zeros(len(end), bool)
    chosen[(slid(keys, width, np.maximum) & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


SPACE, CORE = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places [start, end) of the words between white space, without the signs before and after a word's letters and digits."""
    edge = np.diff(np.concatenate([[0], (~SPACE[data]).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    core = np.flatnonzero(CORE[data])
    if not len(core):
        return start, end
    first = core[np.minimum(np.searchsorted(core, start), len(core) - 1)]
    last = core[np.maximum(np.searchsorted(core, end) - 1, 0)]
    has = (first >= start) & (first < end)
    return np.where(has, first, start), np.where(has, last + 1, end)


def cuts(data: np.ndarray, end: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Byte places at which chunks start, and the length at the end: chunks cover the text."""
    return np.unique(np.concatenate([[0], end[last], [len(data)]]))


def code_points(data: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int32)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """95 bits of the XXH3 digests of the byte ranges."""
    of = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([of(raw[i:j]) for i, j in zip(start.tolist(), end.tolist(), strict=True)]), ">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64).view(np.int64), (both[:, 1] >> np.uint64(33)).astype(np.int32)


def layout(data: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Word starts and ends, chunk cuts, and for each window of ``min_words`` words its own chunks [first, stop), those that its words alone tell.

    A window's own hashes start ``reach`` bytes after it does, and its own choices ``width`` - 1 words further and as many before its end. Chunk k + 1 lies between the chosen words k and k + 1.
    """
    reach, width = window_sizes(min_words)
    start, end = words(data)
    last = last_words(data, end, reach, width)
    s = np.arange(max(0, len(start) - min_words + 1))
    lo = np.searchsorted(end, start[: len(s)] + reach) + width - 1
    first, stop = np.searchsorted(last, lo) + 1, np.searchsorted(last, s + min_words - width, side="right")
    return start, end, cuts(data, end, last), first, stop


def chunked(docs: DataFrame, min_words: int, text: str, key: str) -> DataFrame:
    """One row per row of ``docs``: uid, key, text and its chunks in order: digest, code points, and how many chunks from it on are the fewest that a window has for its own (0: none starts with it)."""

    def make():
        def step(batch):
            found = []
            for t in batch.column(2).to_pylist():
                raw = t.encode()
                data = np.frombuffer(raw, np.uint8)
                if not raw:
                    found.append([])
                    continue
                _, _, at, first, stop = layout(data, min_words)
                need = np.zeros(len(at), np.int64)
                i = np.flatnonzero(stop > first)
                f, n = np.unique(first[i], return_index=True)
                need[f] = stop[i][n] - f
                chars = np.diff(code_points(data)[at])
                found.append([{"a": x, "chars": y, "need": z} for x, y, z in zip(digests(raw, at[:-1], at[1:])[0].tolist(), chars.tolist(), need.tolist(), strict=False)])
            return {"uid": batch.column(0), "key": batch.column(1), "text": batch.column(2), "chunks": found}

        return step

    given = docs.select(F.monotonically_increasing_id(), docs[f"`{key}`"].cast("long"), text_or_empty(f"`{text}`"))
    return arrow_rows(given, make, "uid long, key long, text string, chunks array<struct<a: bigint, chars: int, need: int>>", rows=100)


def candidates(raw: bytes, repeated: list[int], min_words: int) -> list[tuple]:
    """Runs (gram, a, b, start, end, at, n) of windows of ``min_words`` words that may stand in another document: n windows from word ``at`` on.

    Equal windows have the same own chunks. One may stand elsewhere if all of them do. Its gram is the least of their digests; windows of a run have one gram, and the run's digest (a, b)
    is that of all its words.
    """
    data = np.frombuffer(raw, np.uint8)
    start, end, at, first, stop = layout(data, min_words)
    n = len(first)
    if not n:
        return []
    most = np.iinfo(np.uint64).max
    stands = np.zeros(len(at) - 1, bool)
    stands[repeated] = True
    digest = np.full(len(stands), most, np.uint64)
    own = np.flatnonzero(stands)
    digest[own] = digests(raw, at[own], at[own + 1])[0].view(np.uint64)
    some = stop > first
    count = np.concatenate([[0], np.cumsum(stands)])
    near = some & (count[np.where(some, stop, 0)] - count[np.where(some, first, 0)] == stop - first)
    if not near.any():
        return []
    grams = np.full(n, most, np.uint64)
    level, rows = digest, np.flatnonzero(near)
    step = 1
    while len(rows):
        mine = (stop - first)[rows] < 2 * step
        i = rows[mine]
        grams[i] = np.minimum(level[first[i]], level[stop[i] - step])
        rows = rows[~mine]
        level = np.minimum(level, np.concatenate([level[step:], np.full(min(step, len(level)), most, np.uint64)]))
        step *= 2
    edge = np.flatnonzero((grams[1:] != grams[:-1]) | (near[1:] != near[:-1])) + 1
    begin, stop_at = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    begin, stop_at = begin[near[begin]], stop_at[near[begin]]
    z = stop_at - 1 + min_words - 1
    a, b = digests(raw, start[begin], end[z])
    c = code_points(data)
    return list(zip(grams[begin].view(np.int64).tolist(), a.tolist(), b.tolist(), c[start[begin]].tolist(), c[end[z]].tolist(), begin.tolist(), (stop_at - begin).tolist(), strict=True))


RUN = ("gram", "a", "b", "start", "end", "at", "n")


def runs_of(rows: DataFrame, min_words: int) -> DataFrame:
    """The runs of ``candidates`` of rows (uid, text, repeated), one a row."""

    def make():
        def step(batch):
            out = []
            for uid, t, repeated in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out += [(uid, *r) for r in candidates(t.encode(), repeated, min_words)]
            return dict(zip(("uid", *RUN), map(list, zip(*out, strict=True)), strict=True)) if out else None

        return step

    return arrow_rows(rows.select("uid", "text", "repeated"), make, "uid long, gram long, a long, b int, start int, end int, at int, n int", rows=100)


def windows_of(rows: DataFrame, min_words: int) -> DataFrame:
    """The windows of some runs, one a row: uid, digest (a, b), start and end. rows: uid, text, runs (array of at and n)."""

    def make():
        def step(batch):
            parts = []
            for uid, t, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = t.encode()
                data = np.frombuffer(raw, np.uint8)
                start, end = words(data)
                i = np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in runs])
                a, b = digests(raw, start[i], end[i + min_words - 1])
                c = code_points(data)
                parts.append((np.full(len(i), uid), a, b, c[start[i]], c[end[i + min_words - 1]]))
            return {n: np.concatenate([p[k] for p in parts]) for k, n in enumerate(("uid", "a", "b", "start", "end"))} if parts else None

        return step

    return arrow_rows(rows.select("uid", "text", "runs"), make, "uid long, a long, b int, start int, end int", rows=100)


def joined(spans: Column) -> Column:
    """Sorted spans, of which those that overlap or touch are one."""

    def of(far: Column) -> Column:  # far: how far the spans before each reach
        begins = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > F.get(far, i)), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda i, n: F.struct(F.get(spans, i)["start"].alias("start"), F.get(far, F.coalesce(F.get(b, n + 1), F.size(spans))).alias("end"))))

    return let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest), of)


def repeats(docs: DataFrame, min_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_chunks, n_repeated, repeated_chars, has_repeat, first_copy, passages and removable.

    A chunk is repeated if its digest stands in another document; everything else follows from those. Passages are exact and don't depend on the cuts: every window
    of ``min_words`` words that another document holds, byte for byte, belongs to one, and passages lists [start, end) code points
    of such windows, those that overlap as one. has_repeat tells that there is a passage. removable are the parts whose windows' first
    copy stands in an earlier row; dropping those leaves a copy of each word of the passages. first_copy tells that there are passages and that
    none of them is removable.

    Equal windows have the same chunks inside, one at least (see ``window_sizes``), so only windows all of whose chunks are repeated are looked at, in runs that have one least chunk. Runs are
    compared first, as wholes: where another document has the run, all its windows repeat. The windows of a chunk that stands in
    different runs are compared one by one, but those of a run that many documents have only once, in the first of them.

    Null and empty texts have one empty chunk, which repeats nothing. Repeated rows are documents of their own. Other
    columns aren't read; an empty table gives no rows. Digests are counted before they meet, so a passage that a third of all
    documents hold is a few rows of each task, and others share one shuffle of 64-bit digests. Texts are written once, with their chunks, and those that hold a window of repeated chunks are read back.
    """
    rows = written(chunked(docs, min_words, text, key))
    twice = lambda df, *by: df.groupBy(*by).agg(F.min("uid").alias("first"), F.max("uid").alias("last"))
    place = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("x.chars").cast("long"))
    chunks = rows.select("uid", F.posexplode_outer("chunks").alias("i", "x")).where("i IS NOT NULL").select("uid", place.alias("place"), F.col("x.a").alias("a"))
    frequent = rows.select(F.explode_outer("chunks.a").alias("a")).agg(F.count("a").alias("total"), F.expr(f"approx_top_k(a, {HOT_SHARE}, {10 * HOT_SHARE})").alias("top"))
    hot = written(frequent.select(F.explode("top").alias("t"), "total").where(F.col("t.count") * HOT_SHARE > F.col("total")).select(F.col("t.item").alias("a"), F.lit(True).alias("hot")))
    marked = chunks.join(F.broadcast(hot), "a", "left")
    own = marked.where("hot").select("uid", "place", "a")
    often_hot = own.join(F.broadcast(twice(own, "a").where("first < last").select("a")), "a")
    # One exchange serves the counts and the chunks that they are joined with: no digest left is frequent.
    cold = marked.where("hot IS NULL").select("uid", "place", "a").repartition("a")
    often_cold = cold.join(twice(cold, "a").where("first < last").select("a"), "a")
    flags = often_hot.select("uid", "place").unionByName(often_cold.select("uid", "place")).groupBy("uid").agg(F.array_sort(F.collect_list("place")).alias("places"))
    low = F.lit((1 << 32) - 1)
    flags = written(flags.select("uid", F.transform("places", lambda p: F.shiftright(p, 32).cast("int")).alias("repeated"), F.aggregate("places", F.lit(0).cast("long"), lambda t, p: t + p.bitwiseAND(low)).alias("chars")))
    # Texts that hold no window all of whose own chunks are repeated aren't read again.
    needed = lambda f: F.get("chunks", f)["need"]
    whole_window = F.exists(F.transform("repeated", lambda f, p: (needed(f) > 0) & F.coalesce(F.get("repeated", p + needed(f) - 1) == f + needed(f) - 1, F.lit(False))), lambda x: x)
    told = rows.select("uid", "text", F.transform("chunks", lambda x: F.struct(x["need"].alias("need"))).alias("chunks")).join(flags.select("uid", "repeated"), "uid").where(whole_window).select("uid", "text", "repeated")
    runs = written(runs_of(told, min_words))
    wholes = written(twice(runs, "gram", "a", "b"))
    various = wholes.groupBy("gram").agg((F.count("*") > 1).alias("various"))
    whole = runs.join(wholes.where("first < last").select("gram", "a", "b", "first"), ["gram", "a", "b"])
    alone = wholes.join(various.where("various"), "gram").select("gram", "a", "b", F.col("first").alias("uid"))
    chosen = runs.join(alone, ["gram", "a", "b", "uid"]).groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    windows = written(windows_of(rows.select("uid", "text").join(chosen, "uid"), min_words))
    same = windows.join(twice(windows, "a", "b").where("first < last").select("a", "b", "first"), ["a", "b"])
    span = F.struct("start", "end", (F.col("first") < F.col("uid")).alias("later"))
    found = whole.select("uid", span.alias("s")).unionByName(same.select("uid", span.alias("s"))).groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("s"))
    later = F.filter("s", lambda w: w["later"])
    found = found.select("uid", joined(F.col("s")).alias("passages"), let(later, joined).alias("removable"))
    heads = rows.select("uid", "key", F.greatest(F.size("chunks"), F.lit(1)).cast("long").alias("n_chunks")).join(flags.select("uid", F.size("repeated").cast("long").alias("n_repeated"), F.col("chars").alias("repeated_chars")), "uid", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (
        heads.join(found, "uid", "left")
        .select(
            F.col("key").alias(key), "n_chunks", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"), F.coalesce("repeated_chars", F.lit(0)).cast("long").alias("repeated_chars"),
            F.col("passages").isNotNull().alias("has_repeat"), F.coalesce(F.size("removable") == 0, F.lit(False)).alias("first_copy"),
            F.coalesce("passages", none).alias("passages"), F.coalesce("removable", none).alias("removable"),
        )
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    found = repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chunks", "n_repeated", "repeated_chars", "has_repeat", "first_copy", spans("passages").alias("passages"), spans("removable").alias("removable"))
