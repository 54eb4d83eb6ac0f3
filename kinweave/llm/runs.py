"""Periodic runs of words: longest previous factors, the blocks that they cut a text into, extensions over block boundaries, and copies inside blocks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_rows, let, read, text_or_empty, whole_row

#: Words of short texts that are worked on together; a longer text is worked on alone.
TOGETHER = 1 << 18


def factor_ranks(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of several texts laid end to end, and ranks by level: two places of level k have equal ranks exactly if the same 2**k words of one text stand there.

    keys: a number of each word, different in each text and rising from text to text; ends: the end of the text that a place is in. Prefixes are doubled until no ranks are
    shared, and only places that share theirs are sorted again. Behind the last place each level holds -1.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    held, at, u, split = keys[order], np.arange(n), order, np.zeros(n, np.int64)
    rank, ranks, h = np.full(n + 1, -1, np.int64), [], 0
    while True:
        if h:
            behind = u + h
            held = split[at] * (n + 1) + np.where(behind < ends[u], rank[np.minimum(behind, n)], -1) + 1
            again = np.argsort(held, kind="stable")
            u, held = u[again], held[again]
            order[at] = u
        new = np.ones(len(u), bool)
        new[1:] = held[1:] != held[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(u)))
        place = np.repeat(at[first], sizes)
        rank = rank.copy()
        rank[u] = place
        split[at] = place
        ranks.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        shared = np.repeat(sizes > 1, sizes)
        if not shared.any():
            return order, ranks
        at, u, h = at[shared], u[shared], 2 * h or 1


def forward(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on are those from j on."""
    n = np.zeros(len(i), np.int64)
    live = np.flatnonzero(ranks[0][i] == ranks[0][j])
    a, b, m = i[live], j[live], np.zeros(len(live), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = (ranks[k][a + m] == ranks[k][b + m]).astype(np.int64) << k
        m += step
    n[live] = m
    return n


def backward(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i are those before j."""
    n = np.zeros(len(i), np.int64)
    inside = (i > 0) & (j > 0)
    live = np.flatnonzero(inside & (ranks[0][i - 1] == ranks[0][j - 1]))
    a, b, m = i[live], j[live], np.zeros(len(live), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a - m - (1 << k), b - m - (1 << k)
        step = ((x >= 0) & (y >= 0) & (ranks[k][np.maximum(x, 0)] == ranks[k][np.maximum(y, 0)])).astype(np.int64) << k
        m += step
    n[live] = m
    return n


def previous_factors(order: np.ndarray, ranks: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The longest previous factor at each place, and where it stood before.

    Places leave a list in suffix order from the last to the first, so those still in it stand before; of a place's two neighbours one shares
    the most with it. A word that stands once in its text has no such factor and isn't put into the list.
    """
    n = len(order)
    length, source = [0] * n, [0] * n
    own = ranks[0][order]
    beside = np.zeros(n, bool)
    beside[1:] = own[1:] == own[:-1]
    kept = np.flatnonzero(beside | np.append(beside[1:], False))
    if not len(kept):
        return length, source
    places = order[kept]
    shared = np.zeros(len(kept) + 1, np.int64)
    shared[1:-1] = forward(ranks, places[:-1], places[1:])
    m, by_place = len(kept), np.argsort(places)[::-1].tolist()
    left, before, after, places = shared.tolist(), [*range(-1, m - 1), 0], [*range(1, m + 1), 0], places.tolist()
    for r in by_place:
        p, q, a = before[r], after[r], left[r]
        b = left[q]
        if a >= b:
            if a:
                length[places[r]], source[places[r]] = a, places[p]
        else:
            length[places[r]], source[places[r]] = b, places[q]
            left[q] = a
        after[p], before[q] = q, p
    return length, source


def blocks_of(length: list[int]) -> np.ndarray:
    """Where blocks start: a block is the longest previous factor at its place, or a word that stands there first."""
    starts, i, n = [], 0, len(length)
    while i < n:
        starts.append(i)
        i += length[i] or 1
    return np.array(starts, np.int64)


def boundary_runs(ranks: list[np.ndarray], bounds: np.ndarray, before: np.ndarray, after: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs that touch a boundary; before and after are the lengths of the blocks on its two sides.

    A run's last block boundary b has either a period or more of it behind, which is then no longer than the block behind; or less, and then the block
    before holds the run from its second period to b, which is ``times`` - 2 periods or more. So periods that are longer needn't be tried, and those tried add up to the text's length.
    """
    found = []
    for behind, most in ((True, after), (False, before // (times - 2))):
        b = np.repeat(bounds, most)
        p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
        i, j = (b, b + p) if behind else (b - p, b)
        end = np.repeat(ends, most)
        fits = j <= end
        i, j, p = i[fits], j[fits], p[fits]
        first = ranks[0]
        near = (first[i] == first[j]) | ((i > 0) & (first[i - 1] == first[j - 1]))
        i, j, p = i[near], j[near], p[near]
        start, stop = i - backward(ranks, i, j), j + forward(ranks, i, j)
        long = stop - start >= np.maximum(least, times * p)
        found.append((start[long], stop[long], p[long]))
    start, stop, p = (np.concatenate([f[k] for f in found]) for k in range(3))
    by = np.lexsort((p, stop, start))
    start, stop, p = start[by], stop[by], p[by]
    # Of one stretch the smallest period counts; the others are its multiples.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return start[new], stop[new], p[new]


def copied(runs: dict[int, list[tuple[int, int]]], starts: list[int], lengths: list[int], sources: list[int], least: int) -> None:
    """Puts the runs that lie strictly inside a block into ``runs``, buckets of (end, period) by start: they are those inside the block's earlier occurrence, which are known already."""
    for b, l, src in zip(starts, lengths, sources, strict=True):
        d = b - src
        for s in range(src + 1, min(b, src + l - 1 - least) + 1):
            for e, p in runs.get(s, ()):
                # An occurrence that overlaps the block repeats what lies in its first d words.
                for k in range(1, (b + l - 1 - e) // d + 1 if e < src + l else 0):
                    runs[s + k * d].append((e + k * d, p))


def runs_of(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n, text_ends = int(lengths.sum()), np.cumsum(lengths)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not n:
        return out
    seen: dict[bytes, int] = {}
    words = np.array([seen.setdefault(w, len(seen)) for t in texts for w in t], np.int64)
    ends = np.repeat(text_ends, lengths)
    order, ranks = factor_ranks(np.repeat(np.arange(len(texts)), lengths) * len(seen) + words, ends)
    length, source = previous_factors(order, ranks)
    starts = blocks_of(length)
    sizes = np.diff(np.append(starts, n))
    # A text's end is a boundary as well, with nothing behind it.
    first = np.ones(len(starts), bool)
    first[1:] = ends[starts[1:]] != ends[starts[:-1]]
    before = np.where(first, 0, np.append(0, sizes[:-1]))
    last = np.append(first[1:], True)
    bounds, of = np.append(starts, (starts + sizes)[last]), np.append(ends[starts], ends[starts[last]])
    begin, stop, period = boundary_runs(ranks, bounds, np.append(before, sizes[last]), np.append(sizes, np.zeros(last.sum(), np.int64)), of, least, times)
    if not len(begin):
        return out
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, e, p in zip(begin.tolist(), stop.tolist(), period.tolist(), strict=True):
        buckets[s].append((e, p))
    text_of = np.searchsorted(text_ends, starts, side="right")
    with_runs = np.zeros(len(texts), bool)
    with_runs[np.searchsorted(text_ends, begin, side="right")] = True
    wide = np.flatnonzero((sizes >= least + 2) & with_runs[text_of])
    copied(buckets, starts[wide].tolist(), sizes[wide].tolist(), [source[i] for i in starts[wide].tolist()], least)
    for s in sorted(buckets):
        t = int(np.searchsorted(text_ends, s, side="right"))
        offset = int(text_ends[t] - lengths[t])
        out[t] += [(s - offset, e - s, p) for e, p in sorted(buckets[s], key=lambda x: x[1])]
    return out


def without_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return b" ".join(words)


def find(docs: DataFrame, least: int = 6, times: int = 4, key: str = "doc_id", text: str = "text", row: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_words, runs (array of start, length, period, by start, then period), collapsed (the text without what repeats).

    Words are what white space of ASCII parts. A run is a stretch of words with smallest period q whose neighbours don't have it, of ``least`` words and ``times`` periods or more.
    Texts of a batch are worked on together, up to TOGETHER words; each text whole and by one task, in memory of some 200 bytes a word. No row is moved.

    ``times`` is 3 or more. A null or blank text has no words and no runs, and collapses to an empty one. Repeated rows and null keys are rows of their own. With ``row``, all columns of
    a row come along as one struct, whatever their names are; other columns aren't read otherwise. An empty table gives no rows.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't looked for")

    def make():
        def step(batch):
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            runs, pack, held = [], [], 0
            for t in texts:
                if pack and held + len(t) > TOGETHER:
                    runs += runs_of(pack, least, times)
                    pack, held = [], 0
                pack.append(t)
                held += len(t)
            runs += runs_of(pack, least, times)
            return {
                key: batch.column(0), "n_words": [len(t) for t in texts], "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs],
                "collapsed": [without_runs(t, r) for t, r in zip(texts, runs, strict=True)],
            }

        return step

    wanted = [docs[f"`{key}`"].cast("long").alias(key), docs[f"`{text}`"].cast("string").alias("text_"), *([whole_row(docs)] if row else [])]
    return arrow_rows(docs.select(*wanted), make, f"`{key}` long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periodic ends in a tenth of the texts, picked by h = crc32(key): from word g % n on, g = h // 10, the next 1 + (n - a) // (3 + g % 8) words repeat. Null keys: none."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def ending(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        ends = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))))
        return F.when(n > 0, F.array_join(ends, " ")).otherwise("")

    changed = let(F.regexp_extract_all(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), ending)
    return docs.withColumn(text, F.when(h % 10 == 0, changed).otherwise(F.col(text)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(with_repeats(read(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # The greatest length, then the smallest start and period: the least of (-length, start, period).
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best = found.select("*", best.alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l DIV best.p").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
