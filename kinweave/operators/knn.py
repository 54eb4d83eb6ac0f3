"""Nearest neighbours of one query vector: exact, over int8 codes, and by a Hamming shortlist that is rescored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import vectors as V

RESCORE_MULTIPLIER, RESCORE_FLOOR, SAMPLE = 8, 512, 2000


def literal(values: list[float]) -> Column:
    return F.lit([float(x) for x in values])


def top_k(scored: DataFrame, k: int, score: str = "score", row: str = "row_idx", key: str = "id") -> DataFrame:
    """The k best rows: the cut breaks ties by physical row, the returned order by key. A sort with a limit keeps k rows of each task."""
    if k < 1:
        raise ValueError("k must be positive")
    return scored.orderBy(F.desc(score), F.asc(row)).limit(k).orderBy(F.desc(score), F.asc(key))


def guarded(score: Column) -> Column:
    """Spark sorts NaN above all numbers, so a score that isn't finite is an error."""
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), F.raise_error(F.lit("a score isn't finite"))).otherwise(score)


def exact(store: DataFrame, query: list[float], k: int, vector: str = "vector") -> DataFrame:
    """store: id, row_idx, vector and others. Rows with the greatest cosine to the query."""
    return top_k(store.withColumn("score", guarded(V.cosine(F.col(vector), literal(query)))), k)


def calibration(store: DataFrame, sample: int | None = SAMPLE, key: str = "id", vector: str = "vector") -> DataFrame:
    """One row, ranges: array<struct<lo, hi>> over a sample of rows that a hash of their key picks, the same on every run; without a size, over all rows."""
    picked = store.select(vector) if sample is None else store.select(key, vector).orderBy(F.xxhash64(key), key).limit(sample)
    by_place = picked.select(F.posexplode(vector).alias("place", "x")).groupBy("place").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))), lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))
    return by_place.agg(ranges.alias("ranges")).select(V.sanitized(F.col("ranges")).alias("ranges"))


def encoded(store: DataFrame, ranges: DataFrame, width: int, vector: str = "vector") -> DataFrame:
    """``store`` with codes, the signs of what they decode to, and the number of clipped values. ``ranges`` is one row, whose size is the vectors' width."""
    both = store.crossJoin(F.broadcast(ranges))
    both = both.withColumn("codes", V.quantized(F.col(vector), F.col("ranges"))).withColumn("n_clipped", V.clipped(F.col(vector), F.col("ranges")))
    return both.withColumn("signs", V.sign_words(V.dequantized(F.col("codes"), F.col("ranges")), width))


def quantized(store: DataFrame, query: list[float], k: int) -> DataFrame:
    """As ``exact``, on decoded codes."""
    return top_k(store.withColumn("score", guarded(V.cosine(V.dequantized(F.col("codes"), F.col("ranges")), literal(query)))), k)


def shortlist(store: DataFrame, query: list[float], m: int) -> DataFrame:
    """The m rows whose signs differ least from the query's, ties by physical row."""
    signs = V.sign_words(literal(query), len(query))
    return store.withColumn("distance", V.hamming(F.col("signs"), signs)).orderBy("distance", "row_idx").limit(m)


def prefiltered(store: DataFrame, query: list[float], k: int, multiplier: int = RESCORE_MULTIPLIER, floor: int = RESCORE_FLOOR) -> DataFrame:
    """A Hamming shortlist of max(k * multiplier, floor, k) rows, rescored on decoded codes."""
    return quantized(shortlist(store, query, max(k * multiplier, floor, k)), query, k)


def recall(found: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    hits = found.select(key).join(truth.select(key), key, "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(F.broadcast(truth.agg(F.count("*").alias("wanted")))).select("hits", "wanted", (F.col("hits") / F.col("wanted")).alias("recall"))
