"""Whitening of embeddings: an exact mean, the Gramian of centred rows, its eigenvectors, and a projection of every row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import read
from kinweave.session import ship

#: Entries become whole numbers: floor(SCALE * entry) + OFFSET. Beyond LARGEST a double has no fraction and such numbers aren't exact.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 53)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: the number of rows, each place's sum, all eigenvalues from the greatest, and the eigenvectors kept, as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray


def whole_numbers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): the rows whose vector isn't null or empty and has finite entries only, as whole numbers."""
    v = F.col("v")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST))
    rows = vectors.select(vectors[f"`{key}`"].alias("key"), vectors[f"`{vector}`"].cast("array<double>").alias("v"))
    return rows.select("key", F.when((F.size(v) > 0) & fits, F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)).alias("x")).where("x IS NOT NULL")


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the length that most have (of several, the greatest), and that length."""
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("x") == d), d


def covariance(centred: DataFrame, n: int) -> np.ndarray:
    """Of rows that are centred already, an array of doubles each: their Gramian, summed up over tasks as a tree, divided by n."""
    features = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(centred[centred.columns[0]]).alias("v")), "v")
    return RowMatrix(features).computeGramianMatrix().toArray() / n


def doubles(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fit(rows: DataFrame, d: int, components: int) -> Whitening | None:
    """The whitening of rows (key, x); None without rows. Sums and the mean are exact; each centred entry (n * x - sum) / n is rounded once.

    Only sums and the d x d covariance come to the driver. Eigenvalues that can't be told from 0 in double precision give no component.
    """
    summed = rows.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("place").collect()
    if not summed:
        return None
    n, sums = summed[0]["n"], [int(r["s"]) for r in summed]
    whole = lambda s: F.lit(s).cast("decimal(38,0)")
    exact = F.zip_with("x", F.array(*[whole(s) for s in sums]), lambda x, s: ((x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)")).cast("decimal(38,0)") - s).cast("double") / n)
    values, vectors = np.linalg.eigh(covariance(rows.select(exact.alias("y")), n))
    values, vectors = values[::-1], vectors[:, ::-1]
    told = int((values > max(values[0], 0.0) * d * np.finfo(float).eps).sum())
    return Whitening(n, sums, values, vectors[:, : min(components, told)])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums as whole numbers, and their sums of squares by row, without overflow: in 64 bits if all fit, else in Python's numbers."""
    largest = float(np.abs(x.astype(float)).max(initial=0)) * n + max((abs(s) for s in sums), default=0)
    off = n * x - np.array(sums, np.int64) if largest < 2.0**62 else n * x.astype(object) - np.array(sums, object)
    if float(max(abs(off.max(initial=0)), abs(off.min(initial=0)))) ** 2 * max(1, x.shape[1]) >= 2.0**62:
        off = off.astype(object)
    return off.astype(float), (off * off).sum(axis=1)


def projected(rows: DataFrame, fitted: Whitening, error: float | None = None) -> DataFrame:
    """Rows (key, deviation, whitened) by a broadcast of the whitening; ``deviation`` is null where it doesn't fit into a long."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        axes = w.vectors / np.sqrt(w.values[: w.vectors.shape[1]]) / w.n
        for batch in batches:
            if len(batch):
                off, squares = deviations(np.stack(batch["x"].to_numpy()), w.n, w.sums)
                fits = [int(q) if int(q) < 1 << 63 else None for q in squares.tolist()]
                yield pd.DataFrame({"key": batch["key"], "deviation": pd.array(fits, "Int64"), "whitened": list(off @ axes)})

    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened``, centred, less the identity."""
    place = white.select(F.posexplode("whitened").alias("place", "w")).groupBy("place").agg(F.avg("w").alias("m")).orderBy("place").collect()
    centred = white.select(F.zip_with("whitened", doubles(np.array([r["m"] for r in place])), lambda w, m: w - m).alias("y"))
    return float(np.abs(covariance(centred, n) - np.eye(components)).max())


def whiten(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors``: key, n, deviation, whitened (an entry for each component), explained (likewise), identity_error.

    Entries c are taken as floor(64 * c) + 1,000,000; n rows with sums S are all that are fitted. ``deviation`` is the exact sum of (n * x - S) ** 2, null if a long can't hold it. ``whitened`` is x - S / n on the
    unit eigenvectors of the covariance (divisor n), by falling eigenvalue, over the eigenvalue's root; ``explained`` are eigenvalues as shares of all. ``identity_error`` tells how far the covariance of
    ``whitened`` is from the identity. Rows aren't shuffled; what is gathered grows with the number of entries of a vector alone.

    Vectors that are null, empty, or hold entries that are null, not finite or 2**47 and more are left out, and so are all of another length than most have (of several, the greatest). Components whose
    eigenvalue is 0 in double precision don't exist: equal vectors, or a single one, have none. Repeated rows count as often as they stand; a null key stays null. Without usable rows the result is empty.
    """
    rows, d = of_one_length(whole_numbers(vectors, key, vector))
    fitted = fit(rows, d, components) if d else None
    if fitted is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    kept = fitted.vectors.shape[1]
    white = projected(rows, fitted)
    error = identity_error(white, fitted.n, kept) if kept else 0.0
    explained = fitted.values[:kept] / fitted.values.sum() if kept else np.array([])
    return white.select(F.col("key").alias(key), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", doubles(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(read(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("place")).alias("explained"), "identity_error")
