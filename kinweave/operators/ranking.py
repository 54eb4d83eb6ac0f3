"""Reciprocal rank fusion of five lists about one focal record."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions import vectors as V
from kinweave.operators.common import ONE_TASK, cut, numbered, shared_folder
from kinweave.operators.knn import guarded, literal
from kinweave.session import ship

#: The constant of the fusion, the weight of its last list, and how many cosines and passages count.
RRF_K, FOCAL_REFERENCE_WEIGHT, CONTEXT_SIZE, MIN_CONTEXTS = 60, 0.5, 5, 2
LISTS = ("semantic", "reference_context", "direct", "recommended", "focal_reference")


#: References that are compared with the candidates at once, and candidates that a task compares with them at a time: their products are 32 MB.
BLOCK, ROWS = 16_384, 256


def with_row(df: DataFrame) -> DataFrame:
    """``df`` with row_, a number of each row that stays as it is, and its lineage cut."""
    return cut(df.withColumn("row_", F.monotonically_increasing_id()))


def greatest(x: np.ndarray, k: int, fold: int = 64) -> np.ndarray:
    """The k greatest numbers of each row, in any order; all of them if there are no more. Long rows are folded: the greatest are in the k columns of ``fold`` numbers whose maxima are the greatest."""
    n, width = x.shape
    if n and width % fold == 0 and width > 2 * k * fold:
        folded = x.reshape(n, fold, width // fold)
        at = np.argpartition(folded.max(axis=1), -k, axis=1)[:, -k:]
        x = np.take_along_axis(folded, at[:, None, :], axis=2).reshape(n, -1)
    return x if x.shape[1] <= k else np.partition(x, -k, axis=1)[:, -k:]


def with_nearest(rows: DataFrame, references: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (with id, unit and others) and top, their CONTEXT_SIZE largest cosines with references other than themselves, rounded to 12 places.

    The references are taken in blocks of at most ``block``, each of which is broadcast for one pass over ids and vectors. A pass writes the best that a row met to the checkpoint folder, and the best of all passes are
    the row's, so neither the plan nor a task grows with the references. The products are dense, so they are numpy's, over slices of Arrow batches.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = with_row(rows.repartition(2 * spark.sparkContext.defaultParallelism, "id"))
    held = with_row(references.where("unit IS NOT NULL").select("id", "unit"))
    placed = numbered(held.select("row_"), [F.asc("row_")], "place").select("row_", F.floor((F.col("place") - 1) / block).cast("int").alias("block"))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    held.join(placed, "row_").select("block", "id", "unit").repartitionByRange("block").write.parquet(f"{folder}/references")
    held = spark.read.parquet(f"{folder}/references")
    last = held.agg(F.max("block")).first()[0]
    if last is None:
        return rows.drop("row_").withColumn("top", F.array().cast("array<double>"))

    def compared(shared):
        def run(batches):
            ids, matrix = shared.value
            at = {i: n for n, i in enumerate(ids)}
            for whole in batches:
                for begin in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(begin, ROWS)
                    row, own, unit = (batch.column(batch.schema.get_field_index(c)) for c in ("row_", "id", "unit"))
                    x = np.full((len(own), matrix.shape[1]), np.nan)
                    valid = unit.is_valid().to_numpy(zero_copy_only=False)
                    if valid.any():
                        x[valid] = unit.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(valid.sum(), -1)
                    c = x @ matrix.T
                    c[np.isnan(x).any(axis=1)] = -np.inf
                    itself = [(n, at[i]) for n, i in enumerate(own.to_pylist()) if i in at]
                    if itself:
                        c[tuple(np.array(itself).T)] = -np.inf
                    best = greatest(c, CONTEXT_SIZE)
                    found = pa.array([[round(v, 12) for v in r if v > -np.inf] for r in best.tolist()], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([row, found], names=["row_", "top"])

        return run

    for b in range(last + 1):
        part = held.where(F.col("block") == b).select("id", "unit").toArrow().combine_chunks()
        unit = part["unit"].combine_chunks()
        matrix = unit.flatten().to_numpy(zero_copy_only=False).reshape(len(unit), -1)
        usable = ~np.isnan(matrix).any(axis=1)
        shared = spark.sparkContext.broadcast((part["id"].filter(pa.array(usable)).to_pylist(), matrix[usable]))
        rows.select("row_", "id", "unit").mapInArrow(compared(shared), "row_ long, top array<double>").write.mode("append").parquet(f"{folder}/top")
        shared.destroy()
    best = spark.read.parquet(f"{folder}/top")
    if last:
        best = best.groupBy("row_").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, CONTEXT_SIZE).alias("top"))
    return rows.join(best, "row_").drop("row_")


def features(candidates: DataFrame, document: list[float], query: list[float]) -> DataFrame:
    """candidates: id, vector, is_reference, cites_focal, recommendation_rank, contexts, influential. Adds cos_dd, cos_q, ctx, direct, eligible.

    ctx is the mean of the five largest cosines with references other than the candidate, and null if there are fewer.
    """
    unit = candidates.withColumn("unit", V.normalized(F.col("vector")))
    unit = unit.withColumns({"cos_dd": guarded(V.cosine(F.col("vector"), literal(document))), "cos_q": guarded(V.cosine(F.col("vector"), literal(query)))})
    near = with_nearest(unit, unit.where("is_reference"))
    mean = F.when(F.size("top") == CONTEXT_SIZE, F.round(F.aggregate(F.array_sort("top"), F.lit(0.0), lambda s, x: s + x) / CONTEXT_SIZE, 12))
    contexts, influence = F.coalesce("contexts", F.lit(0)), F.coalesce("influential", F.lit(False))
    return near.withColumn("ctx", mean).drop("unit", "top").withColumns({
        "direct": F.col("is_reference") | F.col("cites_focal"), "eligible": F.col("is_reference") & ((contexts >= MIN_CONTEXTS) | influence), "contexts": contexts, "influential": influence,
    })


def ranks(rows: DataFrame) -> DataFrame:
    """Adds rank_LIST, from 1, for each list that holds the candidate. A list of up to ONE_TASK candidates is numbered by one task, a larger one over ranges."""
    semantic = [F.desc("cos_dd"), F.desc("cos_q"), F.asc("id")]
    order = {
        "semantic": (F.lit(True), semantic), "reference_context": (F.col("ctx").isNotNull(), [F.desc("ctx"), F.desc("cos_q"), F.asc("id")]),
        "direct": (F.col("direct"), [F.desc("cos_dd"), F.asc("id")]), "recommended": (F.col("recommendation_rank").isNotNull(), [F.asc("recommendation_rank"), F.asc("id")]),
        "focal_reference": (F.col("eligible"), [F.desc("contexts"), F.desc("influential"), *semantic]),
    }
    rows = with_row(rows)
    n = rows.count()
    # Only what the lists are ordered by is sorted.
    keys = rows.select("row_", "id", "cos_dd", "cos_q", "ctx", "direct", "eligible", "contexts", "influential", "recommendation_rank")
    placed = keys
    for name, (member, order_of) in order.items():
        if n <= ONE_TASK:
            placed = placed.withColumn(f"rank_{name}", F.when(member, F.row_number().over(W.partitionBy(member).orderBy(*order_of))))
        else:
            place = numbered(keys.where(member), order_of, f"rank_{name}", n)
            placed = placed.join(place.select("row_", f"rank_{name}"), "row_", "left")
    return rows.join(placed.select("row_", *[f"rank_{name}" for name in order]), "row_").drop("row_")


def fused(rows: DataFrame) -> DataFrame:
    """Adds score, the sum of weight / (60 + rank) in the lists' order, and rank by score and id; list_ranks maps names to ranks."""

    def term(name: str) -> Column:
        weight = FOCAL_REFERENCE_WEIGHT if name == "focal_reference" else 1.0
        return F.coalesce(F.lit(weight) / (F.lit(float(RRF_K)) + F.col(f"rank_{name}")), F.lit(0.0))

    total = term(LISTS[0])
    for name in LISTS[1:]:
        total = total + term(name)
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"rank_{n}").alias("v")) for n in LISTS]), lambda e: e["v"].isNotNull())
    scored = rows.withColumns({"score": F.round(total, 15), "list_ranks": F.map_from_entries(entries)})
    scored = with_row(scored)
    place = numbered(scored.select("row_", "id", "score"), [F.desc("score"), F.asc("id")], "rank")
    return scored.join(place.select("row_", "rank"), "row_").drop("row_")


def rank_candidates(candidates: DataFrame, document: list[float], query: list[float]) -> DataFrame:
    return fused(ranks(features(candidates, document, query)))
