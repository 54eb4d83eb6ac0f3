"""A vector index on disk: 8-bit codes, sign words and ranges are written once and searched for blocks of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions import vectors as V
from kinweave.operators import knn
from kinweave.operators.common import numbered, shared_folder
from kinweave.session import ship

FORMAT = 1
MANIFEST = "format int, rows long, width int, clipped long, ranges array<struct<lo: double, hi: double>>"
#: Bytes of a block of queries, which the driver holds and every worker gets; rows whose scores are worked out at once, and pairs that are scored one by one.
BLOCK_BYTES, ROWS, PAIRS = 1 << 21, 256, 1 << 14


@dataclass(frozen=True)
class Index:
    path: str
    rows: int
    width: int
    ranges: list[tuple[float, float]]
    #: Whether the sign words are there for every row; without them searches score all codes.
    signs: bool

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/codes")


def write(store: DataFrame, path: str, width: int, sample: int | None = knn.SAMPLE) -> None:
    """Writes ``store`` (id, row_idx, vector) to a new folder: ranges from a sample of rows that a hash picks, or from all of them, codes and signs in order of rows, and at last the manifest, without which nothing is an index.

    Vectors that are null, of another width, not finite or zero aren't searched for; they are left out.
    """
    spark = store.sparkSession
    valid = store.select("id", "row_idx", F.col("vector").cast("array<double>").alias("vector")).where(V.valid(F.col("vector"), width))
    ranges = knn.calibration(valid, sample)
    coded = knn.encoded(valid, ranges, width).select("id", "row_idx", "codes", "signs", "n_clipped")
    coded.repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/codes")
    n, clipped = spark.read.parquet(f"{path}/codes").agg(F.count("*"), F.coalesce(F.sum("n_clipped"), F.lit(0))).first()
    held = ranges.first() if n else None
    row = [(FORMAT, n, width, clipped, held["ranges"] if held else [])]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(f"{path}/manifest")


def opened(spark: SparkSession, path: str) -> Index:
    """The index of a folder, once its codes agree with its manifest; ValueError otherwise. Sign words that are missing, or not those of all rows, only cost the prefilter."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if manifest is None or manifest["format"] != FORMAT:
        raise ValueError("there is no vector index of this format")
    table = spark.read.parquet(f"{path}/codes")
    kinds = dict(table.dtypes)
    width = manifest["width"]
    words = -(-width // V.WORD_BITS)
    has_signs = kinds.get("signs") == "array<bigint>"
    signed = F.count_if(F.size("signs") == words) if has_signs else F.lit(-1)
    n, whole, places, told = table.agg(F.count("*"), F.count_if(F.size("codes") == width), F.count_distinct("row_idx"), signed).first()
    if (n, whole, places) != (manifest["rows"],) * 3 or (n and len(manifest["ranges"]) != width):
        raise ValueError("the vector index's codes aren't those of its manifest")
    return Index(path, n, width, [(r["lo"], r["hi"]) for r in manifest["ranges"]], has_signs and told == n)


def rebuilt(spark: SparkSession, path: str, new_path: str) -> None:
    """The index of a folder with its sign words made anew from the codes, in another folder."""
    index = opened(spark, path)
    ranges = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in index.ranges])
    signs = V.sign_words(V.dequantized(F.col("codes"), ranges), index.width)
    index.table(spark).drop("signs").withColumn("signs", signs).repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.option("compression", "zstd").parquet(f"{new_path}/codes")
    spark.read.schema(MANIFEST).json(f"{path}/manifest").coalesce(1).write.json(f"{new_path}/manifest")


class Best:
    """The rows of each query that come first by (-score, row), ``most`` of each (a number or one for each query); what is certain not to be among them isn't taken in."""

    def __init__(self, queries: int, most: np.ndarray | int) -> None:
        self.most = np.broadcast_to(np.asarray(most, np.int64), queries)
        self.floor = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.pruned = 0, 0

    def offer(self, query: np.ndarray, order: np.ndarray, row: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, order, row))
            self.size += len(query)
            if self.size > 2 * self.pruned + 4 * int(self.most.sum()) + 4096:
                self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        query, order, row = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        by = np.lexsort((row, -order, query))
        query, order, row = query[by], order[by], row[by]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        kept = place < self.most[query]
        last = place == self.most[query] - 1
        self.floor[query[last]] = order[last]
        self.parts = [(query[kept], order[kept], row[kept])]
        self.size = self.pruned = int(kept.sum())
        return self.parts[0]


def scanned(table: DataFrame, step: Callable[[], tuple[Callable[[pa.RecordBatch], None], Callable[[], dict]]], schema: str) -> DataFrame:
    """What a task tells after it has seen all its rows."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        see, told = step()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                see(batch.slice(at, ROWS))
        columns = told()
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return table.mapInArrow(run, kind)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def decoded(codes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Unit vectors of codes: centres of their buckets, the last code is the greatest value; shorter than the floor they stay short."""
    lo, hi = ranges[:, 0], ranges[:, 1]
    x = np.minimum(lo + (codes.astype(float) + 128.5) * ((hi - lo) / 255.0), hi)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.FLOOR)


def words_of(x: np.ndarray) -> np.ndarray:
    """Sign words of vectors, as ``vectors.sign_words`` makes them."""
    out = np.zeros((len(x), -(-x.shape[1] // V.WORD_BITS)), np.int64)
    for k in range(x.shape[1]):
        out[:, k // V.WORD_BITS] = out[:, k // V.WORD_BITS] * 2 + (x[:, k] > 0)
    return out


def distances(signs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each row and a column for each query."""
    return sum(np.bitwise_count(signs[:, None, w] ^ queries[None, :, w]).astype(np.int16) for w in range(signs.shape[1]))


def searched_block(index: Index, table: DataFrame, block: list[tuple], k: int, shortlist: int | None) -> DataFrame:
    """(query, row_idx, score) of the k best rows of each query of a block; with a shortlist, of the ``shortlist`` rows whose signs differ least, ties by row.

    Distances are counted by query first, so that each query's last distance and the number of ties to take are known before any row is scored; a task sends k rows of each query and the
    ties it may take.
    """
    spark = table.sparkSession
    vectors = np.array([v for _, v in block], float).reshape(len(block), index.width)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), V.FLOOR)
    sent = spark.sparkContext.broadcast((unit, words_of(vectors), np.array(index.ranges, float).reshape(-1, 2)))
    bins, kind = index.width + 1, "number long, row_idx long, score double"

    def count():
        held = np.zeros((len(block), bins), np.int64)

        def see(batch):
            d = distances(matrix(batch, "signs"), sent.value[1])
            held[:] += np.bincount((np.arange(len(block)) * bins + d).ravel(), minlength=held.size).reshape(held.shape)

        def told():
            number, distance = np.nonzero(held)
            return {"number": number, "distance": distance, "n": held[number, distance]}

        return see, told

    limits = None
    if shortlist is not None:
        counts = np.zeros((len(block), bins), np.int64)
        for r in scanned(table.select("signs"), count, "number long, distance int, n long").groupBy("number", "distance").agg(F.sum("n").alias("n")).collect():
            counts[r["number"], r["distance"]] = r["n"]
        before = np.cumsum(counts, axis=1)
        last = np.minimum((before < shortlist).sum(axis=1), bins - 1)
        limits = last, shortlist - np.where(last > 0, before[np.arange(len(block)), last - 1], 0)

    def score():
        sure = Best(len(block), k)
        tied = Best(len(block), 0 if limits is None else limits[1])
        scores_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def see(batch):
            row = batch.column(batch.schema.get_field_index("row_idx")).to_numpy()
            unit, words, ranges = sent.value
            x = decoded(matrix(batch, "codes"), ranges)
            if limits is None:
                # A product of matrices may differ in the last places for equal rows, so it only tells which pairs are near enough to be scored one by one.
                near, wanted = np.nonzero(x @ unit.T >= sure.floor - 1e-9)
                for at in range(0, len(near), PAIRS):
                    r, q = near[at : at + PAIRS], wanted[at : at + PAIRS]
                    s = np.clip(np.einsum("ij,ij->i", x[r], unit[q]), -1, 1)
                    above = s >= sure.floor[q]
                    sure.offer(q[above], s[above], row[r][above])
                return
            d = distances(matrix(batch, "signs"), words)
            r, q = np.nonzero(d < limits[0])
            s = np.clip(np.einsum("ij,ij->i", x[r], unit[q]), -1, 1)
            above = s >= sure.floor[q]
            sure.offer(q[above], s[above], row[r][above])
            # Ties come by row, so the row is what they are ordered by; their scores go along.
            r, q = np.nonzero(d == limits[0])
            early = -row[r].astype(float) >= tied.floor[q]
            r, q = r[early], q[early]
            tied.offer(q, -row[r].astype(float), row[r])
            scores_of.append((q, row[r], np.clip(np.einsum("ij,ij->i", x[r], unit[q]), -1, 1)))

        def told():
            q, s, row = sure.prune()
            out = [(q, row, s, np.zeros(len(q), bool))]
            q, _, row = tied.prune()
            if len(q):
                known = [np.concatenate([p[i] for p in scores_of]) for i in range(3)]
                by = np.lexsort((known[1], known[0]))
                base = int(max(known[1].max(), row.max())) + 1
                place = by[np.searchsorted(known[0][by] * base + known[1][by], q * base + row)]
                out.append((q, row, known[2][place], np.ones(len(q), bool)))
            return {n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("number", "row_idx", "score", "tie"))}

        return see, told

    wanted = ["row_idx", "codes"] + ([] if limits is None else ["signs"])
    found = scanned(table.select(*wanted), score, kind + ", tie boolean")
    if limits is not None:
        rest = spark.createDataFrame([(i, int(n)) for i, n in enumerate(limits[1])], "number long, rest long")
        place = F.row_number().over(W.partitionBy("number").orderBy("row_idx"))
        ties = found.where("tie").withColumn("place", place).join(F.broadcast(rest), "number").where("place <= rest").select("number", "row_idx", "score")
        found = found.where("NOT tie").select("number", "row_idx", "score").unionByName(ties)
    best = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "row_idx"))
    return found.select("number", "row_idx", "score").withColumn("place", best).where(F.col("place") <= k).drop("place")


def search(
    index: Index, queries: DataFrame, k: int, prefilter: bool = True, multiplier: int = knn.RESCORE_MULTIPLIER, floor: int = knn.RESCORE_FLOOR, eligible: DataFrame | None = None
) -> DataFrame:
    """(query, id, row_idx, score, rank): the k nearest rows of each of ``queries`` (query, vector) by cosine to decoded codes.

    The cut breaks ties by row, ranks are by score and id. With the prefilter only max(k * multiplier, floor, k) rows of the fewest different signs are scored; without usable sign words all are. ``eligible`` (id) are the rows
    that may be found, applied before anything is cut. Queries of another width, null, not finite or zero raise. Queries come to the driver and to the workers in blocks of BLOCK_BYTES; each block reads the codes once,
    and the signs once more, and what it found is written to the checkpoint folder, so that neither the plan nor a task grows with the queries.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    ship(spark)
    table = index.table(spark)
    if eligible is not None:
        table = table.join(eligible.select("id").distinct(), "id", "left_semi")
    checked = queries.select("query", F.when(V.valid(F.col("vector"), index.width), F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.lit("a query isn't a vector of the index's width"))).alias("vector"))
    per = max(1, BLOCK_BYTES // (8 * index.width))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    blocks = numbered(checked, [F.col("query")], "number").withColumn("block", F.floor((F.col("number") - 1) / per).cast("int"))
    blocks.repartitionByRange("block").write.parquet(f"{folder}/queries")
    held = spark.read.parquet(f"{folder}/queries")
    last = held.agg(F.max("block")).first()[0]
    kind = held.schema["query"].dataType.simpleString()
    shortlist = max(k * multiplier, floor, k) if prefilter and index.signs else None
    spark.createDataFrame([], f"query {kind}, row_idx long, score double").write.parquet(f"{folder}/found")
    for b in range(0 if last is None or not index.rows else last + 1):
        block = [(r["query"], r["vector"]) for r in held.where(F.col("block") == b).orderBy("number").collect()]
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"number long, query {kind}")
        searched_block(index, table, block, k, shortlist).join(F.broadcast(names), "number").select("query", "row_idx", "score").write.mode("append").parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found").join(index.table(spark).select("id", "row_idx"), "row_idx")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id", "row_idx"))
    return found.select("query", "id", "row_idx", "score", rank.alias("rank"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, hits, wanted): how many of the rows that ``truth`` names for a query were found."""
    hit = found.select("query", "row_idx", F.lit(1).alias("hit"))
    return truth.join(hit, ["query", "row_idx"], "left").groupBy("query").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("wanted"))
