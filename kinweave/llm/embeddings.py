"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_rows, checkpointed, read
from kinweave.llm.pairs import Forest, block_pairs, components, grouped_arrow
from kinweave.session import ship

KEY_BITS = 64


#: Windows that are tried, in doublings of the smallest; steps in which chances are counted, to a halving.
DOUBLINGS, STEPS = 7, 16
#: The share of neighbours in order that no edge of a task parts, at least; what a row costs in a pass besides its comparisons, in comparisons.
UNPARTED, PASS_COST = 0.9, 150


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def sign_keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Signs of ``x`` towards KEY_BITS planes as longs, in the order of the bits."""
    weights = np.uint64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.uint64)
    return (((x @ planes >= 0) * weights).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that keys have in common."""
    other = (a ^ b).view(np.uint64)
    high, low = (np.frexp(part.astype(np.float64))[1] for part in (other >> np.uint64(32), other & np.uint64(0xFFFFFFFF)))
    return KEY_BITS - np.where(high > 0, 32 + high, low)


def bit_chance(x: np.ndarray, mean: np.ndarray, threshold: float) -> np.ndarray:
    """How likely each of the unit vectors ``x`` shares a sign with another at the threshold, once both are centred: 1 - angle / pi. The other stands off in a direction that is square to the mean."""
    along, square = (x * mean).sum(axis=1), (mean * mean).sum(axis=1)
    size = np.maximum(np.linalg.norm(x - mean, axis=1), 1e-12)
    other = np.sqrt(np.maximum(1 - 2 * threshold * along + square, 1e-24))
    return 1 - np.arccos(np.clip((threshold - (1 + threshold) * along + square) / (size * other), -1, 1)) / math.pi


def bits_needed(label: np.ndarray, key: np.ndarray, x: np.ndarray, size: int, threshold: float) -> np.ndarray:
    """With how many leading bits in common another vector is within ``size`` places of each, in rows sorted by label and key.

    That is one more than the vectors ``size`` places off share with it, if they are of its label; vectors that link are no crowd, as they are of one component. Where the
    task ends before that, its last vector stands for the one behind, which shares no more.
    """
    n = len(key)
    at, need = np.arange(n), np.zeros(n, np.int64)
    for off in (-size, size):
        there = np.clip(at + off, 0, n - 1)
        crowd = (label[there] == label) & (there != at)
        i, j = at[crowd], there[crowd]
        for k in range(0, len(i), 4096):
            m, o = i[k : k + 4096], j[k : k + 4096]
            apart = np.einsum("ij,ij->i", x[m], x[o]) < threshold
            need[m] = np.maximum(need[m], np.where(apart, shared_bits(key[m], key[o]) + 1, 0))
    return need


def passes_for(chance: np.ndarray, n_rows: np.ndarray, recall: float) -> int | None:
    """Passes until a pair at the threshold is met with probability ``recall``, if so many rows are met in a pass with such a chance; None if there are none."""
    n, share = 1, n_rows / n_rows.sum()
    while ((1 - chance) ** n * share).sum() > 1 - recall:
        n += max(1, n // 32)
        if n > 4096:
            return None
    return n


def plan(classes: DataFrame, means: DataFrame, window: int, threshold: float, recall: float, seed: int) -> tuple[int, DataFrame]:
    """The window, ``window`` or some doublings of it, and (label, d, passes): how often each label's vectors are sorted, so that pairs at the threshold are found for the least work in all.

    All vectors are measured, in a pass of their own: each tells how many bits leave no more than a window of vectors beside it, and so how likely a pair at the threshold meets. Tasks
    count those chances by label and window; one sum for each window comes to the driver.
    """
    spark = classes.sparkSession
    hashed = F.xxhash64("label", "d").alias("label_hash")

    def keys():
        def step(batch):
            vs, nodes, labels = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lengths = vs.value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                part = vs.take(at)
                x, mean = unit(part.flatten().to_numpy().reshape(len(at), d)), batch.column(3).take(at).flatten().to_numpy().reshape(len(at), d)
                planes = np.random.default_rng([seed + 1, d]).standard_normal((d, KEY_BITS))
                yield {"label_hash": labels[at], "key": sign_keys(x - mean, planes), "node": nodes[at], "bit": bit_chance(x, mean, threshold), "v": part}

        return step

    keyed = arrow_rows(classes.join(means, ["label", "d"]).select("v", "node", hashed, "mean"), keys, "label_hash long, key long, node long, bit double, v array<double>")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, classes.count() // (32 * window)))
    ordered = checkpointed(keyed.repartitionByRange(parts, "label_hash", "key", "node").sortWithinPartitions("label_hash", "key", "node"))
    labels = checkpointed(classes.groupBy("label", "d").agg(F.count("*").alias("rows")).select("label", "d", "rows", hashed))
    first = 0
    while True:
        sizes = [window << k for k in range(first, first + DOUBLINGS)]

        def chances(sizes=sizes):
            held: list = []

            def step(batch):
                vs = batch.column(4)
                lengths = vs.value_lengths().to_numpy()
                x = np.zeros((len(lengths), int(lengths.max(initial=0))))
                x[np.arange(x.shape[1]) < lengths[:, None]] = vs.flatten().to_numpy()
                held.append((*(batch.column(k).to_numpy() for k in (0, 1, 3)), unit(x)))

            def rest():
                if not held:
                    return
                width = max(h[3].shape[1] for h in held)
                label, key, bit = (np.concatenate([h[k] for h in held]) for k in range(3))
                x = np.concatenate([np.pad(h[3], ((0, 0), (0, width - h[3].shape[1]))) for h in held])
                for k, size in enumerate(sizes):
                    need = bits_needed(label, key, x, size, threshold)
                    halvings = np.where(need > KEY_BITS, -1, np.ceil(-STEPS * need * np.log2(np.maximum(bit, 1e-300)))).astype(np.int64)
                    found, n = np.unique(np.stack([label, halvings]), axis=1, return_counts=True)
                    yield {"label_hash": found[0], "size": np.full(len(n), k), "halvings": found[1], "n": n}

            step.rest = rest
            return step

        counted = arrow_rows(ordered, chances, "label_hash long, size int, halvings long, n long", rows=4096).groupBy("label_hash", "size", "halvings").agg(F.sum("n").alias("n"))

        def measured(group: pd.DataFrame) -> pd.DataFrame:  # it is used before ``sizes`` changes
            least: list[int | None] = []
            for k, size in enumerate(sizes):
                own = group[group["size"] == k]
                n, halvings = own["n"].to_numpy(), own["halvings"].to_numpy()
                needed = 1 if n.sum() <= size else passes_for(np.where(halvings < 0, 0.0, UNPARTED * 0.5 ** (halvings / STEPS)), n, recall)
                least.append(None if needed is None else 1 if n.sum() <= size else max(4, needed))
            return pd.DataFrame({"label_hash": group["label_hash"].iloc[:1], "passes": [least]})

        ship(spark)
        told = checkpointed(labels.join(counted.groupBy("label_hash").applyInPandas(measured, "label_hash long, passes array<int>"), "label_hash"))
        work = told.agg(*[F.when(F.count_if(F.get("passes", F.lit(k)).isNull()) == 0, F.sum(F.col("rows").cast("double") * F.get("passes", F.lit(k)) * (size + PASS_COST))).alias(f"w{k}") for k, size in enumerate(sizes)]).first()
        possible = [(w, k) for k, w in enumerate(work) if w is not None]
        if possible or not told.limit(1).count():
            best = min(possible, default=(0.0, 0))[1]
            return sizes[best], told.select("label", "d", F.get("passes", F.lit(best)).alias("passes"))
        first += DOUBLINGS


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, window: int = 64, recall: float = 0.999, seed: int = 7, block: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Equal vectors of a label are one class first. In each pass a class has a key of 64 random sign bits; classes are sorted by
    label and key over all tasks and compared, in double precision, with the ``window`` or more classes before them. The signs are those
    of unit vectors less their label's mean, as vectors that share a direction share most signs. Links of all
    passes give components. In a component every pair is then compared once more, by pairs of blocks, so n_links is exact
    for all that the passes connected, however large a component is. The number of passes and the window
    follow from each label's size and from what all its vectors tell in a pass that measures them; see ``plan`` and ``bits_needed``. A label is sorted as often as it needs itself.

    Vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing: n_links
    is 0 and component_id their own key. Vectors of different lengths don't link. Repeated rows are vectors of their own. A null key stays null, and is
    never a component's name unless all its members' are. Other columns aren't read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[key].cast("long").alias("key"), vectors[label].alias("label"), vectors[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # The norm of subnormal or huge vectors isn't a double; scaled by their largest component they are as any other.
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & (largest > 0), F.lit(False)))
    valid = rows.where("valid")
    classes = checkpointed(valid.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("key").alias("smallest")).withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")))
    # Sums are those of rows scaled by their largest component and norm; a task sends a sum for each label and place.
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    parts_of = classes.select("label", "d", scaled.alias("s")).select("label", "d", F.posexplode(F.transform("s", lambda x: x / norm)).alias("place", "x"))
    means = parts_of.groupBy("label", "d", "place").agg(F.avg("x").alias("x")).groupBy("label", "d").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("mean"))
    means = checkpointed(means.select("label", "d", F.col("mean.x").alias("mean")))
    window, passes = plan(classes, means, window, threshold, recall, seed)
    n_passes = passes.agg(F.coalesce(F.max("passes"), F.lit(1))).first()[0]
    total_rows = classes.join(passes, ["label", "d"]).agg(F.coalesce(F.sum("passes"), F.lit(0))).first()[0]
    order = "pass int, label_hash long, key long, node long, v array<double>"

    def keys():
        planes: dict[int, np.ndarray] = {}

        def step(batch):
            vs, nodes, labels = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lengths = vs.value_lengths().to_numpy()
            for d in np.unique(lengths):
                d = int(d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, KEY_BITS * n_passes))
                at = np.flatnonzero(lengths == d)
                part = vs.take(at)
                x = part.flatten().to_numpy().reshape(len(at), d)
                x = unit(x) - batch.column(3).take(at).flatten().to_numpy().reshape(len(at), d)
                mine = batch.column(4).take(at).to_numpy()
                for p in range(int(mine.max(initial=0))):
                    own = np.flatnonzero(mine > p)
                    signed = sign_keys(x[own], planes[d][:, p * KEY_BITS : (p + 1) * KEY_BITS])
                    yield {"pass": np.full(len(own), p, np.int32), "label_hash": labels[at[own]], "key": signed, "node": nodes[at[own]], "v": part.take(own)}

        return step

    keyed = arrow_rows(classes.join(means, ["label", "d"]).join(passes, ["label", "d"], "left").select("v", "node", F.xxhash64("label", "d").alias("label_hash"), "mean", F.coalesce("passes", F.lit(n_passes)).alias("passes")), keys, order)
    # Neighbours on two sides of a task's edge don't meet, so a task takes many windows; UNPARTED allows for the rest.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, total_rows // (32 * window)))
    ordered = keyed.repartitionByRange(parts, "pass", "label_hash", "key", "node").sortWithinPartitions("pass", "label_hash", "key", "node")

    def compare():
        tail: list = []

        def step(batch):
            run, lab, node = (batch.column(k).to_numpy() for k in (0, 1, 3))
            group = np.stack([run.astype(np.int64), lab], axis=1)
            vs = batch.column(4)
            lengths = vs.value_lengths().to_numpy()
            d = int(lengths.max())
            x = np.zeros((len(node), d))
            x[np.arange(d) < lengths[:, None]] = vs.flatten().to_numpy()
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            if tail and tail[0][2].shape[1] == d:
                g, n, y = tail[0]
                group, node, x = np.concatenate([g, group]), np.concatenate([n, node]), np.concatenate([y, x])
            tail[:] = [(group[-window:], node[-window:], x[-window:])]
            forest = Forest()
            for o in range(1, min(window, len(node) - 1) + 1):
                near = np.einsum("ij,ij->i", x[o:], x[:-o]) >= threshold
                near &= (group[o:] == group[:-o]).all(axis=1)
                for i in np.flatnonzero(near).tolist():
                    forest.join(int(node[i]), int(node[i + o]))
            return {"a": [e[0] for e in forest.edges], "b": [e[1] for e in forest.edges]}

        return step

    found = components(arrow_rows(ordered, compare, "a long, b long", rows=4096))
    members = classes.join(found, "node").select("node", "component", "n", F.lit(1).cast("long").alias("weight"), "v")

    def count():
        def step(batch):
            node, n, own, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "n", "block", "i", "j"))
            vs = batch.column(batch.schema.get_field_index("v"))
            x = vs.flatten().to_numpy().reshape(len(node), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            left = np.flatnonzero(own == i)
            right = np.flatnonzero(own == j)
            links = x[left] @ x[right].T >= threshold
            if i[0] == j[0]:
                np.fill_diagonal(links, False)
                yield {"node": node[left], "links": links @ n[right]}
            else:
                yield {"node": node[left], "links": links @ n[right]}
                yield {"node": node[right], "links": n[left] @ links}

        return step

    linked = grouped_arrow(block_pairs(members, "weight", block), ["component", "i", "j"], count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    # Names of components: the smallest key among the rows of their classes.
    named = classes.join(found, "node", "left").join(linked, "node", "left").select("label", "v", "n", "smallest", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    named = checkpointed(named)
    names = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    classified = named.join(checkpointed(names), "component").select("label", "v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(classified.withColumn("valid", F.lit(True)), ["label", "v", "valid"], "left")
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce(F.col("key") == F.coalesce("component_id", "key"), F.lit(True)).alias("kept"),
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS uid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (SELECT uid, vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_inner_product(e, e) > 0),
links AS (
  SELECT a.uid AS a, b.uid AS b FROM ok a JOIN ok b ON a.label = b.label AND a.uid <> b.uid
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (SELECT uid, uid FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT r.a AS uid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.uid = r.b GROUP BY r.a),
deg AS (SELECT a AS uid, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (uid) LEFT JOIN deg USING (uid)
"""
