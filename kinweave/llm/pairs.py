"""What the operators on pairs share: connected components, grouped Arrow tasks, and exact counting inside components by pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import checkpointed
from kinweave.session import ship


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the undirected ``edges``; the component is its smallest node.

    Each round a node takes the least label among its neighbours', and then that label's own label, so that chains shorten by
    jumps. Rounds end when no label changes; each cuts the lineage. Labels stay in tables: only a count reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    both = checkpointed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jumps = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        done = checkpointed(moved.join(jumps, F.col("to") == F.col("via")).select("node", "was", F.least("to", "further").alias("label")))
        labels = done.select("node", "label")
        if done.where(F.col("was") != F.col("label")).limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))


def grouped_arrow(df: DataFrame, keys: list[str], make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], schema: str, order: list[str] | None = None) -> DataFrame:
    """``make()``'s function on the rows of each key, of which a task holds one key's at a time. Keys are longs without nulls.

    Keys that are met in hundreds of thousands, of a few rows each, cost no call of Spark's own per group.
    """
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    with_schema = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, step = to_arrow_schema(with_schema), make()
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        out: dict[str, list] = {f.name: [] for f in kind}

        def finish() -> None:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            for columns in step(whole) or ():
                for name, values in columns.items():
                    out[name].append(pa.array(values, kind.field(name).type))

        def flush() -> Iterator[pa.RecordBatch]:
            if any(out.values()):
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[f.name]) for f in kind], schema=kind)
            for v in out.values():
                v.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                key = tuple(at[:, start].tolist())
                if held and key != last:
                    finish()
                    held.clear()
                last = key
                held.append(batch.slice(start, end - start))
            if sum(map(len, next(iter(out.values())))) > 10_000:
                yield from flush()
        if held:
            finish()
        yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, with_schema)


def dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """``rows`` of groups that are cut into ``blocks`` blocks by a hash of the node, dealt into all unordered pairs of blocks: i, j and block are added.

    A group of one block is one pair, i = j = 0. A task that takes a pair of blocks holds no more than those, and no pair of
    rows becomes a row.
    """
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col(blocks)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return rows.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other", blocks)


def block_pairs(members: DataFrame, weight: str, block_weight: int) -> DataFrame:
    """``members`` (node, component, weight and others) dealt into pairs of blocks of about ``block_weight`` within their component."""
    sizes = checkpointed(members.groupBy("component").agg(F.ceil(F.sum(weight) / F.lit(block_weight)).cast("long").alias("blocks")))
    return dealt(members.join(sizes, "component"), "blocks")


class Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def forest_of(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean link matrix."""
    n = len(links)
    todo = np.ones(n, bool)
    edges: list[tuple[int, int]] = []
    for start in range(n):
        if not todo[start]:
            continue
        todo[start] = False
        stack = [start]
        while stack:
            x = stack.pop()
            near = np.flatnonzero(links[x] & todo)
            todo[near] = False
            near = near.tolist()
            edges += [(x, y) for y in near]
            stack += near
    return edges
