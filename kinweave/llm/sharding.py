"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards while there is room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import checkpointed, read, text_or_empty

#: Rows that one bucket of a distributed numbering is meant to hold.
BUCKET_ROWS = 500_000


def numbered(df: DataFrame, by: str, unique: str, total: int, name: str, weight: str | None = None) -> DataFrame:
    """``df`` with a gapless number from 0 within each ``by``, dealt over many tasks; with ``weight``, the sum of the weights before a row.

    Rows fall into hash buckets; a window numbers each bucket, and the buckets' counts, of which there are at most
    max(32, total / BUCKET_ROWS) for each value of ``by``, give what to add.
    """
    buckets = max(32, total // BUCKET_ROWS)
    size = F.col(weight) if weight else F.lit(1).cast("long")
    df = df.withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), unique), F.lit(buckets)))
    counts = df.groupBy(by, "bucket").agg(F.sum(size).alias("held"))
    before = counts.select(by, "bucket", (F.sum("held").over(W.partitionBy(by).orderBy("bucket")) - F.col("held")).alias("before"))
    inside = F.sum(size).over(W.partitionBy(by, "bucket").orderBy(unique).rowsBetween(W.unboundedPreceding, W.currentRow)) - size
    return df.withColumn("inside", inside).join(before, [by, "bucket"]).withColumn(name, F.col("inside") + F.col("before")).drop("bucket", "inside", "before")


def shard_at(place: Column, rooms: list[int]) -> Column:
    """The shard of a place, where the shards' rooms lie behind one another."""
    out, end = F.lit(0), 0
    for r in rooms[:-1]:
        end += r
        out = out + (place >= end).cast("int")
    return out


def left(rooms: list[int], placed: DataFrame) -> list[int]:
    here = dict(placed.groupBy("shard").count().collect())
    return [r - here.get(s, 0) for s, r in enumerate(rooms)]


def laid(docs: DataFrame, groups: DataFrame, rooms: list[int], total: int) -> DataFrame:
    """``docs`` with the shard that they have if their ``groups`` (gid, n) lie one after another in the rooms, so that fewer groups are cut than there are shards."""
    lines = numbered(groups.withColumn("all", F.lit(0)), "all", "gid", total, "start", "n")
    lines = checkpointed(lines.select(F.col("gid").alias("g"), "start", shard_at(F.col("start"), rooms).alias("shard"), shard_at(F.col("start") + F.col("n") - 1, rooms).alias("last")))
    cut = lines.where(F.col("shard") != F.col("last"))
    names = [r["g"] for r in cut.select("g").collect()]
    columns = [docs[c] for c in docs.columns]
    whole = docs.where(~F.col("gid").isin(names)).join(lines, F.col("gid") == F.col("g")).select(*columns, "shard")
    parts = numbered(docs.where(F.col("gid").isin(names)), "gid", "uid", total, "rank").join(F.broadcast(cut), F.col("gid") == F.col("g"))
    return checkpointed(whole.unionByName(parts.select(*docs.columns, shard_at(F.col("start") + F.col("rank"), rooms).alias("shard"))))


def circulation(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wishes (from, to) come true at once: moves into free room, which leave room behind, and then cycles of moves, until there is none left.

    Only counts for pairs of shards are held.
    """
    ways: dict[int, dict[int, int]] = {s: {} for s in range(len(room))}
    room, flow = [*room], dict.fromkeys(wanted, 0)
    for (a, b), n in sorted(wanted.items()):
        ways[a][b] = n

    def move(a: int, b: int, n: int) -> None:
        flow[a, b] += n
        ways[a][b] -= n
        if not ways[a][b]:
            del ways[a][b]

    while steps := [(a, b, min(n, room[b])) for a in ways for b, n in ways[a].items() if room[b] > 0]:
        a, b, n = steps[0]
        move(a, b, n)
        room[b] -= n
        room[a] += n
    for start in ways:
        path = [start]
        while path:
            x = path[-1]
            if not ways[x]:  # no cycle goes through x any more
                path.pop()
                if path:
                    del ways[path[-1]][x]
                continue
            y = next(iter(ways[x]))
            if y not in path:
                path.append(y)
                continue
            cycle = [*path[path.index(y) :], y]
            pairs = [*zip(cycle, cycle[1:], strict=False)]
            n = min(ways[a][b] for a, b in pairs)
            for a, b in pairs:
                move(a, b, n)
            del path[path.index(y) + 1 :]
    return {w: n for w, n in flow.items() if n}


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each value of ``by`` and n, the rows that have it. Groups of over a thousandth of all rows, of which there are at most a thousand, are broadcast."""
    hot = groups.where(F.col("n") * 1000 > total)
    far = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(groups.where(F.col("n") * 1000 <= total), by)
    return far.unionByName(rows.join(F.broadcast(hot), by))


def propagate(nodes: DataFrame, targets: list[int], total: int) -> DataFrame:
    """``nodes`` (uid, gid, shard and others) after label propagation; documents are linked if they have the same gid.

    In each round every document wants the shard that holds most of its group, ties going by a hash of group and shard. Wishes come true
    as far as the shards' quotas let them: into free room, or as exchanges along cycles of shards, in order of a hash of the
    document. Whatever moves, the sum of squares of the groups' counts in the shards grows, so rounds end: when no wish can come true.
    """
    shards = len(targets)
    while True:
        here = dict(nodes.groupBy("shard").count().collect())
        rank = F.struct("n", F.pmod(F.xxhash64("gid", "shard"), F.lit(1 << 20)).alias("tie"), "shard")
        held = nodes.groupBy("gid", "shard").agg(F.count("*").alias("n"))
        wish = checkpointed(held.groupBy("gid").agg(F.max(rank)["shard"].alias("to"), F.sum("n").alias("n")))
        wishes = checkpointed(with_groups(nodes, wish, ["gid"], total).select(*nodes.columns, F.when(F.col("to") != F.col("shard"), F.col("to")).alias("to")))
        wanted = {(r[0], r[1]): r[2] for r in wishes.where(F.col("to").isNotNull()).groupBy("shard", "to").count().collect()}
        flow = circulation(wanted, [t - here.get(s, 0) for s, t in enumerate(targets)])
        if not flow:
            return nodes
        way = F.col("shard") * shards + F.col("to")
        quota = F.element_at(F.array(*[F.lit(flow.get((a, b), 0)).cast("long") for a in range(shards) for b in range(shards)]), F.col("way").cast("int") + 1)
        movers = numbered(wishes.where(F.col("to").isNotNull()).withColumn("way", way), "way", "uid", total, "rank")
        moved = movers.withColumn("shard", F.when(F.col("rank") < quota, F.col("to")).otherwise(F.col("shard")))
        nodes = checkpointed(wishes.where(F.col("to").isNull()).select(*nodes.columns).unionByName(moved.select(*nodes.columns)))


def assign(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard. The law is ``rows``.

    Equal texts are linked. Groups that are larger than a shard are laid first, over as few shards as hold them, or one more. The
    documents of the others propagate labels, see ``propagate``. Groups that this leaves split are taken out and
    laid one after another into what is free, so that fewer of them are cut than there are shards, even if all documents
    have copies. Documents without links fill the shards up to counts that are at most one apart. Null texts are empty texts (size
    1, checksum 0); null keys and repeated rows are documents as any other; other columns aren't read.
    An empty table gives no rows. Slots are numbered from 0 in each shard without gaps.
    """
    body = text_or_empty(text)
    base = docs.select(
        docs[key].cast("long").alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("g1"), F.xxhash64(F.lit(17), body).alias("g2"), F.monotonically_increasing_id().alias("uid"),
    )
    base = checkpointed(base)
    total = base.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    groups = checkpointed(base.groupBy("g1", "g2", "size").agg(F.count("*").alias("n"), F.min("uid").alias("gid")))
    keep = ["key", "size", "text_crc32", "uid", "gid"]
    both = checkpointed(with_groups(base, groups, ["g1", "g2", "size"], total).select(*keep, "n"))
    share, rooms = min(targets), targets
    large = laid(both.where((F.col("n") > share) & (F.col("n") > 1)).select(*keep), groups.where((F.col("n") > share) & (F.col("n") > 1)).select("gid", "n"), rooms, total)
    rooms = left(rooms, large)
    linked = both.where((F.col("n") > 1) & (F.col("n") <= share)).select(*keep, shard_at(F.pmod(F.xxhash64("uid"), F.lit(max(1, sum(rooms)))), rooms).alias("shard"))
    moved = checkpointed(propagate(checkpointed(linked), rooms, total))
    held = moved.groupBy("gid").agg(F.min("shard").alias("shard"), F.max("shard").alias("other"), F.count("*").alias("n"))
    held = checkpointed(numbered(held.withColumn("whole", F.when(F.col("shard") == F.col("other"), F.col("shard")).otherwise(-1)), "whole", "gid", total, "start", "n"))
    room = F.element_at(F.array(*[F.lit(r) for r in rooms]), F.col("shard") + 1)
    fits = (F.col("whole") >= 0) & (F.col("start") + F.col("n") <= room)
    marked = checkpointed(moved.join(held.select(F.col("gid").alias("g"), fits.alias("fits")), F.col("gid") == F.col("g")).select(*keep, "shard", "fits"))
    kept = marked.where("fits").drop("fits")
    rooms = left(rooms, kept)
    rest = laid(marked.where("not fits").select(*keep), held.where(~fits).select("gid", "n"), rooms, total)
    rooms = left(rooms, rest)
    single = numbered(both.where("n = 1").select(*keep).withColumn("all", F.lit(0)), "all", "uid", total, "place").select(*keep, shard_at(F.col("place"), rooms).alias("shard"))
    out = numbered(large.unionByName(kept).unionByName(rest).unionByName(single), "shard", "uid", total, "slot")
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))
