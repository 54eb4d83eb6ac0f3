"""Undirected weighted graphs as tables: edges(left, right, weight) with left < right, nodes(id)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.operators.common import cut, numbered


def canonical(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """One edge for each unordered pair, with the greatest weight; loops go."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right"), F.col(weight).cast("double").alias("weight"))
    return pairs.groupBy("left", "right").agg(F.max("weight").alias("weight"))


def ends(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge twice, once from each end: node, other and the columns named."""
    columns = [F.col(c) for c in keep]
    return edges.select(F.col("left").alias("node"), F.col("right").alias("other"), *columns).unionByName(edges.select(F.col("right").alias("node"), F.col("left").alias("other"), *columns))


def ordered(edges: DataFrame, focal: Column | None = None, priority: DataFrame | None = None) -> DataFrame:
    """Adds turn, the order in which edges are offered: those of the focal node first, its priority neighbours and the rest by turns, then all others by weight."""
    if focal is None:
        return edges.withColumn("turn", F.struct(F.lit(1).alias("rest"), F.lit(0).alias("place"), F.lit(0).alias("second"), (-F.col("weight")).alias("w"), "left", "right"))
    at_focal = (F.col("left") == focal) | (F.col("right") == focal)
    other = F.when(F.col("left") == focal, F.col("right")).otherwise(F.col("left"))
    marked = edges.withColumns({"at_focal": at_focal, "other": F.when(at_focal, other)})
    if priority is None:
        marked = marked.withColumn("preferred", F.lit(False))
    else:
        wanted = priority.select(F.col("id").alias("other"), F.lit(True).alias("p")).distinct()
        marked = marked.join(wanted, "other", "left").withColumn("preferred", F.coalesce("p", F.lit(False)) & F.col("at_focal")).drop("p")
    place = F.row_number().over(W.partitionBy("at_focal", "preferred").orderBy(F.desc("weight"), "left", "right"))
    # Only the focal node's edges are numbered; they are as many as it has neighbours.
    focal_part = marked.where("at_focal").withColumn("place", place)
    rest = marked.where("NOT at_focal").withColumn("place", F.lit(0))
    both = focal_part.unionByName(rest)
    turn = F.struct(F.when(F.col("at_focal"), 0).otherwise(1).alias("rest"), "place", F.when(F.col("preferred"), 0).otherwise(1).alias("second"), (-F.col("weight")).alias("w"), "left", "right")
    return both.select("left", "right", "weight", turn.alias("turn"))


def capped(edges: DataFrame, cap: int, focal: Column | None = None, priority: DataFrame | None = None, small: int = 100_000) -> DataFrame:
    """What a greedy walk over the ordered edges keeps if no node may have more than ``cap`` of them; a cap of 0 or less keeps all.

    In a round an edge is kept if at both ends so few undecided edges come before it that there is room for them all and for
    it, whatever becomes of them; edges with a full end go. The first undecided edge always is kept, so rounds end, and the
    result is the walk's. Rounds are few: each decides whole neighbourhoods at once. Up to ``small`` edges are walked on the driver.
    """
    if cap <= 0:
        return edges.select("left", "right", "weight")
    undecided = cut(ordered(edges, focal, priority))
    if undecided.limit(small + 1).count() <= small:
        held: dict = {}
        walked = []
        for r in undecided.orderBy("turn").select("left", "right", "weight").collect():
            if held.get(r["left"], 0) < cap and held.get(r["right"], 0) < cap:
                held[r["left"]], held[r["right"]] = held.get(r["left"], 0) + 1, held.get(r["right"], 0) + 1
                walked.append(tuple(r))
        return edges.sparkSession.createDataFrame(walked, undecided.select("left", "right", "weight").schema)
    chosen = undecided.select("left", "right", "weight").limit(0)
    while undecided.limit(1).count():
        used = ends(chosen).groupBy("node").agg(F.count("*").alias("used"))
        place = F.row_number().over(W.partitionBy("node").orderBy("turn"))
        sides = ends(undecided, "turn").withColumn("place", place).join(used, "node", "left")
        fits = sides.withColumn("room", F.lit(cap) - F.coalesce("used", F.lit(0))).withColumn("left", F.least("node", "other")).withColumn("right", F.greatest("node", "other"))
        state = fits.groupBy("left", "right").agg(F.bool_and(F.col("place") <= F.col("room")).alias("kept"), F.bool_or(F.col("room") <= 0).alias("gone"))
        decided = cut(undecided.join(state, ["left", "right"]))
        chosen = cut(chosen.unionByName(decided.where("kept").select("left", "right", "weight")))
        undecided = decided.where("NOT kept AND NOT gone").select("left", "right", "weight", "turn")
    return chosen


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = ends(edges).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, F.col("id") == F.col("node"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


#: Edges up to which a graph's ranks are worked out in one place: a graph of the display has a few hundred.
SMALL = 100_000


def pagerank(nodes: DataFrame, edges: DataFrame, focal: Column, alpha: float = 0.85, tolerance: float = 1e-12, small: int = SMALL) -> DataFrame:
    """Personalized PageRank with restart at the focal node, weighted by edge; a node without edges gives its rank back to the focal node.

    Rounds end when the ranks, which add up to 1, together change by less than ``tolerance``, whatever the size of the graph. Each round is a join and a sum; a graph of up to ``small`` nodes and
    edges is worked out on the driver instead, to the same bound.
    """
    flow = ends(edges, "weight").withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy("node"))).select("node", "other", "share")
    flow = cut(flow)
    start = cut(nodes.select("id", F.when(F.col("id") == focal, 1.0).otherwise(0.0).alias("rank")))
    n = start.count()
    if n <= small and flow.limit(2 * small + 1).count() <= 2 * small:
        return ranked_here(start, flow, alpha, tolerance)
    rank = start
    while True:
        sent = rank.join(flow, F.col("id") == F.col("node")).groupBy("other").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        back = 1.0 - (sent.agg(F.sum("got")).first()[0] or 0.0)
        new = rank.join(sent, F.col("id") == F.col("other"), "left")
        restart = F.when(F.col("id") == focal, F.lit(1.0 - alpha + alpha * back)).otherwise(0.0)
        new = cut(new.select("id", F.col("rank").alias("was"), (restart + alpha * F.coalesce("got", F.lit(0.0))).alias("rank")))
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        rank = new.select("id", "rank")
        if moved < tolerance:
            return rank


def ranked_here(start: DataFrame, flow: DataFrame, alpha: float, tolerance: float) -> DataFrame:
    begins = [tuple(r) for r in start.select("id", "rank").collect()]
    place = {i: k for k, (i, _) in enumerate(begins)}
    rows = [(place[r["node"]], place[r["other"]], r["share"]) for r in flow.collect() if r["node"] in place and r["other"] in place]
    source, target, share = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    home = np.array([r for _, r in begins])
    rank = home
    while True:
        got = np.bincount(target, rank[source] * share, minlength=len(rank)) if len(rank) else rank
        new = alpha * got + (1 - alpha * got.sum()) * home
        if np.abs(new - rank).sum() < tolerance:
            return start.sparkSession.createDataFrame([(i, float(new[k])) for i, k in place.items()], start.schema)
        rank = new


def distances(nodes: DataFrame, edges: DataFrame, focal: Column) -> DataFrame:
    """Number of edges on a shortest path to the focal node, and the smallest neighbour that is one nearer; null where there is no path."""
    near = cut(ends(edges).select("node", "other"))
    known = cut(nodes.where(F.col("id") == focal).select("id", F.lit(0).alias("distance"), F.lit(None).cast(nodes.schema["id"].dataType).alias("via")))
    frontier = known
    step = 0
    while frontier.limit(1).count():
        step += 1
        reached = frontier.join(near, F.col("id") == F.col("node")).groupBy("other").agg(F.min("node").alias("via"))
        frontier = cut(reached.join(known.select(F.col("id").alias("other")), "other", "left_anti").select(F.col("other").alias("id"), F.lit(step).alias("distance"), "via"))
        known = cut(known.unionByName(frontier))
    return nodes.select("id").join(known, "id", "left")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node that each is connected with.

    Each round a node takes the least name among its neighbours' and then that name's own, so chains shorten by jumps and rounds grow with the
    logarithm of their length.
    """
    near = cut(ends(edges).select("node", "other"))
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        offered = near.join(label, F.col("other") == F.col("id")).groupBy("node").agg(F.min("component").alias("least"))
        moved = label.join(offered, F.col("id") == F.col("node"), "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("to"))
        jumps = label.select(F.col("id").alias("via"), F.col("component").alias("further"))
        new = cut(moved.join(jumps, F.col("to") == F.col("via"), "left").select("id", "was", F.least("to", F.coalesce("further", "to")).alias("component")))
        label = new.select("id", "component")
        if new.where("was <> component").limit(1).count() == 0:
            return label


def meta_graph(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Total weight between each two groups; groups: id, component."""
    left = groups.select(F.col("id").alias("left"), F.col("component").alias("l"))
    right = groups.select(F.col("id").alias("right"), F.col("component").alias("r"))
    crossing = edges.join(left, "left").join(right, "right").where("l <> r")
    return crossing.groupBy(F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right")).agg(F.sum("weight").alias("weight"))


#: Gains no greater are none.
NO_GAIN = 1e-12


def merged_communities(edges: DataFrame, labels: DataFrame, strength: DataFrame, total: float, last: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Labels after communities have been merged while a merge adds to the modularity, or until ``last`` of them have edges: then also their volumes and the weights between them.

    Each round, two communities merge if each is the other's best partner, so the best merge of all is always made. Where few are, as around hubs, communities whose hash says so also go to a best partner that stays, as
    many of them as that can take in together without a loss. The graph is contracted after each round.
    """
    volume = cut(labels.join(strength, "id").groupBy("c").agg(F.sum("d").alias("v")))
    left, right = (labels.select(F.col("id").alias(e), F.col("c").alias(f"c_{e}")) for e in ("left", "right"))
    ends_of = edges.join(left, "left").join(right, "right").where("c_left <> c_right")
    between = cut(ends_of.groupBy(F.least("c_left", "c_right").alias("l"), F.greatest("c_left", "c_right").alias("r")).agg(F.sum("weight").alias("w")))
    turn = 0
    while True:
        if volume.limit(last + 1).count() <= last:
            return labels, volume, between
        vl, vr = (volume.select(F.col("c").alias(e), F.col("v").alias(f"v_{e}")) for e in ("l", "r"))
        gain = F.col("w") / total - F.col("v_l") * F.col("v_r") / (2 * total * total)
        offers = between.join(vl, "l").join(vr, "r").withColumn("gain", gain).where(F.col("gain") > NO_GAIN)
        key = F.struct((-F.round("gain", 12)).alias("g"), "l", "r")
        sides = offers.select(F.explode(F.array(F.struct(F.col("l").alias("c"), F.col("v_l").alias("own"), F.col("v_r").alias("theirs")), F.struct(F.col("r").alias("c"), F.col("v_r").alias("own"), F.col("v_l").alias("theirs")))).alias("s"), key.alias("key"), "w")
        best = cut(sides.groupBy("s.c").agg(F.min(F.struct("key", F.struct("w", "s.own", "s.theirs").alias("of"))).alias("m")).select("c", "m.key", "m.of"))
        mutual = cut(best.groupBy("key").agg(F.count("*").alias("n")).where("n = 2").select(F.col("key.r").alias("gone"), F.col("key.l").alias("kept")))
        pairs, partners = mutual.count(), best.count()
        if not pairs:
            return labels, None, None
        if pairs * 40 < partners:
            taken = mutual.select(F.explode(F.array("gone", "kept")).alias("c"))
            head = F.when(F.col("key.l") == F.col("c"), F.col("key.r")).otherwise(F.col("key.l"))
            draw = lambda x, salt: F.pmod(F.xxhash64(x, F.lit(turn), F.lit(salt)), F.lit(1 << 20)) / (1 << 20)  # noqa: B023, E731
            asks = best.join(taken, "c", "left_anti").withColumn("kept", head).where((draw(F.col("c"), 0) >= 0.5)).join(mutual.select(F.col("gone").alias("kept")), "kept", "left_anti")
            asks = asks.join(mutual.groupBy("kept").agg(F.lit(True).alias("fixed")), "kept", "left").where(F.col("fixed") | (draw(F.col("kept"), 0) < 0.5))
            # A partner may take in so much volume that the last to come still gains; half of it is used. What merges with it anyway counts.
            room = F.col("of.w") * 2 * total / F.col("of.own") - F.col("of.theirs")
            wanted = asks.groupBy("kept").agg(F.sum("of.own").alias("wanted"))
            joins_too = mutual.join(volume, F.col("gone") == F.col("c")).select("kept", F.col("v").alias("extra"))
            asks = asks.join(wanted, "kept").join(joins_too, "kept", "left").where(draw(F.col("c"), 1) < (room - F.coalesce("extra", F.lit(0.0))) / F.col("wanted") / 2)
            mutual = cut(mutual.unionByName(asks.select(F.col("c").alias("gone"), "kept")))
        moved = lambda df, c: df.join(mutual.select(F.col("gone").alias(c), F.col("kept").alias("to_")), c, "left").withColumn(c, F.coalesce("to_", c)).drop("to_")  # noqa: B023, E731
        labels = cut(moved(labels, "c"))
        volume = cut(moved(volume, "c").groupBy("c").agg(F.sum("v").alias("v")))
        both = moved(moved(between, "l"), "r").where("l <> r")
        between = cut(both.groupBy(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).agg(F.sum("w").alias("w")))
        turn += 1


def one_by_one(names: list, between: dict[tuple, float], volume: dict, total: float) -> dict:
    """Where each community goes if the best pair is merged, and again, while that adds to the modularity; of equal pairs the first in order of names."""
    place = {c: i for i, c in enumerate(names)}
    w, v, into = np.zeros((len(names),) * 2), np.array([volume[c] for c in names], float), np.arange(len(names))
    for (a, b), x in between.items():
        w[place[a], place[b]] = w[place[b], place[a]] = x
    upper = np.triu(np.ones_like(w, bool), 1)
    while len(names) > 1:
        gain = np.where(upper & (w > 0), np.round(w / total - np.outer(v, v) / (2 * total * total), 12), -np.inf)
        a, b = divmod(int(gain.argmax()), len(names))
        if gain[a, b] <= NO_GAIN:
            break
        w[a] += w[b]
        w[:, a] += w[:, b]
        w[a, a] = w[b] = 0
        w[:, b] = 0
        v[a], v[b] = v[a] + v[b], 0
        into[into == b] = a
    return {c: names[into[i]] for c, i in place.items()}


def communities(nodes: DataFrame, edges: DataFrame, last: int = 1000) -> DataFrame:
    """(id, community) by modularity, numbered from 0 by size and smallest node. A node without edges is a community of its own.

    While the graph has more than ``last`` communities they are merged in rounds of joins, each with its best partner, and the graph is contracted; the last ones are merged one at a time, the best pair of all first, over a matrix of
    that size. So a graph of up to ``last`` nodes gets what merging one by one gives, and a larger one what that gives from the communities found so far. Hashes break symmetry: the result is the same on every run and at every number of
    tasks.
    """
    edges = cut(canonical(edges, "left", "right"))
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    labels = cut(nodes.select("id").distinct().withColumn("c", F.col("id")))
    if total > 0:
        strength = cut(ends(edges, "weight").groupBy(F.col("node").alias("id")).agg(F.sum("weight").alias("d")))
        labels, volume, between = merged_communities(edges, labels, strength, total, last)
        if volume is not None:
            known = {r["c"]: r["v"] for r in volume.collect()}
            into = one_by_one(sorted(known), {(r["l"], r["r"]): r["w"] for r in between.collect()}, known, total)
            moved = [(a, b) for a, b in into.items() if a != b]
            if moved:
                kind = labels.schema["c"].dataType.simpleString()
                to = nodes.sparkSession.createDataFrame(moved, f"c {kind}, to_ {kind}")
                labels = cut(labels.join(F.broadcast(to), "c", "left").select("id", F.coalesce("to_", "c").alias("c")))
    sizes = labels.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = numbered(sizes, [F.desc("n"), F.asc("first")], "place").select("c", (F.col("place") - 1).alias("community"))
    return labels.join(order, "c").select("id", "community")


def strongest(edges: DataFrame, k: int = 3) -> DataFrame:
    """The k strongest links of each node."""
    order = W.partitionBy("node").orderBy(F.desc("weight"), "other")
    return ends(edges, "weight").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
