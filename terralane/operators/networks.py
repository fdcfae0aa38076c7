"""Networks as frames: nodes (id, x, y, ...) and arcs (src, dst, weight, ...).

An undirected network lists each arc once; ``both_ways`` gives its half-arcs. Iterations
are joins and sums whose state is a checkpointed frame; a loop ends when nothing
changes. Functions that take a whole network into one task say so: they raise at once
where it is larger than their stated bound, or go on with joins.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralane.functions import geodesy

from .checkpoints import cut

#: Nodes that the one-task functions take; they raise above it.
ONE_TASK_NODES = 200_000
#: Nodes of a network that is sent to all tasks, and its half-arcs: 40 MB at most.
SHARED_NODES, SHARED_ARCS = 500_000, 1_500_000
#: Nodes of a network that is searched from every node for every arc taken out.
GIRVAN_NEWMAN_NODES = 2_000
#: Points of one triangulation; each new one is held against all triangles.
DELAUNAY_POINTS = 10_000


def within(df: DataFrame, bound: int, what: str) -> DataFrame:
    """``df``, or an error if it has more than ``bound`` rows; no more than those are counted."""
    if df.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} {what}: beyond this operator's stated bound")
    return df


def both_ways(arcs: DataFrame) -> DataFrame:
    """Half-arcs (src, dst, weight); a self-loop stays one."""
    weight = F.col("weight") if "weight" in arcs.columns else F.lit(1.0)
    one = arcs.select("src", "dst", weight.alias("weight"))
    return one.unionByName(
        one.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )


def from_layer(segments: DataFrame, places: int = 9) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs of line segments (x1, y1, x2, y2, ...): equal vertices are one node.

    Ids are hashes of the rounded coordinates, so no global numbering is needed.
    Segments without length are left out; other columns stay on the arcs.
    """
    key = lambda x, y: F.xxhash64(F.round(x, places), F.round(y, places))
    arcs = segments.where("not (x1 = x2 and y1 = y2)").withColumns(
        {"src": key(F.col("x1"), F.col("y1")), "dst": key(F.col("x2"), F.col("y2"))}
    )
    ends = arcs.select(F.col("src").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(
        arcs.select(F.col("dst").alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    )
    return ends.groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")), arcs


def directed(arcs: DataFrame, way: str = "way") -> DataFrame:
    """Half-arcs by a column: 1 both ways, 2 forward, 3 reverse; others drop out."""
    forward = arcs.where(F.col(way).isin(1, 2)).select("src", "dst", "weight")
    back = arcs.where(F.col(way).isin(1, 3)).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"
    )
    return forward.unionByName(back)


def resolve(nodes: DataFrame, arcs: DataFrame, geographic: bool = False) -> DataFrame:
    """Arcs with the places of their ends and their length."""
    a = nodes.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    joined = arcs.join(a, "src").join(b, "dst")
    ends = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return joined.withColumn("length", geodesy.distance(*ends, geographic))


def degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, degree, out_degree, in_degree; a self-loop counts once in the degree."""
    ends = arcs.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e"),
        (F.col("src") == F.col("dst")).cast("int").alias("loop"),
    )
    n = ends.groupBy(F.col("e.id").alias("id")).agg(
        F.sum(F.when((F.col("loop") == 1) & (F.col("e.i") == 1), 0).otherwise(1)).alias("degree"),
        F.sum("e.o").alias("out_degree"),
        F.sum("e.i").alias("in_degree"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(n, "id", "left").select("id", *map(zero, ("degree", "out_degree", "in_degree")))


def delete_nodes(nodes: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in ``gone`` (id) and the arcs at them."""
    left = nodes.join(gone, "id", "left_anti")
    for end in ("src", "dst"):
        arcs = arcs.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return left, arcs


def shortest_paths(half: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """source, node, distance, previous, hops of the cheapest ways from each source (id).

    Rounds relax only from nodes that improved in the round before, so the work follows
    the frontier. Ties prefer fewer hops, then the lesser previous node. The source
    itself has distance 0 and no previous node.
    """
    start = sources.select(
        F.col("id").alias("source"),
        F.col("id").alias("node"),
        F.lit(0.0).alias("distance"),
        F.lit(None).cast("bigint").alias("previous"),
        F.lit(0).alias("hops"),
    )
    best, frontier = cut(start), start
    key = F.struct("distance", "hops", "previous")
    for _ in range(max_rounds):
        offers = (
            frontier.join(half, frontier.node == half.src)
            .select(
                "source",
                F.col("dst").alias("node"),
                (F.col("distance") + F.col("weight")).alias("distance"),
                F.col("src").alias("previous"),
                (F.col("hops") + 1).alias("hops"),
            )
            .groupBy("source", "node")
            .agg(F.min(key).alias("k"))
            .select("source", "node", "k.*")
        )
        old = best.select(
            "source", "node", F.struct("distance", "hops", "previous").alias("was")
        )
        better = cut(
            offers.join(old, ["source", "node"], "left")
            .where(F.col("was").isNull() | (key < F.col("was")))
            .select("source", "node", "distance", "previous", "hops")
        )
        if better.isEmpty():
            return best
        best = cut(best.join(better.select("source", "node"), ["source", "node"], "left_anti").unionByName(better))
        frontier = better
    raise RuntimeError("shortest paths did not settle")


#: Nodes that one union-find holds; a partition with more is contracted in portions.
HELD_NODES = 500_000


def contracted(arcs: DataFrame) -> DataFrame:
    """src, dst: each partition's arcs as stars around the least node of what they join."""
    def run(frames):
        up: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def stars():
            ends = [(n, root(n)) for n in up]
            return pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["src", "dst"], dtype="int64")

        for frame in frames:
            for a, b in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            if len(up) >= HELD_NODES:
                yield stars()
                up = {}
        yield stars()

    ends = arcs.where("src != dst").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    return ends.mapInPandas(run, "src bigint, dst bigint")


def components(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, component: the least id that arcs reach, by spreading minima with shortcuts.

    Partitions are contracted to stars first, so few rounds are left; they end when the
    labels' checksum stays. Arcs at unknown nodes don't count.
    """
    known = nodes.select(F.col("id").alias("src"))
    inner = arcs.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi")
    half = cut(both_ways(contracted(inner)).select("src", "dst").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    sign = F.sum(F.xxhash64("id", "component").cast("decimal(20,0)")).alias("s")
    before = labels.agg(sign).first().s
    while True:
        around = half.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(
            F.min("component").alias("m")
        )
        lowered = labels.join(around, "id", "left").select(
            "id", F.least("component", F.coalesce("m", "component")).alias("component")
        )
        # A label's own label is a shortcut that halves the way.
        up = lowered.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = cut(
            lowered.join(up, "component", "left").select(
                "id", F.least("component", F.coalesce("next", "component")).alias("component")
            )
        )
        state = labels.agg(sign).first().s
        if state == before:
            return labels
        before = state


def clustering_coefficient(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, coefficient: links among neighbours over k (k - 1) / 2; 0 with fewer than two.

    Each triangle is found once from its least-degree corner, so hubs are not expanded.
    """
    pairs = (
        arcs.where("src != dst")
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    k = ends.groupBy("id").agg(F.count("*").alias("k"))
    ka, kb = (k.select(F.col("id").alias(c), F.col("k").alias(f"k{c}")) for c in "ab")
    ranked = pairs.join(ka, "a").join(kb, "b")
    low = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    out = cut(
        ranked.select(
            F.when(low, F.col("a")).otherwise(F.col("b")).alias("s"),
            F.when(low, F.col("b")).otherwise(F.col("a")).alias("t"),
        )
    )
    second = out.select("s", F.col("t").alias("u"))
    wedges = out.join(second, "s").where("t < u")
    closing = out.select(F.least("s", "t").alias("t"), F.greatest("s", "t").alias("u"))
    triangles = wedges.join(closing, ["t", "u"])
    n = triangles.select(F.explode(F.array("s", "t", "u")).alias("id")).groupBy("id").agg(
        F.count("*").alias("links")
    )
    joined = nodes.select("id").join(k, "id", "left").join(n, "id", "left")
    value = 2.0 * F.coalesce("links", F.lit(0)) / (F.col("k") * (F.col("k") - 1))
    return joined.select("id", F.when(F.col("k") >= 2, value).otherwise(0.0).alias("coefficient"))


def harmonic_closeness(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """id, closeness: sum of 1 / distance over what is reached; -1 if nothing is."""
    sums = paths.where("distance > 0").groupBy(F.col("source").alias("id")).agg(
        F.sum(1 / F.col("distance")).alias("closeness")
    )
    return nodes.select("id").join(sums, "id", "left").withColumn("closeness", F.coalesce("closeness", F.lit(-1.0)))


def hop_centrality(nodes: DataFrame, paths: DataFrame, alpha: float = 0.5) -> DataFrame:
    """id, centrality: sum of alpha ** hops of the cheapest way to every other node."""
    sums = paths.where("hops > 0").groupBy(F.col("source").alias("id")).agg(
        F.sum(F.pow(F.lit(alpha), F.col("hops"))).alias("centrality")
    )
    return nodes.select("id").join(sums, "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))


def betweenness(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """id, visits: how many of the kept ways pass through a node.

    Counts flow up the tree of previous nodes: a node passes on 1 for itself and what it
    got; rounds go from the most hops down.
    """
    tree = cut(paths.select("source", "node", "previous", "hops"))
    deepest = tree.agg(F.max("hops")).first()[0] or 0
    below = tree.select("source", "node", F.lit(0).cast("bigint").alias("got")).limit(0)
    total = None
    for hops in range(deepest, 0, -1):
        here = tree.where(F.col("hops") == hops).join(below, ["source", "node"], "left")
        here = here.withColumn("got", F.coalesce("got", F.lit(0)))
        seen = here.select(F.col("node").alias("id"), F.col("got").alias("visits"))
        total = seen if total is None else total.unionByName(seen)
        below = cut(
            here.groupBy("source", F.col("previous").alias("node")).agg(F.sum(F.col("got") + 1).alias("got"))
        )
    if total is None:
        return nodes.select("id", F.lit(0).cast("bigint").alias("visits"))
    sums = total.groupBy("id").agg(F.sum("visits").alias("visits"))
    return nodes.select("id").join(sums, "id", "left").withColumn("visits", F.coalesce("visits", F.lit(0)))


def modularity(arcs: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, modularity: sum over communities of inner share minus squared degree share.

    ``communities`` has id, community; arcs are undirected and weighted.
    """
    half = both_ways(arcs)
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    joined = half.join(a, "src").join(b, "dst")
    sums = joined.groupBy("ca").agg(
        F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inner"),
        F.sum("weight").alias("all"),
    )
    return sums.agg(
        F.sum("inner").alias("inner"), F.sum(F.col("all") * F.col("all")).alias("squares"), F.sum("all").alias("m2")
    ).select((F.col("inner") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def community_weights(arcs: DataFrame, communities: DataFrame) -> DataFrame:
    """community, inner, outer: weights of arcs inside, and of those that leave it."""
    half = both_ways(arcs)
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("community"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    joined = half.join(a, "src").join(b, "dst")
    same = F.col("community") == F.col("other")
    return joined.groupBy("community").agg(
        (F.sum(F.when(same, F.col("weight")).otherwise(0.0)) / 2).alias("inner"),
        F.sum(F.when(same, 0.0).otherwise(F.col("weight"))).alias("outer"),
    )


def roll_up(nodes: DataFrame, arcs: DataFrame, communities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network of communities: (id, x, y, n) and (src, dst, weight = number of arcs)."""
    placed = nodes.join(communities, "id")
    up = placed.groupBy("community").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")
    ).withColumnRenamed("community", "id")
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    between = (
        arcs.join(a, "src")
        .join(b, "dst")
        .where("ca != cb")
        .groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst"))
        .agg(F.count("*").cast("double").alias("weight"))
    )
    return up, between


def weisfeiler_lehman(labels_a: DataFrame, arcs_a: DataFrame, labels_b: DataFrame, arcs_b: DataFrame) -> DataFrame:
    """One row, similarity of two networks after one round: shared over all labels, -1 if empty.

    ``labels`` have id, label; a node's new label is the MD5 of its own and its arcs'
    sorted far labels.
    """
    def counted(labels, arcs):
        far = both_ways(arcs).join(labels.select(F.col("id").alias("dst"), F.col("label").alias("far")), "dst")
        lists = far.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("far")).alias("far"))
        joined = labels.join(lists, "id", "left")
        text = F.concat_ws("|", F.col("label"), F.array_join(F.coalesce("far", F.array().cast("array<string>")), ","))
        return joined.groupBy(F.md5(text.cast("binary")).alias("h")).agg(F.count("*").alias("n"))

    a, b = counted(labels_a, arcs_a), counted(labels_b, arcs_b).withColumnRenamed("n", "m")
    both = a.join(b, "h", "full").select(
        F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("same"),
        F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("all"),
    )
    return both.agg(F.coalesce(F.sum("same") / F.sum("all"), F.lit(-1.0)).alias("similarity"))


class Packed:
    """A network as flat arrays: ids in order, places, and each node's arcs in one run."""

    def __init__(self, nodes: pd.DataFrame, half: pd.DataFrame):
        nodes = nodes.drop_duplicates("id").sort_values("id")
        self.ids = nodes["id"].to_numpy(np.int64)
        self.x, self.y = nodes["x"].to_numpy(float), nodes["y"].to_numpy(float)
        known = half["src"].isin(self.ids) & half["dst"].isin(self.ids)
        half = half[known].sort_values(["src", "dst", "weight"])
        self.start = np.searchsorted(half["src"].to_numpy(np.int64), self.ids)
        self.end = np.searchsorted(half["src"].to_numpy(np.int64), self.ids, "right")
        self.to = np.searchsorted(self.ids, half["dst"].to_numpy(np.int64))
        self.weight = half["weight"].to_numpy(float)

    def place(self, node) -> int | None:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else None

    def search(self, source, target, greedy: int | None, exact: bool) -> tuple:
        """(exists, distance, path) by A* from ``source`` to ``target``."""
        s, t = self.place(source), self.place(target)
        if s is None or t is None:
            return False, None, []
        straight = lambda n: float(np.hypot(self.x[n] - self.x[t], self.y[n] - self.y[t]))
        limit = float("inf") if exact else 10 * max(straight(s), 1e-12)
        cost, came, queue, closed = {s: 0.0}, {}, [(straight(s), s)], set()
        while queue:
            _, n = heapq.heappop(queue)
            if n == t:
                break
            if n in closed:
                continue
            closed.add(n)
            arcs = slice(self.start[n], self.end[n])
            for m, w in zip(self.to[arcs].tolist(), self.weight[arcs].tolist(), strict=True):
                g = cost[n] + w
                if m not in closed and g < cost.get(m, limit):
                    cost[m], came[m] = g, n
                    heapq.heappush(queue, (g + (0 if exact else straight(m)), m))
                    if m == t and not exact:
                        queue.clear()
                        break
            if greedy and len(queue) > greedy:
                queue = heapq.nsmallest(greedy, queue)
        if t not in cost:
            return False, None, []
        path = [t]
        while path[-1] in came:
            path.append(came[path[-1]])
        return True, cost[t], self.ids[path[::-1]].tolist()


ROUTES = "source bigint, target bigint, exists boolean, distance double, path array<bigint>"


def astar(nodes: DataFrame, half: DataFrame, pairs: DataFrame, greedy: int | None = None, exact: bool = False) -> DataFrame:
    """source, target, exists, distance, path for (source, target) pairs, by A*.

    The straight line is the heuristic. Unless ``exact``, a search stops when the target
    is first seen and leaves out nodes over ten times the straight way, so a way can be
    longer than the shortest. ``greedy`` keeps only as many open nodes. A network of
    ``SHARED_NODES`` and ``SHARED_ARCS`` at most is broadcast and pairs are spread over
    tasks. A larger one is relaxed by joins if ``exact``; else it raises. Arcs at unknown
    nodes don't count; an unknown source or target doesn't exist.
    """
    spark = nodes.sparkSession
    small = (
        nodes.limit(SHARED_NODES + 1).count() <= SHARED_NODES
        and half.limit(SHARED_ARCS + 1).count() <= SHARED_ARCS
    )
    if not small:
        if not exact:
            raise ValueError("the network is larger than this operator's stated bound")
        return _relaxed_routes(nodes, half, pairs)
    packed = spark.sparkContext.broadcast(
        Packed(nodes.select("id", "x", "y").toPandas(), half.select("src", "dst", "weight").toPandas())
    )

    def run(frames):
        network = packed.value
        for frame in frames:
            found = [network.search(s, t, greedy, exact) for s, t in zip(frame["source"], frame["target"], strict=True)]
            yield frame[["source", "target"]].assign(
                exists=[f[0] for f in found], distance=[f[1] for f in found], path=[f[2] for f in found]
            )

    return pairs.select("source", "target").mapInPandas(run, ROUTES)


def _relaxed_routes(nodes: DataFrame, half: DataFrame, pairs: DataFrame) -> DataFrame:
    """Routes by ``shortest_paths`` from all sources, then back along the previous nodes."""
    known = nodes.select("id").distinct()
    for end in ("src", "dst"):
        half = half.join(known.withColumnRenamed("id", end), end, "left_semi")
    ends = pairs.select("source", "target").distinct()
    sources = ends.select(F.col("source").alias("id")).distinct().join(known, "id", "left_semi")
    best = cut(shortest_paths(cut(half.select("src", "dst", "weight")), sources))
    step = best.select("source", "node", "previous")
    reached = ends.join(best.select("source", F.col("node").alias("target"), "distance"), ["source", "target"])
    now = cut(reached.select("source", "target", "distance", F.col("target").alias("node"), F.array("target").alias("path")))
    done = []
    while not now.isEmpty():
        on = now.join(step, ["source", "node"])
        done.append(cut(on.where("previous is null").select("source", "target", "distance", "path")))
        now = cut(
            on.where("previous is not null").select(
                "source", "target", "distance", F.col("previous").alias("node"), F.concat(F.array("previous"), "path").alias("path")
            )
        )
    found = reached.limit(0).withColumn("path", F.array("target"))
    for d in done:
        found = found.unionByName(d)
    none = F.array().cast("array<bigint>")
    return pairs.select("source", "target").join(found, ["source", "target"], "left").select(
        "source", "target", F.col("distance").isNotNull().alias("exists"), "distance", F.coalesce("path", none).alias("path")
    )


def louvain(half: DataFrame, levels: int = 10) -> DataFrame:
    """id, community by greedy moves and merging; order by id makes it repeatable.

    A network of up to ``ONE_TASK_NODES`` is one task. A larger one first moves its nodes
    in rounds of joins and merges what came together, until it is small enough or no node
    moves any more. Communities are named by their least id.
    """
    def run(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        if len(rows):
            yield _louvain(rows, levels)

    arcs = half.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    member = None
    while True:
        size = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().limit(ONE_TASK_NODES + 1).count()
        if size <= ONE_TASK_NODES:
            found = arcs.coalesce(1).mapInPandas(run, "id bigint, community bigint")
            break
        found = _moved(arcs)
        if found.where("id != community").isEmpty():
            break
        member, arcs = _merged(arcs, found, member)
    if member is None:
        return found
    top = found.select(F.col("id").alias("community"), F.col("community").alias("top"))
    joined = member.join(top, "community", "left").withColumn("top", F.coalesce("top", "community"))
    least = joined.groupBy("top").agg(F.min("id").alias("community"))
    return joined.drop("community").join(least, "top").select("id", "community")


def _moved(arcs: DataFrame, rounds: int = 40) -> DataFrame:
    """id, community after rounds in which every node weighs all communities beside it.

    A hash lets about half the nodes move in a round, so neighbours don't swap for ever;
    rounds end when neither half would move. Sums by (node, community) are made before
    nodes compare, and a community is one row, whatever its size.
    """
    degree = cut(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
    total = degree.agg(F.sum("k").alias("t")).first().t or 1.0
    home = cut(degree.select("id", "k", F.col("id").alias("community")))
    still = 0
    for i in range(rounds):
        weight = home.groupBy("community").agg(F.sum("k").alias("all"))
        beside = (
            arcs.where("src != dst")
            .join(home.select(F.col("id").alias("dst"), "community"), "dst")
            .groupBy(F.col("src").alias("id"), "community")
            .agg(F.sum("weight").alias("links"))
        )
        own = home.select("id", "community", F.lit(0.0).alias("links"))
        options = beside.unionByName(own).groupBy("id", "community").agg(F.sum("links").alias("links"))
        mine = home.select("id", "k", F.col("community").alias("was"))
        gain = F.col("links") - (F.col("all") - F.when(F.col("community") == F.col("was"), F.col("k")).otherwise(0.0)) * F.col("k") / total
        rank = F.struct(F.round(gain, 12), (F.col("community") == F.col("was")).cast("int"), -F.col("community"))
        best = (
            options.join(weight, "community")
            .join(mine, "id")
            .groupBy("id", "k", "was")
            .agg(F.max_by("community", rank).alias("best"))
        )
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        new = cut(best.select("id", "k", F.when(turn, F.col("best")).otherwise(F.col("was")).alias("community"), "was"))
        still = still + 1 if new.where("community != was").isEmpty() else 0
        home = new.drop("was")
        if still == 2:
            break
    least = home.groupBy("community").agg(F.min("id").alias("least"))
    return cut(home.join(least, "community").select("id", F.col("least").alias("community")))


def _merged(arcs: DataFrame, found: DataFrame, member: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Members under their new communities, and the arcs between these."""
    if member is None:
        member = found
    else:
        up = found.select(F.col("id").alias("community"), F.col("community").alias("up"))
        member = member.join(up, "community").select("id", F.col("up").alias("community"))
    for end in ("src", "dst"):
        up = found.select(F.col("id").alias(end), F.col("community").alias("up"))
        arcs = arcs.join(up, end).drop(end).withColumnRenamed("up", end)
    return cut(member), cut(arcs.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def _louvain(rows: pd.DataFrame, levels: int) -> pd.DataFrame:
    near: dict = defaultdict(lambda: defaultdict(float))
    for s, d, w in rows.itertuples(index=False):
        near[s][d] += w
        near[d]
    member = {n: n for n in near}
    for _ in range(levels):
        total = sum(sum(v.values()) for v in near.values()) or 1.0
        degree = {n: sum(v.values()) for n, v in near.items()}
        home, weight = {n: n for n in near}, dict(degree)
        moved, any_move = True, False
        while moved:
            moved = False
            for n in sorted(near):
                links: dict = defaultdict(float)
                for m, w in near[n].items():
                    if m != n:
                        links[home[m]] += w
                own = home[n]
                weight[own] -= degree[n]
                gain = lambda c: links.get(c, 0.0) - weight[c] * degree[n] / total  # noqa: B023, E731
                best = max(sorted({*links, own}), key=lambda c: (round(gain(c), 12), c == own))
                weight[best] += degree[n]
                if best != own:
                    home[n], moved, any_move = best, True, True
        if not any_move:
            break
        merged: dict = defaultdict(lambda: defaultdict(float))
        for n, v in near.items():
            merged[home[n]]
            for m, w in v.items():
                merged[home[n]][home[m]] += w
        near, member = merged, {n: home[c] for n, c in member.items()}
    least = pd.Series(member).groupby(pd.Series(member)).apply(lambda s: min(s.index)).to_dict()
    return pd.DataFrame({"id": list(member), "community": [least[c] for c in member.values()]})


def girvan_newman(half: DataFrame, max_communities: int = 4) -> DataFrame:
    """id, community: the partition of most modularity while busiest arcs are taken out.

    One task that searches from every node again and again: networks over
    ``GIRVAN_NEWMAN_NODES`` raise.
    """
    within(half.select("src").distinct(), GIRVAN_NEWMAN_NODES, "nodes")

    def run(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        if len(rows):
            yield _girvan_newman(rows, max_communities)

    return half.select("src", "dst", "weight").coalesce(1).mapInPandas(run, "id bigint, community bigint")


def _girvan_newman(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    near: dict = defaultdict(dict)
    for s, d, w in rows.itertuples(index=False):
        near[s][d] = min(w, near[s].get(d, w))
        near[d].setdefault(s, w)
    original = {n: dict(v) for n, v in near.items()}

    def parts():
        seen, out = set(), []
        for n in sorted(near):
            if n not in seen:
                stack, part = [n], set()
                while stack:
                    m = stack.pop()
                    if m not in part:
                        part.add(m)
                        stack += near[m]
                seen |= part
                out.append(part)
        return out

    def quality(groups):
        home = {n: i for i, g in enumerate(groups) for n in g}
        total = sum(len(v) for v in original.values()) or 1
        inner = sum(home[a] == home[b] for a, v in original.items() for b in v)
        return inner / total - sum((sum(len(original[n]) for n in g) / total) ** 2 for g in groups)

    best, score = parts(), -1.0
    while True:
        now = parts()
        if quality(now) > score:
            best, score = now, quality(now)
        if len(now) >= most or not any(near.values()):
            break
        used: dict = defaultdict(int)
        for s in sorted(near):
            done, came, queue = {}, {}, [(0.0, s, None)]
            while queue:
                g, n, p = heapq.heappop(queue)
                if n in done:
                    continue
                done[n], came[n] = g, p
                for m, w in near[n].items():
                    if m not in done:
                        heapq.heappush(queue, (g + w, m, n))
            for n in came:
                while came[n] is not None:
                    used[tuple(sorted((n, came[n])))] += 1
                    n = came[n]
        a, b = max(sorted(used), key=used.get)
        near[a].pop(b, None)
        near[b].pop(a, None)
    return pd.DataFrame([(n, min(g)) for g in best for n in sorted(g)], columns=["id", "community"])


def random_walks(half: DataFrame, starts: DataFrame, steps: int = 10, seed: int = 0) -> DataFrame:
    """walk, step, node: seeded uniform walks from each start (walk, id), all at once.

    A step joins the walkers with their node's arcs and keeps the arc that a hash of
    walk and step ranks first, so nothing random has to be remembered.
    """
    now = starts.select("walk", F.lit(0).alias("step"), F.col("id").alias("node"))
    out = [now]
    for step in range(1, steps + 1):
        pick = F.xxhash64(F.lit(seed), F.col("walk"), F.lit(step), F.col("dst"))
        now = cut(
            now.join(half, now.node == half.src)
            .groupBy("walk")
            .agg(F.min_by("dst", pick).alias("node"))
            .select("walk", F.lit(step).alias("step"), "node")
        )
        out.append(now)
    all_steps = out[0]
    for o in out[1:]:
        all_steps = all_steps.unionByName(o)
    return all_steps


def link_nearest(nodes: DataFrame, k: int, max_distance: float, judge: Column | None = None) -> DataFrame:
    """src, dst, weight: each node to its k nearest others within the distance.

    ``judge`` is an expression over the columns of both nodes (suffix ``_b`` for the far
    one); only pairs that it holds for are linked.
    """
    from .spatial_joins import within_distance

    pairs = within_distance(nodes, nodes, max_distance).where("query_id != id")
    if judge is not None:
        near = nodes.withColumnRenamed("id", "query_id")
        far = nodes.select(*(F.col(c).alias("id" if c == "id" else f"{c}_b") for c in nodes.columns))
        pairs = pairs.select("query_id", "id", "distance").join(near, "query_id").join(far, "id").where(judge)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        pairs.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= k)
        .select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("weight"))
    )


def delaunay(points: DataFrame) -> DataFrame:
    """a, b, c: ids of the triangles of a Delaunay triangulation (Bowyer-Watson).

    One task; over ``DELAUNAY_POINTS`` points it raises.
    """
    within(points, DELAUNAY_POINTS, "points")

    def run(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        if len(rows) >= 3:
            yield pd.DataFrame(_delaunay(rows), columns=["a", "b", "c"])

    return points.select("id", "x", "y").coalesce(1).mapInPandas(run, "a bigint, b bigint, c bigint")


def _delaunay(rows: pd.DataFrame) -> list[tuple]:
    rows = rows.drop_duplicates(["x", "y"]).sort_values("id")
    place = {int(i): (x, y) for i, x, y in rows.itertuples(index=False)}
    xs, ys = rows["x"], rows["y"]
    span = max(xs.max() - xs.min(), ys.max() - ys.min(), 1.0) * 1000
    cx, cy = (xs.max() + xs.min()) / 2, (ys.max() + ys.min()) / 2
    place |= {-1: (cx - 2 * span, cy - span), -2: (cx + 2 * span, cy - span), -3: (cx, cy + 2 * span)}

    def circle(t):
        (ax, ay), (bx, by), (qx, qy) = (place[i] for i in t)
        d = 2 * (ax * (by - qy) + bx * (qy - ay) + qx * (ay - by))
        if d == 0:
            return 0.0, 0.0, -1.0
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, qx * qx + qy * qy
        ux = (a2 * (by - qy) + b2 * (qy - ay) + c2 * (ay - by)) / d
        uy = (a2 * (qx - bx) + b2 * (ax - qx) + c2 * (bx - ax)) / d
        return ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2

    triangles = {(-1, -2, -3): circle((-1, -2, -3))}
    for i in rows["id"].astype(int):
        x, y = place[i]
        bad = [t for t, (ux, uy, r) in triangles.items() if (x - ux) ** 2 + (y - uy) ** 2 < r * (1 + 1e-12)]
        edges: dict = defaultdict(int)
        for t in bad:
            del triangles[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[tuple(sorted(e))] += 1
        for (a, b), n in edges.items():
            if n == 1:
                t = (a, b, i)
                triangles[t] = circle(t)
    return sorted(tuple(sorted(t)) for t in triangles if min(t) >= 0)


def link_delaunay(points: DataFrame, longest: float | None = None) -> DataFrame:
    """src, dst, weight of the triangulation's edges, shorter than ``longest`` if given."""
    t = delaunay(points)
    edges = t.select(
        F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")), F.struct("a", F.col("c").alias("b")))).alias("e")
    ).select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).distinct()
    out = resolve(points, edges).select("src", "dst", F.col("length").alias("weight"))
    return out if longest is None else out.where(F.col("weight") < longest)


def route(nodes: DataFrame, arcs: DataFrame, trips: DataFrame, tolerance: float) -> DataFrame:
    """id, exists, impedance, path between two places (x1, y1) and (x2, y2) of each trip.

    Both places are snapped to their nearest arc (id, src, dst, x1, y1, x2, y2); the way
    runs between the arcs' nearer ends and counts the steps to them. A trip whose place
    has no arc in reach doesn't exist.
    """
    from .spatial_joins import snap_to_arcs

    arcs = cut(arcs)
    place = lambda end, x, y: F.struct(F.lit(end).alias("end"), F.col(x).alias("x"), F.col(y).alias("y"))
    both = trips.select("id", F.explode(F.array(place(0, "x1", "y1"), place(1, "x2", "y2"))).alias("at"))
    s = snap_to_arcs(both.select(F.struct("id", "at.end").alias("id"), "at.x", "at.y"), arcs, tolerance)
    a = arcs.select(F.col("id").alias("arc_id"), "src", "dst", "x1", "y1", "x2", "y2")
    d1 = geodesy.planar_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))
    d2 = geodesy.planar_distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    near = F.least(F.struct(d1.alias("d"), F.col("src").alias("n")), F.struct(d2.alias("d"), F.col("dst").alias("n")))
    snapped = s.join(a, "arc_id").select("point_id.*", near["n"].alias("n"), (F.col("distance") + near["d"]).alias("step"))
    of = lambda end, c: F.min(F.when(F.col("end") == end, F.col(c)))
    placed = snapped.groupBy("id").agg(
        of(0, "n").alias("source"), of(0, "step").alias("source_step"), of(1, "n").alias("target"), of(1, "step").alias("target_step")
    ).where("source is not null and target is not null")
    half = both_ways(arcs.withColumn("weight", geodesy.planar_distance(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))))
    found = astar(nodes, half, placed.select("source", "target").distinct(), exact=True)
    # Both grow with the trips, so they are never broadcast.
    joined = trips.select("id").join(placed.hint("merge"), "id", "left").join(found.hint("merge"), ["source", "target"], "left")
    return joined.select(
        "id",
        F.coalesce("exists", F.lit(False)).alias("exists"),
        (F.col("distance") + F.col("source_step") + F.col("target_step")).alias("impedance"),
        "path",
    )


def spatial_communities(nodes: DataFrame, arcs: DataFrame, radius: float) -> DataFrame:
    """id, community grown in id order: the strongest link first, within reach of the centre
    and while modularity does not fall. One task; over ``ONE_TASK_NODES`` nodes it raises."""
    within(nodes, ONE_TASK_NODES, "nodes")
    rows = both_ways(arcs).join(nodes.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy")), "src", "right")

    def run(frames):
        table = pd.concat(list(frames), ignore_index=True)
        place = {int(r.id): (r.sx, r.sy) for r in table.itertuples(index=False)}
        near: dict = defaultdict(dict)
        for r in table.dropna(subset=["dst"]).itertuples(index=False):
            near[int(r.id)][int(r.dst)] = near[int(r.id)].get(int(r.dst), 0.0) + r.weight
        degree = {n: sum(near[n].values()) for n in place}
        total = sum(degree.values()) or 1.0
        home: dict = {}
        for seed in sorted(place):
            if seed in home:
                continue
            members = [seed]
            home[seed] = seed
            while True:
                cx = sum(place[m][0] for m in members) / len(members)
                cy = sum(place[m][1] for m in members) / len(members)
                links: dict = defaultdict(float)
                for m in members:
                    for n, w in near[m].items():
                        if n not in home:
                            links[n] += w
                weight = sum(degree[m] for m in members)
                options = [
                    (w, -n)
                    for n, w in links.items()
                    if (place[n][0] - cx) ** 2 + (place[n][1] - cy) ** 2 <= radius**2 and w - degree[n] * weight / total >= 0
                ]
                if not options:
                    break
                n = -max(options)[1]
                home[n] = seed
                members.append(n)
        yield pd.DataFrame({"id": list(home), "community": list(home.values())})

    table = rows.select(F.col("src").alias("id"), "dst", "weight", "sx", "sy")
    return table.coalesce(1).mapInPandas(run, "id bigint, community bigint")
