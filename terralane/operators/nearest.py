"""The nearest segments of points, exact, within square tiles: a quadtree over the points of a
tile whose nodes keep only the segments that can still be among the nearest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

#: Points that one task holds at once; a tile with more is dealt out over several groups.
BLOCK_POINTS = 100_000
#: Pairs of points and segments that a leaf of the quadtree measures at once.
LEAF_PAIRS = 8192
SLACK = 1e-6
FOUND = "id {kind}, arc {arc}, distance double, foot_x double, foot_y double, px double, py double"


def _measured(px, py, x1, y1, dx, dy, square):
    """(t unclipped, distance with t clipped) in the order of operations of the SQL."""
    ux, uy = px - x1, py - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (ux * dx + uy * dy) / square
    s = np.clip(np.where(square > 0, t, 0.0), 0.0, 1.0)
    ex, ey = ux - s * dx, uy - s * dy
    return t, s, np.sqrt(ex * ex + ey * ey)


def nearest_in_tile(points: np.ndarray, arcs: np.ndarray, k: int, reach: float, feet: bool):
    """(point, arc, t, distance) places of the k nearest arcs within ``reach`` of every point.

    ``arcs`` (x1, y1, x2, y2) are in the order that breaks ties. With ``feet`` only arcs count
    that the perpendicular of a point meets.
    """
    x1, y1 = arcs[:, 0], arcs[:, 1]
    dx, dy = arcs[:, 2] - x1, arcs[:, 3] - y1
    square = dx * dx + dy * dy
    length = np.sqrt(square)
    out: list = []
    xs, ys = points[:, 0], points[:, 1]
    todo = [(np.arange(len(points)), np.arange(len(arcs)))]
    while todo:
        p, a = todo.pop()
        px, py = xs[p], ys[p]
        left, right, low, high = px.min(), px.max(), py.min(), py.max()
        cx, cy = (left + right) / 2, (low + high) / 2
        h = float(np.hypot(right - left, high - low)) / 2
        t, _, d = _measured(cx, cy, x1[a], y1[a], dx[a], dy[a], square[a])
        slack = SLACK * (1 + h + abs(cx) + abs(cy)) / 1000
        limit = reach + h
        sure = d
        if feet:
            # How far beyond its ends a foot can fall: no farther than the points spread.
            off = np.maximum(-t, t - 1) * length[a]
            may = (square[a] > 0) & (off <= h + slack)
            a, d, off = a[may], d[may], off[may]
            sure = d[off < -h - slack]
        if len(sure) >= k:
            limit = min(limit, float(np.partition(sure, k - 1)[k - 1]) + 2 * h)
        a = a[d <= limit + slack]
        if not len(a):
            continue
        if len(p) * len(a) > LEAF_PAIRS and h > 0:
            # Halves of the longer side, at the middle of the box.
            side = px < cx if right - left >= high - low else py < cy
            if side.any() and not side.all():
                todo += [(p[side], a), (p[~side], a)]
                continue
        step = max(1, LEAF_PAIRS * 16 // len(a))
        for i in range(0, len(p), step):
            q = p[i : i + step]
            t, s, d = _measured(xs[q][:, None], ys[q][:, None], x1[a], y1[a], dx[a], dy[a], square[a])
            good = d <= reach
            if feet:
                good &= (square[a] > 0) & (t >= 0) & (t <= 1)
            d = np.where(good, d, np.inf)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, best, 1)
            row, col = np.nonzero(near < np.inf)
            where = best[row, col]
            out.append((q[row], a[where], s[row, where], near[row, col]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_arcs(points: DataFrame, arcs: DataFrame, reach: float, k: int, feet: bool = False) -> DataFrame:
    """id, arc, distance, foot_x, foot_y, px, py: the k nearest arcs within ``reach``, ties to the least arc.

    ``points`` has id, x, y (id may be a struct), ``arcs`` id, x1, y1, x2, y2, planar. A point is
    in one tile, an arc in all tiles that its box comes near; no pair leaves a task but the k
    nearest. A task holds ``BLOCK_POINTS`` points, on average, and the arcs of one tile; of equal
    arcs only the k least ids are looked at. Points and arcs without a place have no neighbours.
    """
    size = 2.0 * reach
    known = lambda *c: " and ".join(f"{v} is not null and not isnan({v})" for v in c)
    floor = lambda c, by: F.floor(by / size) if c is None else F.floor(F.col(c) / size)
    kind, arc_kind = (df.schema["id"].dataType.simpleString() for df in (points, arcs))
    # The cast makes all fields nullable, as the declared result has them.
    p = points.where(known("x", "y")).withColumns({"id": F.col("id").cast(kind), "_tx": floor("x", None), "_ty": floor("y", None)})
    blocks = p.groupBy("_tx", "_ty").agg(F.ceil(F.count("*") / BLOCK_POINTS).cast("int").alias("_blocks"))
    same = Window.partitionBy("x1", "y1", "x2", "y2").orderBy("id")
    some = arcs.where(known("x1", "y1", "x2", "y2")).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k)
    # Cells are a little wider than the reach, so that rounding leaves no arc out.
    wide = reach * (1 + 1e-9) + 1e-9
    span = lambda c: F.explode(
        F.sequence(floor(None, F.least(f"{c}1", f"{c}2") - wide), floor(None, F.greatest(f"{c}1", f"{c}2") + wide))
    )
    spread = some.select(F.col("id").alias("arc"), "x1", "y1", "x2", "y2", span("x").alias("_tx")).select(
        "*", span("y").alias("_ty")
    )
    tiled = p.join(blocks, ["_tx", "_ty"]).select(
        "id", "x", "y", "_tx", "_ty", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_blocks")).alias("_block")
    )
    dealt = spread.join(blocks, ["_tx", "_ty"]).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("arc", "x1", "y1", "x2", "y2", "_tx", "_ty", F.col("_block").cast("bigint").alias("_block"))
    key = ["_tx", "_ty", "_block"]
    schema = FOUND.format(kind=kind, arc=arc_kind)

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        right = right.sort_by("arc")
        column = lambda t, c: t.column(c).to_numpy()
        places, back = np.unique(np.stack([column(left, "x"), column(left, "y")], 1), axis=0, return_inverse=True)
        back = back.ravel()
        ends = np.stack([column(right, c) for c in ("x1", "y1", "x2", "y2")], 1)
        if len(places) and len(ends):
            at, arc, s, d = nearest_in_tile(places, ends, k, reach, feet)
        else:
            at = arc = np.zeros(0, int)
            s = d = np.zeros(0)
        # The results of a place go to all its points.
        order = np.argsort(at, kind="stable")
        at, arc, s, d = at[order], arc[order], s[order], d[order]
        first, last = np.searchsorted(at, back), np.searchsorted(at, back, "right")
        count = last - first
        row = np.repeat(np.arange(len(back)), count)
        hit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        e, w = ends[arc[hit]], s[hit]
        xy = places[back[row]]
        ids = pc.take(left.column("id"), pa.array(row))
        names = pc.take(right.column("arc"), pa.array(arc[hit]))
        data = [d[hit], e[:, 0] + w * (e[:, 2] - e[:, 0]), e[:, 1] + w * (e[:, 3] - e[:, 1]), xy[:, 0], xy[:, 1]]
        return pa.table([ids, names, *map(pa.array, data)], names=["id", "arc", "distance", "foot_x", "foot_y", "px", "py"])

    return tiled.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(run, schema)


def nearest_places(queries: DataFrame, points: DataFrame, radius: float, k: int) -> DataFrame:
    """query_id, id, distance of the k nearest points (id, x, y) within the radius, ties to the least id.

    Most queries have k points close by, so a 32nd and an eighth of the radius are tried first and
    only queries left over meet the points of wider tiles.
    """
    ends = points.select("id", *(F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in "xy"))
    left, done = queries.select(F.struct(F.col("id").alias("query_id"), "x", "y").alias("id"), "x", "y"), None
    for reach in (radius / 32, radius / 8, radius):
        found = cut(nearest_arcs(left, ends, reach, k))
        if reach < radius:
            whole = found.groupBy("id").count().where(F.col("count") >= k).select("id")
            left = cut(left.join(whole, "id", "left_anti"))
            found = found.join(whole, "id", "left_semi")
        done = found if done is None else done.unionByName(found)
    return done.select("id.query_id", F.col("arc").alias("id"), "distance")
