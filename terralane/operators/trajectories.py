"""Track operators over point tables (traj_id, seq, ts, x, y, ...).

Order within a track is (ts, seq). Everything relational is a window or an aggregate;
only filters whose next step depends on what they kept so far run as a fold over one
track (``applyInPandas``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralane.functions import geodesy

SPLIT_SECONDS = 300.0
SPLIT_METRES = 5000.0
MAX_SPEED = 33.333333

INTERVAL_BOUNDS = (1, 5, 10, 20, 30, 60, 120, 300, 600, 1800, 3600, 7200, 14400, 28800)
DISTANCE_BOUNDS = (1, 10, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 500000)
QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def track_order() -> Window:
    return Window.partitionBy("traj_id").orderBy("ts", "seq")


def segments(points: DataFrame, geographic: bool = True) -> DataFrame:
    """Each point with the one after it: ts2, x2, y2, length, seconds; last points drop out."""
    w = track_order()
    led = points.withColumns({f"{c}2": F.lead(c).over(w) for c in ("ts", "x", "y", "seq")})
    x, y, x2, y2 = map(F.col, ("x", "y", "x2", "y2"))
    return led.where(F.col("ts2").isNotNull()).withColumns(
        {
            "length": geodesy.distance(x, y, x2, y2, geographic),
            "seconds": F.col("ts2") - F.col("ts"),
        }
    )


def summaries(points: DataFrame, geographic: bool = True) -> DataFrame:
    """traj_id, n_segments, length, max_speed of each track."""
    s = segments(points, geographic)
    speed = F.col("length") / F.nullif("seconds", F.lit(0.0))
    return s.groupBy("traj_id").agg(
        F.count("*").alias("n_segments"),
        F.sum("length").alias("length"),
        F.max(speed).alias("max_speed"),
    )


def gap_split(
    points: DataFrame,
    max_seconds: float = SPLIT_SECONDS,
    max_distance: float = SPLIT_METRES,
    geographic: bool = True,
    min_points: int = 2,
) -> DataFrame:
    """Add part (0, 1, ...): a new one where a step takes too long or goes too far.

    Parts of fewer than ``min_points`` points are dropped.
    """
    w = track_order()
    before = {c: F.lag(c).over(w) for c in ("ts", "x", "y")}
    jump = (F.col("ts") - before["ts"] >= max_seconds) | (
        geodesy.distance(before["x"], before["y"], F.col("x"), F.col("y"), geographic) >= max_distance
    )
    marked = points.withColumn("_jump", F.coalesce(jump.cast("int"), F.lit(0)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    parted = marked.withColumn("part", F.sum("_jump").over(running).cast("bigint")).drop("_jump")
    size = F.count("*").over(Window.partitionBy("traj_id", "part"))
    return parted.withColumn("_n", size).where(F.col("_n") >= min_points).drop("_n")


def length_filter(points: DataFrame, low=None, high=None, geographic: bool = True) -> DataFrame:
    """Points of tracks whose length lies within the bounds, both inclusive."""
    total = segments(points, geographic).groupBy("traj_id").agg(F.sum("length").alias("length"))
    fits = F.lit(True)
    fits = fits & (F.col("length") >= low) if low is not None else fits
    fits = fits & (F.col("length") <= high) if high is not None else fits
    return points.join(total.where(fits).select("traj_id"), "traj_id", "left_semi")


def duration_filter(points: DataFrame, shorter=None, longer=None) -> DataFrame:
    """Points of tracks that last less than ``shorter`` or at least ``longer`` seconds."""
    span = points.groupBy("traj_id").agg((F.max("ts") - F.min("ts")).alias("span"))
    fits = F.lit(True)
    fits = fits & (F.col("span") < shorter) if shorter is not None else fits
    fits = fits & (F.col("span") >= longer) if longer is not None else fits
    return points.join(span.where(fits).select("traj_id"), "traj_id", "left_semi")


def box_filter(points: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def inside(x: Column, y: Column, rings) -> Column:
    """Even-odd test of a point in a polygon's rings, given as literals.

    A point on the left or lower border counts as inside, on the others as outside.
    """
    crossings = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 == y2:
                continue
            straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crossings = crossings + F.when(straddles & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def origins_destinations(points: DataFrame, geographic: bool = True) -> DataFrame:
    """One trip for each track: ends, times, length, seconds, speed (length over seconds)."""
    key = F.struct("ts", "seq")
    ends = points.groupBy("traj_id").agg(
        F.min_by(F.struct("ts", "x", "y"), key).alias("o"),
        F.max_by(F.struct("ts", "x", "y"), key).alias("d"),
    )
    total = segments(points, geographic).groupBy("traj_id").agg(F.sum("length").alias("length"))
    seconds = F.col("d.ts") - F.col("o.ts")
    return ends.join(total, "traj_id", "left").select(
        "traj_id",
        F.col("o.ts").alias("start_ts"),
        F.col("o.x").alias("start_x"),
        F.col("o.y").alias("start_y"),
        F.col("d.ts").alias("end_ts"),
        F.col("d.x").alias("end_x"),
        F.col("d.y").alias("end_y"),
        F.coalesce("length", F.lit(0.0)).alias("length"),
        seconds.alias("seconds"),
        (F.coalesce("length", F.lit(0.0)) / F.nullif(seconds, F.lit(0.0))).alias("speed"),
    )


def region_filter(points: DataFrame, rings, mode: str = "od", geographic: bool = True) -> DataFrame:
    """Points of tracks by where they start and end.

    ``origin``: start inside, end outside; ``destination``: the other way; ``od``:
    either; ``intersect``: any point inside.
    """
    hit = inside(F.col("x"), F.col("y"), rings)
    if mode == "intersect":
        chosen = points.groupBy("traj_id").agg(F.bool_or(hit).alias("ok"))
    else:
        ends = origins_destinations(points, geographic).select(
            "traj_id",
            inside(F.col("start_x"), F.col("start_y"), rings).alias("o"),
            inside(F.col("end_x"), F.col("end_y"), rings).alias("d"),
        )
        ok = {
            "origin": F.col("o") & ~F.col("d"),
            "destination": ~F.col("o") & F.col("d"),
            "od": F.col("o") != F.col("d"),
        }[mode]
        chosen = ends.withColumn("ok", ok)
    return points.join(chosen.where("ok").select("traj_id"), "traj_id", "left_semi")


def snapshot(points: DataFrame, at: float, geographic: bool = True) -> DataFrame:
    """Where each track is at a time: x, y between the points around it, speed, direction."""
    s = segments(points, geographic).where((F.col("ts") <= at) & (F.col("ts2") > at))
    share = (F.lit(at) - F.col("ts")) / F.col("seconds")
    ends = [F.col(c) for c in ("x", "y", "x2", "y2")]
    return s.where("length > 0").select(
        "traj_id",
        F.lit(at).alias("ts"),
        (F.col("x") + share * (F.col("x2") - F.col("x"))).alias("x"),
        (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("y"),
        (F.col("length") / F.col("seconds")).alias("speed"),
        geodesy.direction(*ends, geographic).alias("direction"),
    )


def resample_time(points: DataFrame, step: float, geographic: bool = True) -> DataFrame:
    """Points every ``step`` seconds from a track's start, before its end; then its last point."""
    first = F.min("ts").over(Window.partitionBy("traj_id"))
    s = segments(points.withColumn("t0", first), geographic).where("seconds > 0")
    low = F.ceil((F.col("ts") - F.col("t0")) / step)
    high = F.ceil((F.col("ts2") - F.col("t0")) / step) - 1
    ticks = s.where(high >= low).withColumn("k", F.explode(F.sequence(low, high)))
    at = F.col("t0") + F.col("k") * step
    share = (at - F.col("ts")) / F.col("seconds")
    moved = ticks.select(
        "traj_id",
        at.alias("ts"),
        (F.col("x") + share * (F.col("x2") - F.col("x"))).alias("x"),
        (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("y"),
    )
    last = points.groupBy("traj_id").agg(F.max_by(F.struct("ts", "x", "y"), F.struct("ts", "seq")).alias("l"))
    return moved.unionByName(last.select("traj_id", "l.ts", "l.x", "l.y"))


def resample_distance(points: DataFrame, step: float, geographic: bool = True) -> DataFrame:
    """Points every ``step`` of length along a track, from 0, short of its end."""
    w = track_order().rowsBetween(Window.unboundedPreceding, -1)
    s = segments(points, geographic).withColumn("done", F.coalesce(F.sum("length").over(w), F.lit(0.0)))
    s = s.where("length > 0")
    low = F.ceil(F.col("done") / step)
    high = F.ceil((F.col("done") + F.col("length")) / step) - 1
    ticks = s.where(high >= low).withColumn("k", F.explode(F.sequence(low, high)))
    share = (F.col("k") * step - F.col("done")) / F.col("length")
    return ticks.select(
        "traj_id",
        F.col("k").alias("k"),
        (F.col("ts") + share * F.col("seconds")).alias("ts"),
        (F.col("x") + share * (F.col("x2") - F.col("x"))).alias("x"),
        (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("y"),
    )


def bucket_of(value: Column, bounds) -> Column:
    """Label of the first bound that is not exceeded; the last label is open."""
    label = None
    for low, high in zip((None, *bounds), bounds, strict=False):
        name = f"<={high}" if low is None else f"{low}-{high}"
        label = F.when(value <= high, name) if label is None else label.when(value <= high, name)
    return label.otherwise(f">{bounds[-1]}")


def histogram(points: DataFrame, what: str = "seconds", geographic: bool = True) -> DataFrame:
    """bucket, n over all segments, by interval (seconds) or length."""
    bounds = INTERVAL_BOUNDS if what == "seconds" else DISTANCE_BOUNDS
    return (
        segments(points, geographic)
        .groupBy(bucket_of(F.col(what), bounds).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def statistics(points: DataFrame, geographic: bool = True) -> DataFrame:
    """One row: averages of interval, length and speed, exact quantiles, first and last time.

    Everything is summed by whole second of the interval first; the last step sees one row
    for each second that occurs, not one for each segment.
    """
    s = segments(points, geographic)
    speed = F.when(F.col("seconds") > 0, F.round(F.col("length") / F.col("seconds"), 3)).otherwise(0.0)
    by_second = s.groupBy(F.floor("seconds").alias("second")).agg(
        F.count("*").alias("n"),
        F.sum("seconds").alias("seconds"),
        F.sum("length").alias("length"),
        F.sum(speed).alias("speed"),
        F.min("ts").alias("ts"),
        F.max("ts2").alias("ts2"),
    )
    one = by_second.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_segments"),
        *((F.sum(c) / F.sum("n")).alias(f"avg_{c}") for c in ("seconds", "length", "speed")),
        F.min("ts").alias("first_ts"),
        F.max("ts2").alias("last_ts"),
        F.percentile("second", F.array(*map(F.lit, QUANTILES)), F.col("n")).alias("q"),
    )
    quantiles = [F.get("q", F.lit(i)).alias(f"seconds_q{int(q * 1000)}") for i, q in enumerate(QUANTILES)]
    return one.select(*[c for c in one.columns if c != "q"], *quantiles)


def length_quantiles(points: DataFrame, geographic: bool = True) -> DataFrame:
    """q, length: the value at place floor(n * q) of the sorted lengths, without one big sort.

    Lengths are counted first by millimetre-floored value; running counts over those
    partial sums find the place.
    """
    counted = segments(points, geographic).groupBy("length").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))
    wanted = total.select(
        "all", F.explode(F.array(*map(F.lit, QUANTILES))).alias("q")
    ).withColumn("place", F.floor(F.col("all") * F.col("q")))
    # Ranges of values are summed first, so the running sum over ranges is short.
    ranged = counted.withColumn("range", F.floor(F.log2(F.col("length") + 1) * 64))
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("n"))
    upto = ranges.withColumn(
        "before",
        F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
    )
    hit = F.broadcast(upto).join(F.broadcast(wanted), F.col("place").between(F.col("before"), F.col("before") + F.col("n") - 1))
    inner = ranged.select("range", "length", F.col("n").alias("m")).join(
        F.broadcast(hit.select("range", "q", "place", "before")), "range"
    )
    running = Window.partitionBy("q").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    return (
        inner.withColumn("upto", F.col("before") + F.sum("m").over(running))
        .where("upto > place")
        .groupBy("q")
        .agg(F.min("length").alias("length"))
    )


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def as_lines(points: DataFrame, geographic: bool = True) -> DataFrame:
    """traj_id, line (points in order), length: tracks as a line layer."""
    lines = points.groupBy("traj_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ts", "seq", "x", "y"))),
            lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")),
        ).alias("line")
    )
    total = segments(points, geographic).groupBy("traj_id").agg(F.sum("length").alias("length"))
    return lines.join(total, "traj_id", "left").withColumn("length", F.coalesce("length", F.lit(0.0)))


def smooth_heights(vertices: DataFrame, average: bool = False) -> DataFrame:
    """Interior z from both neighbours, each weighted by the other's distance.

    ``vertices`` has line_id, seq, x, y, z. With ``average`` the result is the mean of
    that and the old z. End points stay.
    """
    w = Window.partitionBy("line_id").orderBy("seq")
    at = {f"{c}{s}": f(c).over(w) for c in "xyz" for s, f in (("_", F.lag), ("2", F.lead))}
    v = vertices.withColumns(at)
    d1 = geodesy.planar_distance(F.col("x_"), F.col("y_"), F.col("x"), F.col("y"))
    d2 = geodesy.planar_distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    p = d1 / F.nullif(d1 + d2, F.lit(0.0))
    z = F.col("z_") * (1 - p) + F.col("z2") * p
    z = (z + F.col("z")) / 2 if average else z
    return v.withColumn("z", F.coalesce(z, F.col("z"))).drop(*at)


def _edge_distance(a, b) -> Column:
    """From (x, y) to the edge of two literal corners.

    The edge's direction is the difference of the decimals as written, not of their doubles,
    so points that are equally far off a slanted edge don't differ by the corners' rounding.
    """
    x, y = F.col("x"), F.col("y")
    dx, dy = (float(Decimal(repr(float(q))) - Decimal(repr(float(p)))) for p, q in zip(a, b, strict=True))
    square = dx * dx + dy * dy
    t = ((x - a[0]) * dx + (y - a[1]) * dy) / square if square else F.lit(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return geodesy.planar_distance(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]), x, y)


def in_out_split(points: DataFrame, polygon, min_points: int = 2) -> DataFrame:
    """Add part and kind (``in``/``out``): a track cut where it comes into a region.

    A run outside that ends inside is cut at its point farthest from the region: up to
    there it is an out part, the rest of it and the run inside are an in part. A last
    run outside is an out part. Parts of fewer points are dropped.
    """
    hit = inside(F.col("x"), F.col("y"), polygon)
    away = None
    for ring in polygon:
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            d = _edge_distance(a, b)
            away = d if away is None else F.least(away, d)
    w = track_order()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = points.withColumns({"_in": hit, "_away": F.when(hit, -1.0).otherwise(away), "_i": F.row_number().over(w)})
    turned = F.coalesce((F.col("_in") != F.lag("_in").over(w)).cast("int"), F.lit(0))
    runs = marked.withColumn("_turn", turned).withColumn("_run", F.sum("_turn").over(upto))
    last = F.max("_run").over(Window.partitionBy("traj_id"))
    far = F.max_by("_i", F.struct("_away", "_i")).over(Window.partitionBy("traj_id", "_run"))
    cut = runs.withColumns({"_last": last, "_far": far})
    out = ~F.col("_in") & ((F.col("_run") == F.col("_last")) | (F.col("_i") <= F.col("_far")))
    kinds = cut.withColumn("kind", F.when(out, "out").otherwise("in"))
    new = F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(0))
    parted = kinds.withColumn("_new", new).withColumn("part", F.sum("_new").over(upto).cast("bigint"))
    sized = parted.withColumn("_n", F.count("*").over(Window.partitionBy("traj_id", "part")))
    return sized.where(F.col("_n") >= min_points).drop(*(c for c in sized.columns if c.startswith("_")))


def creator_filter(points: DataFrame, creator: str = "default", geographic: bool = True) -> DataFrame:
    """The point filter that goes with a reader: default, ais or flight."""
    from . import folds

    if creator == "default":
        return folds.drop_same_place(folds.drop_overspeed(points, geographic=geographic), geographic)
    w = track_order()
    step = geodesy.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"), geographic)
    same = F.col("ts") == F.lag("ts").over(w)
    gone = same & (step < 10) if creator == "ais" else step <= 1e-4
    return points.withColumn("_gone", F.coalesce(gone, F.lit(False))).where(~F.col("_gone")).drop("_gone")


def report(points: DataFrame, geographic: bool = True) -> DataFrame:
    """name, value: the statistics and both histograms as text rows, for any text sink."""
    s = statistics(points, geographic)
    rows = s.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in s.columns))).alias("r")).select("r.*")
    for what in ("seconds", "length"):
        h = histogram(points, what, geographic)
        rows = rows.unionByName(h.select(F.concat(F.lit(f"{what} "), "bucket").alias("name"), F.col("n").cast("string").alias("value")))
    return rows
