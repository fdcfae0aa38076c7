"""Filters and segmentations whose next step depends on what they kept: one track at a time.

Each takes a point table and returns one of the same columns (or a named schema). A
group is one track; its size is bounded by what one vehicle records, and days can be
split off first with ``trajectories.gap_split``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trajectories import MAX_SPEED

_RADIUS = 6378137.0


def _metres(x1, y1, x2, y2, geographic: bool):
    if not geographic:
        return np.hypot(x2 - x1, y2 - y1)
    lon1, lat1, lon2, lat2 = map(np.radians, (x1, y1, x2, y2))
    h = np.sin((lat1 - lat2) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon1 - lon2) / 2) ** 2
    return np.floor(2 * np.arcsin(np.sqrt(h)) * _RADIUS * 1e4) / 1e4


def _by_track(points: DataFrame, keep) -> DataFrame:
    def run(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values(["ts", "seq"], kind="stable").reset_index(drop=True)
        return track.iloc[keep(track)]

    return points.groupBy("traj_id").applyInPandas(run, points.schema)


def drop_overspeed(points: DataFrame, max_speed: float = MAX_SPEED, geographic: bool = True) -> DataFrame:
    """Drop a point at or before the last kept one's time, or reached too fast from it."""
    def keep(t):
        ts, x, y = (t[c].to_numpy() for c in ("ts", "x", "y"))
        kept: list[int] = []
        for i in range(len(ts)):
            if kept:
                k = kept[-1]
                dt = ts[i] - ts[k]
                if dt <= 0 or _metres(x[k], y[k], x[i], y[i], geographic) / dt > max_speed:
                    continue
            kept.append(i)
        return kept

    return _by_track(points, keep)


def drop_same_place(points: DataFrame, geographic: bool = True, parity: bool = False) -> DataFrame:
    """Drop the middle of three points if it stands still on both sides.

    ``parity`` drops it whenever both distances are equal. On a plane and without
    ``parity`` the point before stands for the last kept one, so this is a window.
    """
    if not geographic and not parity:
        order = Window.partitionBy("traj_id").orderBy("ts", "seq")
        same = [F.lag(c).over(order) == F.col(c) for c in "xy"] + [F.lead(c).over(order) == F.col(c) for c in "xy"]
        still = F.coalesce(same[0] & same[1] & same[2] & same[3], F.lit(False))
        return points.withColumn("_still", still).where(~F.col("_still")).drop("_still")

    def keep(t):
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        kept = list(range(min(1, len(x))))
        for i in range(1, len(x) - 1):
            k = kept[-1]
            a = _metres(x[k], y[k], x[i], y[i], geographic)
            b = _metres(x[i], y[i], x[i + 1], y[i + 1], geographic)
            if not (a == b if parity else a == 0 and b == 0):
                kept.append(i)
        if len(x) > 1:
            kept.append(len(x) - 1)
        return kept

    return _by_track(points, keep)


def drop_ping_pong(points: DataFrame) -> DataFrame:
    """Collapse runs A B A B A ... of two places to their first A and last point."""
    def keep(t):
        place = list(zip(t["x"], t["y"], strict=True))
        kept, i, n = [], 0, len(place)
        while i < n:
            j = i
            while j + 2 < n and place[j + 2] == place[j] and place[j + 1] != place[j]:
                j += 1
            kept.append(i)
            if j > i + 1:
                i = j + 1
                kept.append(i)
            i += 1
        return [k for k in dict.fromkeys(kept) if k < n]

    return _by_track(points, keep)


def drop_frequent_turns(
    points: DataFrame, min_angle: float = 120.0, window: float = 60.0, times: int = 3
) -> DataFrame:
    """Drop a point that turns sharply where as many sharp turns follow within the window.

    A turn compares the headings of the segments before and after a point; the point's own
    turn counts, and so do all later ones up to ``window`` seconds after it.
    """
    order = Window.partitionBy("traj_id").orderBy("ts", "seq")
    heading = F.atan2(F.lead("y").over(order) - F.col("y"), F.lead("x").over(order) - F.col("x"))
    turned = points.withColumn("_heading", heading)
    change = F.col("_heading") - F.lag("_heading").over(order)
    turn = F.degrees(F.abs(F.pmod(change + math.pi, F.lit(2 * math.pi)) - math.pi))
    sharp = turned.withColumn("_sharp", F.coalesce((turn > min_angle).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum("_sharp").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    until = F.expr(
        "sum(_sharp) over (partition by traj_id order by ts range between unbounded preceding "
        f"and {float(window)!r}D following)"
    )
    followed = sharp.withColumn("_n", until - before)
    return followed.where(~((F.col("_sharp") == 1) & (F.col("_n") >= times))).drop("_heading", "_sharp", "_n")


STAY_SCHEMA = (
    "traj_id bigint, part int, kind string, start_ts double, end_ts double, n bigint, "
    "xmin double, ymin double, xmax double, ymax double, speed double"
)


def stays_and_moves(
    points: DataFrame, tolerance: float = 200.0, min_seconds: float = 1800.0, geographic: bool = True
) -> DataFrame:
    """Alternating stays and moves of each track, with times, bounds and mean speed.

    Points are buffered while each lies within ``tolerance`` of the buffer's first; a
    buffer that lasts longer than ``min_seconds`` is a stay, and a move bridges two.
    """
    def run(track: pd.DataFrame) -> pd.DataFrame:
        t = track.sort_values(["ts", "seq"], kind="stable")
        ts, x, y = (t[c].to_numpy(dtype=float) for c in ("ts", "x", "y"))
        stays, i, n = [], 0, len(ts)
        while i < n:
            j = i
            while j + 1 < n and _metres(x[i], y[i], x[j + 1], y[j + 1], geographic) <= tolerance:
                j += 1
            if ts[j] - ts[i] > min_seconds:
                stays.append((i, j))
                i = j + 1
            else:
                i += 1
        parts, at = [], 0
        for i, j in stays:
            if i > at:
                parts.append(("move", at, i))
            parts.append(("stay", i, j))
            at = j
        if at < n - 1:
            parts.append(("move", at, n - 1))
        rows = []
        for k, (kind, i, j) in enumerate(parts):
            span = ts[j] - ts[i]
            way = float(_metres(x[i:j], y[i:j], x[i + 1 : j + 1], y[i + 1 : j + 1], geographic).sum())
            pad = (1e-7 if geographic else 5.0) if kind == "stay" else 0.0
            xs, ys = x[i : j + 1], y[i : j + 1]
            px, py = pad * (xs.min() == xs.max()), pad * (ys.min() == ys.max())
            rows.append(
                (t["traj_id"].iloc[0], k, kind, ts[i], ts[j], j - i + 1)
                + (xs.min() - px, ys.min() - py, xs.max() + px, ys.max() + py)
                + (way / span if span > 0 else -1.0,)
            )
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STAY_SCHEMA.split(", ")])

    return points.groupBy("traj_id").applyInPandas(run, STAY_SCHEMA)


def split_concurrent(
    points: DataFrame,
    max_speed: float = 30.0,
    max_distance: float = 20000.0,
    max_seconds: float = 7200.0,
    min_points: int = 5,
    geographic: bool = True,
) -> DataFrame:
    """Add part: points of one id that belong to several vehicles at once.

    A point joins the open track whose end it can reach at the least distance, else it
    opens one. Tracks shorter than ``min_points`` are dropped.
    """
    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*points.schema.fields]).add("part", IntegerType())

    def run(track: pd.DataFrame) -> pd.DataFrame:
        t = track.sort_values(["ts", "seq"], kind="stable").reset_index(drop=True)
        ts, x, y = (t[c].to_numpy(dtype=float) for c in ("ts", "x", "y"))
        ends: list[int] = []
        part = np.zeros(len(t), np.int32)
        for i in range(len(t)):
            best, near = -1, np.inf
            for p, e in enumerate(ends):
                dt, d = ts[i] - ts[e], float(_metres(x[e], y[e], x[i], y[i], geographic))
                if 0 < dt <= max_seconds and d <= min(max_distance, max_speed * dt) and d < near:
                    best, near = p, d
            if best < 0:
                ends.append(i)
                best = len(ends) - 1
            ends[best], part[i] = i, best
        t["part"] = part
        return t[t.groupby("part")["part"].transform("size") >= min_points]

    return points.groupBy("traj_id").applyInPandas(run, schema)
