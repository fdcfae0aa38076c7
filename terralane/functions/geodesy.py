"""Distances, directions and feet of perpendiculars as Column expressions.

Coordinates are doubles; ``geographic`` says whether they are degrees (great circle,
metres) or planar units. Every function is null if an argument is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
#: Great-circle lengths are cut to a tenth of a millimetre.
GREAT_CIRCLE_STEP = 10000.0


def planar_distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1))


def great_circle(lon1, lat1, lon2, lat2) -> Column:
    """Haversine metres on a sphere, cut (not rounded) to 1e-4 m."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((a - b) / 2), F.sin((F.radians(lon1) - F.radians(lon2)) / 2)
    arc = 2 * F.asin(F.sqrt(half_lat * half_lat + F.cos(a) * F.cos(b) * half_lon * half_lon))
    return F.floor(arc * EARTH_RADIUS * GREAT_CIRCLE_STEP) / GREAT_CIRCLE_STEP


def distance(x1, y1, x2, y2, geographic: bool = True) -> Column:
    return (great_circle if geographic else planar_distance)(x1, y1, x2, y2)


def direction_angle(x1, y1, x2, y2) -> Column:
    """Degrees clockwise from north; -1 for equal points, 360 (not 0) for due north."""
    bearing = F.degrees(F.atan((x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))))
    return (
        F.when((x1 == x2) & (y1 == y2), -1.0)
        .when(y1 == y2, F.when(x1 < x2, 90.0).otherwise(270.0))
        .when(x1 < x2, F.when(y1 < y2, bearing).otherwise(bearing + 180))
        .otherwise(F.when(y1 < y2, bearing + 360).otherwise(bearing + 180))
    )


def horizontal_angle(x1, y1, x2, y2) -> Column:
    """Degrees counter-clockwise from +x in [0, 360); -1 for equal points."""
    turned = F.degrees(F.atan((y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))))
    return (
        F.when((x1 == x2) & (y1 == y2), -1.0)
        .when(x1 == x2, F.when(y2 > y1, 90.0).otherwise(270.0))
        .when(x2 > x1, F.when(turned < 0, turned + 360).otherwise(turned))
        .otherwise(turned + 180)
    )


def direction_angle_geographic(lon1, lat1, lon2, lat2) -> Column:
    """As direction_angle, on great-circle legs; due north is 0 here."""
    south, west = lat1 > lat2, ~(lon1 < lon2)
    dy = great_circle(lon1, lat1, lon1, lat2) * F.when(south, -1).otherwise(1)
    dx = great_circle(lon1, lat2, lon2, lat2) * F.when(west, -1).otherwise(1)
    angle = F.degrees(F.atan(dx / F.nullif(dy, F.lit(0.0))))
    eastern = F.when((angle == 0) & south, 180.0).when(angle < 0, angle + 180).otherwise(angle)
    western = (
        F.when(angle == 0, F.when(south, 180.0).otherwise(0.0))
        .when(angle > 0, angle + 180)
        .otherwise(angle + 360)
    )
    return (
        F.when((lon1 == lon2) & (lat1 == lat2), -1.0)
        .when(lat1 == lat2, F.when(west, 270.0).otherwise(90.0))
        .when(west, western)
        .otherwise(eastern)
    )


def direction(x1, y1, x2, y2, geographic: bool = True) -> Column:
    return (direction_angle_geographic if geographic else direction_angle)(x1, y1, x2, y2)


def along(ax, ay, bx, by, px, py) -> Column:
    """Place of the foot of p on the line a-b: 0 at a, 1 at b; null if a equals b."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(square, F.lit(0.0))


def foot_on_line(ax, ay, bx, by, px, py) -> Column:
    """Foot on the endless line; the point a if the segment has no length."""
    t = F.coalesce(along(ax, ay, bx, by, px, py), F.lit(0.0))
    return F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y"))


def nearest_on_segment(ax, ay, bx, by, px, py) -> Column:
    """Foot if it lies on the segment, else the nearer end."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along(ax, ay, bx, by, px, py), F.lit(0.0))))
    return F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y"))


def foot_or_null(ax, ay, bx, by, px, py) -> Column:
    """Foot if it lies on the segment, else null."""
    t = along(ax, ay, bx, by, px, py)
    return F.when(t.between(0, 1), foot_on_line(ax, ay, bx, by, px, py))


def foot_class(ax, ay, bx, by, px, py) -> Column:
    """-1 before a, 0 on the segment, 1 beyond b."""
    t = F.coalesce(along(ax, ay, bx, by, px, py), F.lit(0.0))
    return F.when(t < 0, -1).when(t > 1, 1).otherwise(0)


def point_segment_distance(ax, ay, bx, by, px, py, geographic: bool = False) -> Column:
    """To the nearest point of the segment; geographic: planar foot, great-circle metres."""
    near = nearest_on_segment(ax, ay, bx, by, px, py)
    return distance(px, py, near["x"], near["y"], geographic)


def side_of_line(ax, ay, bx, by, px, py) -> Column:
    """Sign of the cross product: 1 left of a-b, -1 right, 0 on it."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax)).cast("int")


def nearly_equal(x1, y1, x2, y2, tolerance: float = 1e-6) -> Column:
    return (F.abs(x1 - x2) <= tolerance) & (F.abs(y1 - y2) <= tolerance)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy, at_ends: bool = True) -> Column:
    """Whether two segments meet; ``at_ends`` False leaves out shared end points."""
    d1, d2 = side_of_line(cx, cy, dx, dy, ax, ay), side_of_line(cx, cy, dx, dy, bx, by)
    d3, d4 = side_of_line(ax, ay, bx, by, cx, cy), side_of_line(ax, ay, bx, by, dx, dy)

    def within(px, py, qx, qy, rx, ry):
        return (
            rx.between(F.least(px, qx), F.greatest(px, qx))
            & ry.between(F.least(py, qy), F.greatest(py, qy))
        )

    meets = (
        ((d1 * d2 < 0) & (d3 * d4 < 0))
        | ((d1 == 0) & within(cx, cy, dx, dy, ax, ay))
        | ((d2 == 0) & within(cx, cy, dx, dy, bx, by))
        | ((d3 == 0) & within(ax, ay, bx, by, cx, cy))
        | ((d4 == 0) & within(ax, ay, bx, by, dx, dy))
    )
    if at_ends:
        return meets
    shared = (
        nearly_equal(ax, ay, cx, cy, 0)
        | nearly_equal(ax, ay, dx, dy, 0)
        | nearly_equal(bx, by, cx, cy, 0)
        | nearly_equal(bx, by, dx, dy, 0)
    )
    return meets & ~shared


def _half_up(v: Column, places: int) -> Column:
    """Rounded as SQL rounds doubles: the scaled double to the nearer integer, halves away from zero.

    Spark's ``round`` goes by the shortest decimal text, which can lie on the other side of a half.
    """
    scale = 10.0**places
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale


def segment_intersection(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Crossing point of two segments, to 6 decimals; null if none or parallel."""
    cross = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(cross, F.lit(0.0))
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.nullif(cross, F.lit(0.0))
    return F.when(
        t.between(0, 1) & u.between(0, 1),
        F.struct(
            _half_up(ax + t * (bx - ax), 6).alias("x"), _half_up(ay + t * (by - ay), 6).alias("y")
        ),
    )


def segment_distance(ax, ay, bx, by, cx, cy, dx, dy, geographic: bool = False) -> Column:
    """0 if the segments meet, else the least end-to-segment distance."""
    to = lambda *p: point_segment_distance(*p, geographic=geographic)
    return F.when(segments_cross(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(
        F.least(
            to(cx, cy, dx, dy, ax, ay),
            to(cx, cy, dx, dy, bx, by),
            to(ax, ay, bx, by, cx, cy),
            to(ax, ay, bx, by, dx, dy),
        )
    )


def distance_3d(x1, y1, z1, x2, y2, z2, geographic: bool = False) -> Column:
    flat = distance(x1, y1, x2, y2, geographic)
    return F.sqrt(flat * flat + (z1 - z2) * (z1 - z2))


def colour_distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two RGBA colours."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def midpoint(x1, y1, x2, y2) -> Column:
    return F.struct(((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"))
