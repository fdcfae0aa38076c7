"""Overlay, WKB, coordinate systems, settings and layer edits."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from terralane import config
from terralane.functions import crs, overlay
from terralane.functions.geometries import GEOMETRY
from terralane.operators import layers, networks
from terralane.operators import trajectories as T
from terralane.sources import wkb


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_clip_equals_sampling():
    window = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    for ring in ([(-1.0, -1.0), (2.0, 5.0), (6.0, 1.0)], [(1.0, 1.0), (2.0, 1.0), (1.0, 2.0)], [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)]):
        for w in (window, window[::-1]):
            got = overlay.clip(ring, w)
            n, hit = 400, 0
            for i in range(n):
                for j in range(n):
                    x, y = 4 * (i + 0.5) / n, 3 * (j + 0.5) / n
                    side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
                    hit += all(side) or not any(side)
            assert abs((area(got) if got else 0) - 12 * hit / n**2) < 0.05


def test_line_buffers():
    straight = overlay.buffer_line([(0, 0), (10, 0)], 1.0, steps=64)
    assert abs(area(straight) - (20 + math.pi)) < 0.01
    left = overlay.buffer_line([(0, 0), (10, 0)], 2.0, "left")
    assert area(left) == 20 and max(y for _, y in left) == 2
    assert overlay.buffer_line([], 1.0) == [] and len(overlay.buffer_line([(1, 1), (1, 1)], 1.0)) == 33


def test_fill_leaves_holes_out():
    cells = overlay.fill_cells([[(0, 0), (0, 5), (5, 5), (5, 0)], [(1, 1), (1, 3), (3, 3), (3, 1)]], 1.0)
    assert len(cells) == 25 - 4 and (1, 1) not in cells and (0, 0) in cells


SHAPES = [
    ("POINT", [[(1.0, 2.0)]]),
    ("LINESTRING", [[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]]),
    ("POLYGON", [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (1.0, 2.0)]]),
    ("MULTIPOINT", [[(1.0, 2.0)], [(3.0, 4.0)]]),
    ("MULTILINESTRING", [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)]]),
    ("MULTIPOLYGON", [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(9.0, 9.0), (9.0, 10.0), (10.0, 10.0), (9.0, 9.0)]]),
]


@pytest.mark.parametrize(("kind", "parts"), SHAPES)
def test_wkb(kind, parts):
    assert wkb.parse(wkb.emit(kind, parts)) == (kind, parts)


def test_wkb_frames_and_byte_order(spark):
    big = b"\0" + struct.pack(">I2d", 1, 3.5, -1.0)
    assert wkb.parse(big) == ("POINT", [[(3.5, -1.0)]])
    rows = [(i, {"type": k, "parts": [[{"x": x, "y": y} for x, y in p] for p in parts]}) for i, (k, parts) in enumerate(SHAPES)]
    df = spark.createDataFrame([*rows, (9, None)], f"id long, geom {GEOMETRY}")
    back = wkb.from_wkb(wkb.to_wkb(df).drop("geom"))
    assert back.orderBy("id").select("geom").collect() == df.orderBy("id").select("geom").collect()
    with pytest.raises(ValueError):
        wkb.parse(struct.pack("<BI", 1, 99))


def test_crs_texts():
    u = crs.Crs("U", "projected", method="Lambert_Conformal_Conic", parameters={"central_meridian": 105.0, "standard_parallel_1": 20.0, "standard_parallel_2": 40.0})
    back = crs.parse_wkt(u.to_wkt())
    assert back.projection() == u.projection() and back.projection().standard_parallel_2 == 40.0
    assert crs.parse_wkt(crs.WGS84.to_wkt()) == crs.WGS84
    assert crs.parse_wkt("rubbish").kind == "unknown" and crs.parse_wkt(None) == crs.UNKNOWN
    with pytest.raises(ValueError):
        crs.Crs("U", "projected", method="Nothing").projection()


def test_settings(spark):
    assert config.get(spark, "grid.scale") == "500" and config.get(spark, "nothing") == ""
    config.put(spark, "grid.scale", "250")
    assert config.get(spark, "grid.scale") == "250"
    spark.conf.unset(config.PREFIX + "grid.scale")


def test_layer_edits(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "fid long, name string")
    with pytest.raises(ValueError):
        layers.add_column(df, "name", "int")
    with pytest.raises(ValueError):
        layers.add_column(df, "much_too_long_name", "int")
    assert layers.feature(df, -1).first().fid == 4 and layers.feature(df, 0).first().fid == 0
    with pytest.raises(IndexError):
        layers.feature(df, 5)
    assert layers.set_cell(df, 3, "name", "x").where("fid = 3").first().name == "x"
    assert layers.delete_rows(df).count() == 5


def test_in_out_split(spark):
    square = [[(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]]
    xs = [30, 40, 35, 20, 5, 6, 20, 30, 40]
    df = spark.createDataFrame([(1, i, float(i), float(x), 5.0) for i, x in enumerate(xs)], "traj_id long, seq long, ts double, x double, y double")
    got = [(r.seq, r.kind, r.part) for r in T.in_out_split(df, square).orderBy("seq").collect()]
    assert got == [(0, "out", 0), (1, "out", 0), (2, "in", 1), (3, "in", 1), (4, "in", 1), (5, "in", 1), (6, "out", 2), (7, "out", 2), (8, "out", 2)]


def test_route_with_snapping(spark):
    nodes = spark.createDataFrame([(i, float(i * 10), 0.0) for i in range(6)], "id long, x double, y double")
    arcs = spark.createDataFrame([(i, i, i + 1, i * 10.0, 0.0, i * 10 + 10.0, 0.0) for i in range(5)], "id long, src long, dst long, x1 double, y1 double, x2 double, y2 double")
    trips = spark.createDataFrame([(1, 2.0, 1.0, 41.0, -1.0), (2, 0.0, 90.0, 5.0, 5.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r for r in networks.route(nodes, arcs, trips, 3.0).collect()}
    assert got[1].exists and got[1].path == [0, 1, 2, 3, 4] and not got[2].exists
    # to the arc and along it to the nearer end, at both places
    assert abs(got[1].impedance - (40 + (1 + 2) + (1 + 1))) < 1e-9


def test_random_walks_stay_on_arcs(spark):
    arcs = [(i, (i * 7 + 1) % 20, 1.0) for i in range(20)]
    half = networks.both_ways(spark.createDataFrame(arcs, "src long, dst long, weight double")).distinct()
    starts = spark.range(20).select(F.col("id").alias("walk"), "id")
    steps = sorted((r.walk, r.step, r.node) for r in networks.random_walks(half, starts, steps=4, seed=3).collect())
    edges = {(r.src, r.dst) for r in half.collect()}
    assert len(steps) == 100
    for (w, s, n), (w2, s2, n2) in zip(steps, steps[1:], strict=False):
        if w == w2:
            assert s2 == s + 1 and (n, n2) in edges
