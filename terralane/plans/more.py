"""Queries over layer edits, coordinate systems, overlays and file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terralane.functions import crs, geodesy, geometries, overlay, projections, scalars
from terralane.operators import folds, layers as L, meshes, networks, rasters, spatial_joins
from terralane.operators import trajectories as T
from terralane.operators.checkpoints import shared_folder
from terralane.operators.rasters import Grid
from terralane.sources import geotiff, layers as files, points as P, wkb

from .fixtures import GNSS, NATIONS, PLANAR, REGIONS, SEGMENTS, TRADE, gnss, nations, planar, region_edges_sql, regions, table, trade
from .space import CELL, GRID, HELD, _arcs, _lines
from .tracks import AT, _inside

R = F.round
C = F.col


def scratch(spark, name: str) -> str:
    """A new folder that all machines see, for texts that a query writes and reads back."""
    return f"{shared_folder(spark)}/terralane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _written(spark, lines, name: str) -> str:
    path = scratch(spark, name)
    lines.write.text(path)
    return path


def _collected(spark, lines, head: str, joint: str, tail: str, name: str, files: int = 4) -> str:
    """A folder of ``files`` whole texts, each with its share of the lines (value) between head and tail."""
    def run(batches):
        import pandas as pd

        own = [v for b in batches for v in b["value"]]
        if own:
            yield pd.DataFrame({"value": [head + joint.join(own) + tail]})

    return _written(spark, lines.select("value").repartition(files).mapInPandas(run, "value string"), name)


def s04_csv_points(spark, sf):
    e = gnss(spark, sf)
    line = F.concat_ws(",", "traj_id", "x", "y", scalars.from_epoch(F.floor("ts")))
    path = _written(spark, e.select(line.alias("value")), "csv")
    return P.read_points(spark, path, box=(116.02, 39.0, 116.05, 39.2)).select(
        C("traj_id").cast("bigint").alias("traj_id"), R("x", 6).alias("x"), R("y", 6).alias("y"), R("ts", 0).alias("ts")
    )


_SECOND = "CAST(floor(ts) AS DOUBLE)"


def s05_ais(spark, sf):
    e = gnss(spark, sf)
    line = F.concat_ws("~", "traj_id", F.lit("-"), "kind", "ts", (C("x") * 600000).cast("string"), (C("y") * 600000).cast("string"))
    path = _written(spark, e.select(line.alias("value")), "ais")
    return P.read_ais(spark, path).select(
        C("traj_id").cast("bigint").alias("traj_id"), R("x", 6).alias("x"), R("y", 6).alias("y"), C("extra")["aistype"].alias("kind")
    )


def s06_flights(spark, sf):
    e = gnss(spark, sf)
    blank = [F.lit("")] * 4
    line = F.concat_ws(",", "x", "y", "traj_id", *([F.lit("-")] * 6), F.lit("AAA"), F.lit("-"), F.lit("BBB"), *blank, scalars.from_epoch(F.floor("ts")))
    path = _written(spark, e.select(line.alias("value")), "flights")
    return P.read_flights(spark, path).select(
        C("traj_id").cast("bigint").alias("traj_id"), R("x", 2).alias("x"), C("extra")["Origin"].alias("origin"), C("extra")["Destination"].alias("destination")
    )


def s11_geojson(spark, sf):
    n = nations(spark, sf).select(
        F.struct(F.lit("POINT").alias("type"), F.array(F.array(F.struct("x", "y"))).alias("parts")).alias("geom"),
        F.create_map(F.lit("id"), C("id").cast("string")).alias("properties"),
    )
    each = spark.read.text(_written(spark, files.to_geojson(n), "geojson"))
    back = files.read_geojson(spark, _collected(spark, each, '{"features":[', ",", "]}", "collection"))
    p = F.get(F.get("geom.parts", F.lit(0)), F.lit(0))
    return back.select(C("properties")["id"].cast("bigint").alias("id"), p["x"].alias("x"), p["y"].alias("y"))


def s12_kml(spark, sf):
    n = nations(spark, sf)
    mark = F.format_string('<Placemark id="%d"><name>n%d</name><Point><coordinates>%s,%s,0</coordinates></Point></Placemark>', "id", "id", C("x").cast("string"), C("y").cast("string"))
    k = files.read_kml(spark, _collected(spark, n.select(mark.alias("value")), "<kml>", "", "</kml>", "kml"))
    p = F.get(F.get("geom.parts", F.lit(0)), F.lit(0))
    return k.select(C("id").cast("bigint").alias("id"), "name", p["x"].alias("x"), p["y"].alias("y"))


def s13_osm(spark, sf):
    nodes = nations(spark, sf).select(F.format_string('<node id="%d" lon="%s" lat="%s"/>', "id", C("x").cast("string"), C("y").cast("string")).alias("t"))
    ways = trade(spark, sf).select(
        F.format_string('<way id="%d"><nd ref="%d"/><nd ref="%d"/><tag k="highway" v="%s"/></way>', C("src") * 100 + C("dst"), "src", "dst", F.when((C("src") + C("dst")) % 2 == 0, "primary").otherwise("service")).alias("t")
    )
    lines = nodes.union(ways).withColumnRenamed("t", "value")
    roads = files.read_osm_roads(spark, _collected(spark, lines, "<osm>", "\n", "</osm>", "osm"))
    line = F.get("geom.parts", F.lit(0))
    return roads.select("osm_id", "subtype", R(geometries.line_length(line), 6).alias("length"))


def s08_shapefile(spark, sf):
    """Lines written as shapefiles of a hundred tracks each, parsed again from their bytes."""
    layer = _lines(spark, sf).select("fid", "geom", F.create_map(F.lit("k"), C("fid").cast("string")).alias("attributes"), F.floor(C("fid") / 100).alias("file"))
    made = files.write_shapefile(layer, "", "file")

    def parse(frames):
        import pandas as pd

        for frame in frames:
            rows = [(fid, kind, len(parts), sum(map(len, parts))) for data in frame["content"] for fid, kind, parts, _ in files.parse_shp(bytes(data))]
            yield pd.DataFrame(rows, columns=["place", "shape", "parts", "points"])

    shapes = made.where("extension = 'shp'").mapInPandas(parse, "place bigint, shape string, parts bigint, points bigint")
    return shapes.groupBy("shape").agg(F.count("*").alias("n"), F.sum("parts").alias("parts"), F.sum("points").alias("points"))


def s10_dbf(spark, sf):
    """Parts written as tables of ten thousand rows at most, parsed again from their bytes."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    known = lambda v, kind: None if v is None or v != v else kind(v)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for i in range(0, len(frame), 10_000):
                rows = [
                    {"k": known(k, int), "s": known(s, int), "p": known(p, float), "b": known(b, str)}
                    for k, s, p, b in frame.iloc[i : i + 10_000].itertuples(index=False)
                ]
                back = files.parse_dbf(files.dbf_bytes(rows))[1]
                out = [(r["k"], r["s"], known(r["p"], lambda p: round(p, 2)), r["b"]) for r in back]
                yield pd.DataFrame(out, columns=["k", "s", "p", "b"], dtype=object)

    return part.mapInPandas(run, "k bigint, s bigint, p double, b string")


def s14_geotiff(spark, sf):
    """A density raster as one GeoTIFF, and its cells read back from the bytes."""
    made = geotiff.to_geotiff(rasters.density(gnss(spark, sf), GRID), GRID)

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for data in frame["content"]:
                band = geotiff.parse(bytes(data))["bands"][0]
                rows, cols = np.nonzero(band)
                yield pd.DataFrame({"row": rows, "col": cols, "value": band[rows, cols]})

    return made.mapInPandas(run, "row bigint, col bigint, value double")


def s16_obj(spark, sf):
    v, f = meshes.grid_mesh(spark, 6, 7)
    lines = files.obj_lines(v, f).orderBy(F.desc("kind"), "id").select("value").coalesce(1)
    v2, f2 = files.read_obj(spark, _written(spark, lines, "obj"))
    return meshes.summary(v2, f2).select("n_vertices", "n_edges", "n_faces", R("area", 6).alias("area"))


def s17_empty_layer(spark, sf):
    return L.empty_layer(spark, "fid long, name string")


def s18_crs(spark, sf):
    """A projected system out of its text, applied."""
    utm = crs.Crs("U", "projected", method="Transverse_Mercator", parameters={"central_meridian": 117.0, "scale_factor": 0.9996, "false_easting": 500000.0, "false_northing": 0.0})
    back = crs.project(crs.project(gnss(spark, sf), crs.WGS84, crs.parse_wkt(utm.to_wkt())), crs.parse_wkt(utm.to_wkt()), crs.WGS84)
    return back.select("seq", R("x", 6).alias("x"), R("y", 6).alias("y"))


def s20_wkb(spark, sf):
    back = wkb.from_wkb(wkb.to_wkb(_lines(spark, sf)).drop("geom"))
    return back.select("fid", C("geom.type").alias("type"), F.size("geom.parts").cast("bigint").alias("parts"), R(geometries.perimeter(C("geom")), 2).alias("length"))


def k06_trips(spark, sf):
    trips = T.origins_destinations(gnss(spark, sf)).select("traj_id", R("length", 1).alias("length"))
    path = scratch(spark, "trips")
    trips.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("traj_id bigint, length double").csv(path)


def k07_report(spark, sf):
    return T.report(gnss(spark, sf)).where("name like 'length %' or name like 'seconds %'")


def _report_sql() -> str:
    from .tracks import _bucket_sql

    return f"WITH {SEGMENTS} " + " UNION ALL ".join(
        f"SELECT '{w} ' || b AS name, CAST(count(*) AS VARCHAR) AS value FROM (SELECT {_bucket_sql(w, bounds)} AS b FROM segments) GROUP BY b"
        for w, bounds in (("seconds", T.INTERVAL_BOUNDS), ("length", T.DISTANCE_BOUNDS))
    )


def k08_nodes_arcs(spark, sf):
    r = networks.resolve(nations(spark, sf), trade(spark, sf))
    wkt = F.concat_ws("", F.lit("LINESTRING ("), C("x1").cast("int"), F.lit(" "), C("y1").cast("int"), F.lit(", "), C("x2").cast("int"), F.lit(" "), C("y2").cast("int"), F.lit(")"))
    return r.select(C("src").alias("SNodeID"), C("dst").alias("ENodeID"), wkt.alias("wkt"), C("n").alias("n"))


def k12_hash_split(spark, sf):
    path = scratch(spark, "split")
    P.hash_split(table(spark, sf, "customer").select("c_custkey", "c_name"), path, "c_name", 7)
    return spark.read.parquet(path).groupBy(C("bucket").cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def k13_wkt(spark, sf):
    n = nations(spark, sf).select("id", F.struct(F.lit("POINT").alias("type"), F.array(F.array(F.struct("x", "y"))).alias("parts")).alias("geom"))
    return n.select("id", geometries.to_wkt(C("geom")).alias("wkt"))


def _parts_layer(spark, sf):
    return table(spark, sf, "part").select(C("p_partkey").alias("fid"), C("p_brand").alias("brand"), C("p_size").alias("size"))


def p01_columns(spark, sf):
    return L.delete_columns(L.add_column(_parts_layer(spark, sf), "grade", "int", 7), "size")


def p02_rows(spark, sf):
    a = _parts_layer(spark, sf)
    more = a.where("fid <= 3").select((C("fid") + 1_000_000).alias("fid"), "brand")
    return L.delete_rows(L.append_rows(a, more), 1, 5, 9).fillna(0, ["size"])


def p03_cells(spark, sf):
    a = L.set_cell(_parts_layer(spark, sf), 2, "size", 99)
    text = F.when(C("size") % 3 == 0, " ").otherwise(C("size").cast("string"))
    return a.select("fid", "size", L.number_cell(text).alias("whole"), L.number_cell(text, 2).alias("real"))


def p04_schema(spark, sf):
    return spark.createDataFrame(L.fields(_parts_layer(spark, sf)), "name string, kind string")


def p05_feature(spark, sf):
    a = _parts_layer(spark, sf)
    return L.feature(a, 4).union(L.feature(a, -2))


def p08_rings(spark, sf):
    r = regions(spark).select("region", geometries.group_rings(F.transform("rings", lambda x: x)).alias("p"))
    return r.select("region", F.size("p").cast("bigint").alias("polygons"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, q: s + F.size(q)).alias("rings"))


def p10_edit_points(spark, sf):
    g = planar(spark, sf).select("traj_id", "seq", "ts")
    new = g.where("seq % 1000 = 0").select("traj_id", (C("seq") + 10_000_000).alias("seq"), (C("ts") + 0.5).alias("ts"))
    return T.union_all(g.where("seq % 7 <> 0"), new).groupBy("traj_id").agg(F.count("*").alias("n"))


def p20_families(spark, sf):
    n = nations(spark, sf)
    kind = F.when(C("id") % 3 == 0, "MULTIPOINT").when(C("id") % 3 == 1, "MULTILINESTRING").otherwise("POLYGON")
    two = F.array(F.array(F.struct(C("x"), C("y"))), F.array(F.struct(C("y").alias("x"), C("x").alias("y"))))
    layer = n.select("id", F.struct(kind.alias("type"), two.alias("parts")).alias("geom"))
    out = None
    for name, part in L.by_family(layer).items():
        one = part.select(F.lit(name).alias("family"), "id")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("family").agg(F.count("*").alias("n"))


def p21_colour_edges(spark, sf):
    d = rasters.density(gnss(spark, sf), GRID)
    v = F.least(C("value").cast("int"), F.lit(3))
    return L.colour_edges(d.select("row", "col", v.alias("r"), v.alias("g"), F.lit(0).alias("b")))


def p22_heights(spark, sf):
    v = planar(spark, sf).select(C("traj_id").alias("line_id"), "seq", "x", "y")
    return L.with_heights(v, F.lit(10.0), F.lit(30.0)).select("line_id", "seq", R("z", 5).alias("z"))


def p24_in_out(spark, sf):
    return T.in_out_split(gnss(spark, sf), REGIONS["triangle"]).select("traj_id", "seq", "kind")


def _in_out_sql() -> str:
    dist = []
    for ring in [REGIONS["triangle"][0]]:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            t = f"greatest(0, least(1, ((x - {x1}) * ({x2} - {x1}) + (y - {y1}) * ({y2} - {y1})) / (power({x2} - {x1}, 2) + power({y2} - {y1}, 2))))"
            dist.append(f"sqrt(power(x - ({x1}::DOUBLE + {t} * ({x2}::DOUBLE - {x1}::DOUBLE)), 2) + power(y - ({y1}::DOUBLE + {t} * ({y2}::DOUBLE - {y1}::DOUBLE)), 2))")
    return f"""WITH {GNSS}, {region_edges_sql()}, a AS (
  SELECT traj_id, seq, {_inside('x', 'y', 'triangle')} AS hit, least({', '.join(dist)}) AS d, row_number() OVER (PARTITION BY traj_id ORDER BY ts, seq) AS i FROM gnss
), b AS (SELECT *, CASE WHEN hit <> lag(hit) OVER (PARTITION BY traj_id ORDER BY i) THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT *, sum(turn) OVER (PARTITION BY traj_id ORDER BY i) AS run FROM b),
e AS (SELECT *, max(run) OVER (PARTITION BY traj_id) AS last,
  first_value(i) OVER (PARTITION BY traj_id, run ORDER BY (CASE WHEN hit THEN -1 ELSE d END) DESC, i DESC) AS far FROM c),
f AS (SELECT *, CASE WHEN NOT hit AND (run = last OR i <= far) THEN 'out' ELSE 'in' END AS kind FROM e),
g AS (SELECT *, CASE WHEN kind <> lag(kind) OVER (PARTITION BY traj_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM f),
h AS (SELECT *, sum(new) OVER (PARTITION BY traj_id ORDER BY i) AS part FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY traj_id, part) AS n FROM h)
SELECT traj_id, seq, kind FROM n WHERE n >= 2"""


def q12_ais_filter(spark, sf):
    p = planar(spark, sf).withColumn("ts", F.floor(C("ts") / 50000) * 50000.0).withColumns({c: R(C(c) / 5000, 0) for c in "xy"})
    return T.creator_filter(p, "ais", geographic=False).select("traj_id", "seq")


def q14_contains(spark, sf):
    hit = T.inside(C("x"), C("y"), REGIONS["holed"])
    return gnss(spark, sf).select("seq", hit.alias("inside"))


def q15_cross(spark, sf):
    s = T.segments(gnss(spark, sf))
    line = [F.lit(v) for v in (116.05, 39.0, 116.05, 39.5)]
    return s.select("seq", geodesy.segments_cross(*(C(c) for c in ("x", "y", "x2", "y2")), *line).alias("cross"))


def j02_polygon_index(spark, sf):
    return overlay.polygon_index(regions(spark), 0.01)


def _polygon_cells_sql() -> str:
    parts = [
        f"SELECT cx AS cell_x, cy AS cell_y, '{r}' AS id FROM cells WHERE {_inside('((cx + 0.5) * 0.01::DOUBLE)', '((cy + 0.5) * 0.01::DOUBLE)', r)}"
        for r in REGIONS
    ]
    return f"WITH {region_edges_sql()}, cells AS (SELECT cx, cy FROM range(11590, 11620) t(cx), range(3890, 3950) u(cy)) " + " UNION ALL ".join(parts)


def j06_ordered_index(spark, sf):
    keys = table(spark, sf, "lineitem").select(C("l_partkey").alias("k")).dropDuplicates(["k"])
    return keys.where("k between 100 and 400").orderBy("k")


def j12_snapshot_label(spark, sf):
    s = T.snapshot(gnss(spark, sf), AT)
    return rasters.label_points(s, rasters.density(gnss(spark, sf), GRID), GRID).select("traj_id", "label")


def j15_weld(spark, sf):
    v, f = meshes.grid_mesh(spark, 9, 9)
    p = meshes.placed(v, f)
    corner = p.select("id", F.posexplode(F.array(*(F.struct(*(C(f"{c}{i}").alias(c) for c in "xyz")) for i in range(3)))).alias("k", "c")).select("id", "k", "c.*")
    return L.weld(corner).agg(F.count("*").alias("corners"), F.countDistinct("vertex").alias("vertices"))


def a09_complex(spark, sf):
    s = T.segments(planar(spark, sf), geographic=False)
    both = s.select("x", "y", (C("length") / C("seconds") * 2 + C("seq") % 10).alias("v"))
    r = rasters.property_mean(both, Grid(0.0, 50000.0, 500.0, 2500.0, 20, 20), C("v"))
    return r.select("row", "col", R("value", 5).alias("value"))


def a17_fields(spark, sf):
    e = gnss(spark, sf).select(F.create_map(C("kind"), C("seq").cast("string")).alias("extra"))
    return L.field_set(e)


def w07_stay_attributes(spark, sf):
    s = folds.stays_and_moves(gnss(spark, sf), tolerance=20000.0, min_seconds=20000.0)
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("points"), R(F.avg("speed"), 6).alias("speed"))


def u03_clip(spark, sf):
    window = [(116.03, 39.05), (116.07, 39.05), (116.07, 39.25), (116.03, 39.25)]
    c = overlay.clipped(regions(spark), window)
    return c.select("region", R(F.abs(geometries.ring_area(C("ring"))), 8).alias("area"))


def u04_same_sets(spark, sf):
    a = nations(spark, sf).select("id", "community")
    b = nations(spark, sf).select("id", F.when(C("id") == 3, 0).otherwise(C("community")).alias("community"))
    return a.intersect(b).agg(F.count("*").alias("same")).join(a.exceptAll(b).agg(F.count("*").alias("moved")))


def f12_geometry_distance(spark, sf):
    """Least distance of every line to every region, through their segments."""
    seg = geometries.explode_segments(_lines(spark, sf)).select("fid", "x1", "y1", "x2", "y2")
    scaled = spatial_joins.ring_edges(regions(spark)).select("region", *(((C(c) - b) * 100000).alias(c) for c, b in (("x1", 116), ("y1", 39), ("x2", 116), ("y2", 39))))
    return overlay.segment_distances(seg, scaled).groupBy("fid", "region").agg(R(F.min("distance"), 3).alias("distance"))


def f15_intersections(spark, sf):
    s = T.segments(gnss(spark, sf))
    p = geodesy.segment_intersection(*(C(c) for c in ("x", "y", "x2", "y2")), *(F.lit(v) for v in (116.05, 39.0, 116.05, 39.5)))
    return s.select("seq", F.floor(p["y"] * 1e6 + 0.5).alias("y")).where("y is not null")


def f18_buffers(spark, sf):
    lines = T.as_lines(planar(spark, sf), geographic=False).select(C("traj_id").alias("id"), "line")
    b = overlay.buffered(lines, 50.0)
    return b.select("id", F.size("ring").cast("bigint").alias("n"))


def f20_types(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in ("Point", "PointZ", "PolyLine", "PolyLineZ", "Polygon", "PolygonZ")], "shape string")
    return kinds.select("shape", geometries.base_type(C("shape")).alias("base"))


def f39_project_trips(spark, sf):
    t = T.origins_destinations(gnss(spark, sf)).select("traj_id", "start_x", "start_y", "end_x", "end_y")
    m = projections.Mercator()
    out = projections.map_points(t, m.forward, (("start_x", "start_y"), ("end_x", "end_y")))
    return out.select("traj_id", R("start_x", 2).alias("start_x"), R("end_x", 2).alias("end_x"))


def f41_georeference(spark, sf):
    g = GRID.moved(lambda x, y: (x * 2 + 1, y * 2 - 1))
    return spark.createDataFrame([(g.xmin, g.ymax, round(g.xstep, 9), round(g.ystep, 9))], "xmin double, ymax double, xstep double, ystep double")


def f42_crs_text(spark, sf):
    u = crs.Crs("U", "projected", method="Mercator", parameters={"central_meridian": 3.0})
    rows = [(c.kind, crs.parse_wkt(c.to_wkt()).kind, crs.parse_wkt(c.to_wkt()) == c if c.kind != "projected" else crs.parse_wkt(c.to_wkt()).projection() == u.projection()) for c in (crs.WGS84, u, crs.UNKNOWN)]
    return spark.createDataFrame(rows, "kind string, back string, same boolean")


def f55_equations(spark, sf):
    """Crossing of a1 x + b1 y = c1 and a2 x + b2 y = c2."""
    k = C("p_partkey")
    a1, b1, c1, a2, b2, c2 = (((k * m) % 11 - 5).cast("double") for m in (3, 5, 7, 2, 9, 4))
    det = F.nullif(a1 * b2 - a2 * b1, F.lit(0.0))
    return table(spark, sf, "part").select(k.alias("id"), R((c1 * b2 - c2 * b1) / det, 6).alias("x"), R((a1 * c2 - a2 * c1) / det, 6).alias("y"))


def n08_route(spark, sf):
    arcs = networks.resolve(nations(spark, sf), trade(spark, sf)).select((C("src") * 100 + C("dst")).alias("id"), "src", "dst", "x1", "y1", "x2", "y2")
    k = C("p_partkey")
    trips = table(spark, sf, "part").select(k.alias("id"), *(((k * m) % 24 + 0.3).alias(c) for m, c in ((7, "x1"), (5, "y1"), (11, "x2"), (13, "y2"))))
    return networks.route(nations(spark, sf), arcs, trips, 3.0).select("id", "exists", R("impedance", 5).alias("impedance"))


def n17_spatial_communities(spark, sf):
    return networks.spatial_communities(nations(spark, sf), trade(spark, sf), 12.0)


def m10_error(spark, sf):
    v, f = meshes.grid_mesh(spark, 20, 30, F.sin(C("x") / 3) * 2)
    small, _ = meshes.cluster_vertices(v, f, 2.0)
    e = meshes.simplification_error(v, small)
    return e.select(R("hausdorff", 6).alias("hausdorff"), R("mean", 6).alias("mean"))


def m14_transform(spark, sf):
    v, _ = meshes.grid_mesh(spark, 5, 6)
    centre = v.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return v.join(F.broadcast(centre)).select("id", *(((C(c) - C(f"m{c}")) * 2).alias(c) for c in "xy"))


def m16_extrude(spark, sf):
    r = regions(spark).withColumn("height", F.lit(10.0))
    return meshes.extrude(r).groupBy("region").agg(F.count("*").alias("panels"), F.max("z2").alias("top"))


_LINE_SQL = f"""WITH {PLANAR}, v AS (SELECT traj_id AS fid, seq % 2 AS p, seq, x, y FROM planar)"""

QUERIES = {
    "s04_csv_points": (s04_csv_points, f"WITH {GNSS} SELECT traj_id, round(x, 6) AS x, round(y, 6) AS y, {_SECOND} AS ts FROM gnss WHERE x BETWEEN 116.02 AND 116.05 AND y BETWEEN 39.0 AND 39.2"),
    "s05_ais": (s05_ais, f"WITH {GNSS} SELECT traj_id, round(x, 6) AS x, round(y, 6) AS y, kind FROM gnss"),
    "s06_flights": (s06_flights, f"WITH {GNSS} SELECT traj_id, round(6378137.0::DOUBLE * radians(x), 2) AS x, 'AAA' AS origin, 'BBB' AS destination FROM gnss"),
    "s08_shapefile": (s08_shapefile, f"{_LINE_SQL} SELECT 'PolyLine' AS shape, count(DISTINCT fid) AS n, count(DISTINCT (fid, p)) AS parts, count(*) AS points FROM v"),
    "s10_dbf": (s10_dbf, "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, round(p_retailprice, 2) AS p, p_brand AS b FROM part"),
    "s11_geojson": (s11_geojson, f"WITH {NATIONS} SELECT id, x, y FROM nodes"),
    "s12_kml": (s12_kml, f"WITH {NATIONS} SELECT id, 'n' || id AS name, x, y FROM nodes"),
    "s13_osm": (
        s13_osm,
        f"WITH {NATIONS}, {TRADE} SELECT src * 100 + dst AS osm_id, CASE WHEN (src + dst) % 2 = 0 THEN 'primary' ELSE 'service' END AS subtype, "
        "round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS length FROM arcs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst",
    ),
    "s14_geotiff": (s14_geotiff, f"WITH {GNSS}, c AS (SELECT CAST(floor((39.5::DOUBLE - y) / 0.0125::DOUBLE) AS BIGINT) AS row, CAST(floor((x - 116.0::DOUBLE) / 0.0025::DOUBLE) AS BIGINT) AS col FROM gnss) SELECT row, col, CAST(count(*) AS DOUBLE) AS value FROM c WHERE row BETWEEN 0 AND 39 AND col BETWEEN 0 AND 39 GROUP BY 1, 2"),
    "s16_obj": (s16_obj, "SELECT CAST(56 AS BIGINT) AS n_vertices, CAST(139 AS BIGINT) AS n_edges, CAST(84 AS BIGINT) AS n_faces, 42.0::DOUBLE AS area"),
    "s17_empty_layer": (s17_empty_layer, "SELECT CAST(1 AS BIGINT) AS fid, 'x' AS name WHERE FALSE"),
    "s18_crs": (s18_crs, f"WITH {GNSS} SELECT seq, round(x, 6) AS x, round(y, 6) AS y FROM gnss"),
    "s20_wkb": (s20_wkb, f"{_LINE_SQL}, r AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY fid, p ORDER BY seq)) SELECT fid, 'MULTILINESTRING' AS type, count(DISTINCT p) AS parts, round(coalesce(sum(sqrt(power(x2 - x, 2) + power(y2 - y, 2))), 0), 2) AS length FROM r GROUP BY 1"),
    "k06_trips": (k06_trips, f"WITH {SEGMENTS} SELECT traj_id, round(sum(length), 1) AS length FROM segments GROUP BY 1"),
    "k07_report": (k07_report, _report_sql()),
    "k08_nodes_arcs": (
        k08_nodes_arcs,
        f"WITH {NATIONS}, {TRADE} SELECT src AS SNodeID, dst AS ENodeID, 'LINESTRING (' || CAST(a.x AS INT) || ' ' || CAST(a.y AS INT) || ', ' || "
        "CAST(b.x AS INT) || ' ' || CAST(b.y AS INT) || ')' AS wkt, n FROM arcs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst",
    ),
    "k12_hash_split": (k12_hash_split, "SELECT CAST(list_sum([ascii(c) FOR c IN string_split(c_name, '')]) % 7 AS BIGINT) AS bucket, count(*) AS n FROM customer GROUP BY 1"),
    "k13_wkt": (k13_wkt, f"WITH {NATIONS} SELECT id, 'POINT (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS wkt FROM nodes"),
    "p01_columns": (p01_columns, "SELECT p_partkey AS fid, p_brand AS brand, 7 AS grade FROM part"),
    "p02_rows": (p02_rows, "SELECT p_partkey AS fid, p_brand AS brand, p_size AS size FROM part WHERE p_partkey NOT IN (1, 5, 9) UNION ALL SELECT p_partkey + 1000000, p_brand, 0 FROM part WHERE p_partkey <= 3"),
    "p03_cells": (p03_cells, "WITH s AS (SELECT p_partkey AS fid, CASE WHEN p_partkey = 2 THEN 99 ELSE p_size END AS size FROM part) SELECT fid, size, CAST(CASE WHEN size % 3 = 0 THEN 0 ELSE size END AS BIGINT) AS whole, CAST(CASE WHEN size % 3 = 0 THEN NULL ELSE size END AS DOUBLE) AS real FROM s"),
    "p04_schema": (p04_schema, "SELECT * FROM (VALUES ('fid', 'bigint'), ('brand', 'string'), ('size', 'int')) t(name, kind)"),
    "p05_feature": (p05_feature, "(SELECT p_partkey AS fid, p_brand AS brand, p_size AS size FROM part ORDER BY p_partkey LIMIT 1 OFFSET 4) UNION ALL (SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_partkey DESC LIMIT 1 OFFSET 1)"),
    "p08_rings": (p08_rings, "SELECT * FROM (VALUES ('square', CAST(1 AS BIGINT), CAST(1 AS BIGINT)), ('triangle', 1, 1), ('holed', 1, 2)) t(region, polygons, rings)"),
    "p10_edit_points": (p10_edit_points, "WITH e AS (SELECT user_id AS traj_id, event_id AS seq FROM events) SELECT traj_id, count(*) AS n FROM (SELECT traj_id FROM e WHERE seq % 7 <> 0 UNION ALL SELECT traj_id FROM e WHERE seq % 1000 = 0) GROUP BY 1"),
    "p20_families": (p20_families, f"WITH {NATIONS} SELECT CASE id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END AS family, CAST(sum(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM nodes GROUP BY 1"),
    "p21_colour_edges": (p21_colour_edges, f"WITH {GNSS}, c AS (SELECT CAST(floor((39.5::DOUBLE - y) / 0.0125::DOUBLE) AS BIGINT) AS row, CAST(floor((x - 116.0::DOUBLE) / 0.0025::DOUBLE) AS BIGINT) AS col FROM gnss), d AS (SELECT row, col, least(count(*), 3) AS v FROM c WHERE row BETWEEN 0 AND 39 AND col BETWEEN 0 AND 39 GROUP BY 1, 2) SELECT a.row, a.col FROM d a LEFT JOIN d r ON r.row = a.row AND r.col = a.col + 1 LEFT JOIN d b ON b.row = a.row + 1 AND b.col = a.col WHERE coalesce(a.v <> r.v, FALSE) OR coalesce(a.v <> b.v, FALSE)"),
    "p22_heights": (p22_heights, f"WITH {PLANAR}, s AS (SELECT traj_id AS line_id, seq, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS d FROM planar WINDOW w AS (PARTITION BY traj_id ORDER BY seq)), c AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY seq) AS u, sum(d) OVER (PARTITION BY line_id) AS t FROM s) SELECT line_id, seq, round(10 + u / t * 20, 5) AS z FROM c"),
    "p24_in_out": (p24_in_out, _in_out_sql()),
    "q12_ais_filter": (q12_ais_filter, None),
    "q14_contains": (q14_contains, f"WITH {GNSS}, {region_edges_sql()} SELECT seq, {_inside('x', 'y', 'holed')} AS inside FROM gnss"),
    "q15_cross": (q15_cross, None),
    "j02_polygon_index": (j02_polygon_index, _polygon_cells_sql()),
    "j06_ordered_index": (j06_ordered_index, "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey BETWEEN 100 AND 400"),
    "j12_snapshot_label": (
        j12_snapshot_label,
        f"WITH {SEGMENTS}, d AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS label FROM (SELECT {CELL} FROM gnss) WHERE {HELD} GROUP BY 1, 2), "
        f"p AS (SELECT traj_id, x + ({AT} - ts) / seconds * (x2 - x) AS x, y + ({AT} - ts) / seconds * (y2 - y) AS y FROM segments "
        f"WHERE ts <= {AT} AND ts2 > {AT} AND length > 0) SELECT traj_id, label FROM (SELECT traj_id, {CELL} FROM p) LEFT JOIN d USING (row, col)",
    ),
    "j15_weld": (j15_weld, "SELECT CAST(486 AS BIGINT) AS corners, CAST(100 AS BIGINT) AS vertices"),
    "a09_complex": (a09_complex, f"WITH {PLANAR}, led AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(ts) OVER w AS t2 FROM planar WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq)), c AS (SELECT CAST(floor((50000 - y) / 2500) AS BIGINT) AS row, CAST(floor(x / 500) AS BIGINT) AS col, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) / nullif(t2 - ts, 0) * 2 + seq % 10 AS v FROM led WHERE x2 IS NOT NULL) SELECT row, col, round(avg(v), 5) AS value FROM c WHERE row BETWEEN 0 AND 19 AND col BETWEEN 0 AND 19 GROUP BY 1, 2"),
    "a17_fields": (a17_fields, "SELECT DISTINCT event_type AS key FROM events"),
    "w07_stay_attributes": (w07_stay_attributes, None),
    "u03_clip": (u03_clip, None),
    "u04_same_sets": (u04_same_sets, "SELECT CAST(24 AS BIGINT) AS same, CAST(1 AS BIGINT) AS moved"),
    "f12_geometry_distance": (f12_geometry_distance, None),
    "f15_intersections": (f15_intersections, f"WITH {SEGMENTS}, p AS (SELECT seq, y + (116.05::DOUBLE - x) / nullif(x2 - x, 0) * (y2 - y) AS py, least(x, x2) AS lo, greatest(x, x2) AS hi FROM segments) SELECT seq, CAST(floor(round(py, 6) * 1000000 + 0.5) AS BIGINT) AS y FROM p WHERE 116.05::DOUBLE BETWEEN lo AND hi AND py BETWEEN 39.0 AND 39.5"),
    "f18_buffers": (f18_buffers, None),
    "f20_types": (f20_types, "SELECT * FROM (VALUES ('Point', 'POINT'), ('PointZ', 'POINT'), ('PolyLine', 'MULTILINESTRING'), ('PolyLineZ', 'MULTILINESTRING'), ('Polygon', 'MULTIPOLYGON'), ('PolygonZ', 'MULTIPOLYGON')) t(shape, base)"),
    "f39_project_trips": (f39_project_trips, f"WITH {GNSS} SELECT traj_id, round(6378137.0::DOUBLE * radians(first(x ORDER BY ts, seq)), 2) AS start_x, round(6378137.0::DOUBLE * radians(last(x ORDER BY ts, seq)), 2) AS end_x FROM gnss GROUP BY 1"),
    "f41_georeference": (f41_georeference, "SELECT 233.0::DOUBLE AS xmin, 78.0::DOUBLE AS ymax, 0.005::DOUBLE AS xstep, 0.025::DOUBLE AS ystep"),
    "f42_crs_text": (f42_crs_text, "SELECT * FROM (VALUES ('geographic', 'geographic', TRUE), ('projected', 'projected', TRUE), ('unknown', 'unknown', TRUE)) t(kind, back, same)"),
    "f55_equations": (f55_equations, "WITH e AS (SELECT p_partkey AS id, CAST(p_partkey * 3 % 11 - 5 AS DOUBLE) AS a1, CAST(p_partkey * 5 % 11 - 5 AS DOUBLE) AS b1, CAST(p_partkey * 7 % 11 - 5 AS DOUBLE) AS c1, CAST(p_partkey * 2 % 11 - 5 AS DOUBLE) AS a2, CAST(p_partkey * 9 % 11 - 5 AS DOUBLE) AS b2, CAST(p_partkey * 4 % 11 - 5 AS DOUBLE) AS c2 FROM part) SELECT id, round((c1 * b2 - c2 * b1) / nullif(a1 * b2 - a2 * b1, 0), 6) AS x, round((a1 * c2 - a2 * c1) / nullif(a1 * b2 - a2 * b1, 0), 6) AS y FROM e"),
    "n08_route": (n08_route, None),
    "n17_spatial_communities": (n17_spatial_communities, None),
    "m10_error": (m10_error, None),
    "m14_transform": (m14_transform, "SELECT i AS id, (i % 7 - 3.0::DOUBLE) * 2 AS x, (i // 7 - 2.5::DOUBLE) * 2 AS y FROM range(0, 42) t(i)"),
    "m16_extrude": (m16_extrude, "SELECT * FROM (VALUES ('square', CAST(16 AS BIGINT), 12.0::DOUBLE), ('triangle', 12, 12.0), ('holed', 32, 12.0)) t(region, panels, top)"),
}
