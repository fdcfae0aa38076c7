"""Files written are read back, and texts are parsed as laid down."""

import numpy as np
from pyspark.sql import functions as F

from terralane.operators.rasters import Grid
from terralane.sources import geotiff, layers, points


def test_point_texts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ID,X,Y,T\na,1.5,2,2024-01-01 00:00:10\na,bad,2,2024-01-01 00:00:20\nb,9,9,2024-01-01 00:00:00\n")
    rows = points.read_points(spark, str(tmp_path / "p.csv"), header=True, box=(0, 0, 5, 5)).collect()
    assert [tuple(r) for r in rows] == [("a", 1.5, 2.0, 1704067210.0)]
    (tmp_path / "ais.txt").write_text("7~x~3~100~600000~1200000\n")
    r = points.read_ais(spark, str(tmp_path / "ais.txt")).first()
    assert (r.traj_id, r.x, r.y, r.ts, r.extra) == ("7", 1.0, 2.0, 100.0, {"aistype": "3"})
    line = ",".join(["10", "20", "f1", *[""] * 6, "PEK", "", "SHA", *[""] * 4, "2024-01-01 00:00:00"])
    (tmp_path / "f.csv").write_text(line + "\n")
    f = points.read_flights(spark, str(tmp_path / "f.csv")).first()
    assert abs(f.x - 1113194.9079) < 1e-3 and f.extra["Destination"] == "SHA"


def test_track_set_round_trip(spark, tmp_path):
    rows = [("a", 0, 1.0, 5.0, 6.0, 1.0, 2.0, {"k": "v"}), ("a", 1, 2.0, 7.0, 8.0, 3.0, 4.0, {}), ("b", 0, 1.0, 0.0, 0.0, -1.0, -1.0, {"z": "w"})]
    df = spark.createDataFrame(rows, "traj_id string, seq int, ts double, x double, y double, speed double, direction double, extra map<string,string>")
    points.write_track_set(df, str(tmp_path / "t"))
    back = points.read_track_set(spark, str(tmp_path / "t" / "*.txt")).orderBy("traj_id", "seq").collect()
    assert [(r.traj_id, r.seq, r.ts, r.x, r.y, r.speed, r.direction) for r in back] == [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows]
    assert back[0].extra == {"k": "v", "z": ""} and back[0].crs == "Unknown"


def test_shapefile_round_trip(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    made = layers.shapefile_bytes([("POLYGON", [square, hole]), ("POLYGON", [])], [{"n": 5, "s": "路", "d": 1.5}, {"n": None, "s": "b", "d": -2.0}])
    for kind, data in made.items():
        (tmp_path / f"l.{kind}").write_bytes(data)
    rows = layers.read_shapefile(spark, str(tmp_path)).orderBy("fid").collect()
    assert [[(p.x, p.y) for p in part] for part in rows[0].geom.parts] == [square, hole]
    assert rows[0].attributes == {"n": "5", "s": "路", "d": "1.5"} and rows[1].geom.parts == []
    layer = spark.createDataFrame(
        [(0, ("LINESTRING", [[(1.0, 2.0), (3.0, 4.0)]]), {"a": "b"})],
        f"fid long, geom {layers.GEOMETRY}, attributes map<string,string>",
    )
    files = {r.extension: bytes(r.content) for r in layers.write_shapefile(layer, str(tmp_path / "out")).collect()}
    assert layers.parse_shp(files["shp"])[0][2] == [[(1.0, 2.0), (3.0, 4.0)]]
    assert layers.parse_dbf(files["dbf"])[1] == [{"a": "b"}]


def test_geojson(spark, tmp_path):
    text = (
        '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"properties":{"a":1},"geometry":{"type":"Polygon",'
        '"coordinates":[[[0,0],[0,1],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}}]}'
    )
    (tmp_path / "g.json").write_text(text)
    rows = layers.read_geojson(spark, str(tmp_path / "g.json")).collect()
    assert rows[0].geom.type == "POLYGON" and len(rows[0].geom.parts[0]) == 4 and rows[0].properties == {"a": "1", "id": "7"}
    assert [(p[0].x, p[0].y) for p in rows[1].geom.parts] == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "back.json").write_text('{"features":[' + ",".join(r.value for r in layers.to_geojson(layers.read_geojson(spark, str(tmp_path / "g.json"))).collect()) + "]}")
    again = layers.read_geojson(spark, str(tmp_path / "back.json")).collect()
    assert [r.geom for r in again] == [r.geom for r in rows]


def test_kml_and_osm(spark, tmp_path):
    (tmp_path / "k.kml").write_text(
        '<kml><Placemark id="a"><name>n</name><Polygon><outerBoundaryIs><LinearRing><coordinates> 0,0,5 1,0,5 1,1,5 </coordinates></LinearRing>'
        "</outerBoundaryIs></Polygon></Placemark><Placemark><Point><coordinates>3,4</coordinates></Point></Placemark></kml>"
    )
    rows = layers.read_kml(spark, str(tmp_path / "k.kml")).collect()
    assert (rows[0].id, rows[0].name, rows[0].geom.type, len(rows[0].geom.parts[0])) == ("a", "n", "POLYGON", 3)
    assert rows[1].geom.parts[0][0].y == 4.0
    (tmp_path / "o.xml").write_text(
        '<osm><node id="1" lon="1" lat="2"/><node id="2" lon="3" lat="4"/><way id="9"><nd ref="2"/><nd ref="77"/><nd ref="1"/>'
        '<tag k="highway" v="primary"/></way><way id="10"><nd ref="1"/><nd ref="2"/><tag k="building" v="yes"/></way></osm>'
    )
    (way,) = layers.read_osm_roads(spark, str(tmp_path / "o.xml")).collect()
    assert way.osm_id == 9 and way.subtype == "primary" and [(p.x, p.y) for p in way.geom.parts[0]] == [(3.0, 4.0), (1.0, 2.0)]


def test_obj(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvn 0 0 1\nf 1/1 2/1 3/1 4/1\n")
    v, f = layers.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4 and [(r.v0, r.v1, r.v2) for r in f.orderBy("id").collect()] == [(0, 1, 2), (0, 2, 3)]
    lines = [r.value for r in layers.obj_lines(v, f).orderBy(F.desc("kind"), "id").collect()]
    assert lines[0] == "v 0.0 0.0 0.0" and lines[-1] == "f 1 3 4"


def test_geotiff_round_trip(spark, tmp_path):
    bands = np.arange(2 * 130 * 200, dtype=float).reshape(2, 130, 200)
    data = geotiff.encode(bands, 10.0, 50.0, 0.5, 0.25)
    image = geotiff.parse(data)
    assert (image["bands"] == bands).all() and image["tie"] == (10.0, 50.0) and image["scale"] == (0.5, 0.25)
    (tmp_path / "r.tif").write_bytes(data)
    cells = geotiff.read_geotiff(spark, str(tmp_path / "r.tif"))
    r = cells.where("band = 1 and row = 129 and col = 199").first()
    assert (r.value, r.x, r.y) == (51999.0, 109.75, 17.625)
    again = geotiff.to_geotiff(cells, Grid(10.0, 50.0, 0.5, 0.25, 130, 200)).first().content
    assert (geotiff.parse(bytes(again))["bands"] == bands).all()


def test_hash_split_and_sample(spark, tmp_path):
    df = spark.range(500).withColumn("name", F.concat(F.lit("n"), "id"))
    points.hash_split(df, str(tmp_path / "h"), "name", 7)
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 500 and back.select("bucket").distinct().count() == 7
    assert points.reservoir(df, 10, "id").collect() == points.reservoir(df, 10, "id").collect()
