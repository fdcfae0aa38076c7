"""Vector files: ESRI shapefile with DBF, GeoJSON, KML, OSM roads and OBJ meshes.

Binary formats are parsed a file at a time in the task that read it; text formats go
through Spark's own readers.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralane.functions.geometries import GEOMETRY

# Shape codes of the format.
SHAPES = {0: "NULL", 1: "Point", 3: "PolyLine", 5: "Polygon", 11: "PointZ", 13: "PolyLineZ", 15: "PolygonZ"}
CODES = {"POINT": 1, "LINESTRING": 3, "MULTILINESTRING": 3, "POLYGON": 5, "MULTIPOLYGON": 5}


def parse_shp(data: bytes) -> list[tuple[int, str, list, list]]:
    """(fid, type, parts, z) of every record; a null shape has no parts."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 12 <= len(data):
        _, words = struct.unpack(">2i", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        code = struct.unpack("<i", body[:4])[0]
        kind, parts, z = SHAPES.get(code, "NULL"), [], []
        if code in (1, 11):
            x, y = struct.unpack("<2d", body[4:20])
            parts, z = [[(x, y)]], list(struct.unpack("<d", body[20:28])) if code == 11 else []
        elif code in (3, 5, 13, 15):
            n_parts, n = struct.unpack("<2i", body[36:44])
            begins = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n]
            start = 44 + 4 * n_parts
            flat = struct.unpack(f"<{2 * n}d", body[start : start + 16 * n])
            points = list(zip(flat[::2], flat[1::2], strict=True))
            parts = [points[i:j] for i, j in zip(begins, begins[1:], strict=False)]
            if code > 10:
                z = list(struct.unpack(f"<{n}d", body[start + 16 * n + 16 : start + 24 * n + 16]))
        out.append((len(out), kind, parts, z))
    return out


def parse_dbf(data: bytes, encoding: str = "gbk") -> tuple[list[tuple], list[dict]]:
    """(name, type, length, decimals) of the fields; the rows as dictionaries."""
    count, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode(encoding, "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for i in range(count):
        record, place, row = data[head + i * width : head + (i + 1) * width], 1, {}
        for name, kind, length, decimals in fields:
            text = record[place : place + length].decode(encoding, "replace").strip("\0 ")
            place += length
            if text == "":
                row[name] = None
            elif kind in "NF":
                row[name] = float(text) if decimals or "." in text or "e" in text.lower() else int(text)
            elif kind == "L":
                row[name] = text in "TtYy"
            else:
                row[name] = text
        rows.append(row)
    return fields, rows


LAYER = f"path string, fid bigint, shape string, geom {GEOMETRY}, z array<double>"
# Base family of each shape.
_BASE = {"Point": "POINT", "PointZ": "POINT", "PolyLine": "MULTILINESTRING", "PolyLineZ": "MULTILINESTRING", "Polygon": "MULTIPOLYGON", "PolygonZ": "MULTIPOLYGON"}


#: How a shapefile is opened: with attributes, for reading (the same here), or shapes only.
MODES = ("common", "read_only", "shp_only")


def read_shapefile(spark: SparkSession, path: str, encoding: str = "gbk", mode: str = "common") -> DataFrame:
    """path, fid, shape, geom, z, attributes (map of strings) of .shp files with their .dbf.

    ``path`` is a folder or glob; attributes are joined by file and place. Without a
    .dbf they are null, and so they are in the mode ``shp_only``, which reads no .dbf.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {MODES}")
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_replace("path", r"\.[^.]*$", "").alias("path"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind"), "content"
    )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(LAYER))

    def shapes(batches):
        import pyarrow as pa

        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [
                    {
                        "path": base, "fid": fid, "shape": kind, "z": z,
                        "geom": {"type": _BASE.get(kind, "NULL"), "parts": [[{"x": x, "y": y} for x, y in p] for p in parts]},
                    }
                    for fid, kind, parts, z in parse_shp(data)
                ]
                yield pa.RecordBatch.from_pylist(rows, fields)

    def tables(frames):
        import pandas as pd

        for frame in frames:
            for base, data in zip(frame["path"], frame["content"], strict=True):
                _, rows = parse_dbf(bytes(data), encoding)
                yield pd.DataFrame(
                    [(base, i, {k: None if v is None else str(v) for k, v in r.items()}) for i, r in enumerate(rows)],
                    columns=["path", "fid", "attributes"],
                )

    one = lambda k: files.where(F.col("kind") == k).select("path", "content")
    shp = one("shp").mapInArrow(shapes, LAYER)
    if mode == "shp_only":
        return shp.withColumn("attributes", F.lit(None).cast("map<string,string>"))
    dbf = one("dbf").mapInPandas(tables, "path string, fid bigint, attributes map<string,string>")
    return shp.join(dbf, ["path", "fid"], "left")


def shapefile_bytes(rows: list[tuple[str, list]], attributes: list[dict], encoding: str = "gbk") -> dict[str, bytes]:
    """shp, shx and dbf of one layer: (type, parts) and attributes of each feature."""
    code = CODES[rows[0][0]] if rows else 1
    records, offsets, at = [], [], 50
    xs = [p[0] for _, parts in rows for part in parts for p in part] or [0.0]
    ys = [p[1] for _, parts in rows for part in parts for p in part] or [0.0]
    for i, (_, parts) in enumerate(rows):
        points = [p for part in parts for p in part]
        if not points:
            body = struct.pack("<i", 0)
        elif code == 1:
            body = struct.pack("<i2d", 1, *points[0])
        else:
            box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
            begins, n = [], 0
            for part in parts:
                begins.append(n)
                n += len(part)
            body = struct.pack("<i4d2i", code, *box, len(parts), n) + struct.pack(f"<{len(parts)}i", *begins)
            body += struct.pack(f"<{2 * n}d", *(c for p in points for c in p))
        records.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        offsets.append(struct.pack(">2i", at, len(body) // 2))
        at += len(records[-1]) // 2

    def head(words):
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack(
            "<2i8d", 1000, code, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0
        )

    return {
        "shp": head(at) + b"".join(records),
        "shx": head(50 + 4 * len(rows)) + b"".join(offsets),
        "dbf": dbf_bytes(attributes, encoding),
    }


def dbf_bytes(rows: list[dict], encoding: str = "gbk") -> bytes:
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {}
    for n in names:
        seen = [r[n] for r in rows if r.get(n) is not None]
        if seen and all(isinstance(v, bool) for v in seen):
            kinds[n] = ("L", 1, 0)
        elif seen and all(isinstance(v, int) for v in seen):
            kinds[n] = ("N", 18, 0)
        elif seen and all(isinstance(v, (int, float)) for v in seen):
            kinds[n] = ("N", 24, 10)
        else:
            kinds[n] = ("C", max([1, *(len(str(v).encode(encoding, "replace")) for v in seen)]), 0)
    width = 1 + sum(k[1] for k in kinds.values())
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(names), width)
    for n in names:
        kind, length, decimals = kinds[n]
        head += n.encode(encoding)[:11].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([length, decimals]) + b"\0" * 14

    def cell(v, kind, length, decimals):
        if v is None:
            return b" " * length
        if kind == "L":
            return b"T" if v else b"F"
        if kind == "N":
            return (f"{v:.{decimals}f}" if decimals else str(v)).rjust(length).encode()[:length]
        return str(v).encode(encoding, "replace")[:length].ljust(length)

    body = b"".join(b" " + b"".join(cell(r.get(n), *kinds[n]) for n in names) for r in rows)
    return head + b"\r" + body + b"\x1a"


def write_shapefile(layer: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """part, extension, content of the files of a layer (fid, geom, attributes).

    A shapefile is one stream of records, so each value of ``key`` (or the whole layer)
    becomes one layer; save the result with any binary sink.
    """
    name = F.col(key).cast("string") if key else F.lit("layer")

    def run(table):
        import pyarrow as pa

        rows = table.sort_by("fid").to_pylist()
        shapes = [(r["geom"]["type"], [[(p["x"], p["y"]) for p in part] for part in r["geom"]["parts"]]) for r in rows]
        made = shapefile_bytes(shapes, [dict(r["attributes"] or []) for r in rows])
        return pa.table(
            {"part": [rows[0]["part"]] * len(made), "extension": [*made], "content": pa.array([*made.values()], pa.binary())}
        )

    files = layer.select(name.alias("part"), "fid", "geom", "attributes").groupBy("part").applyInArrow(
        run, "part string, extension string, content binary"
    )
    if path:
        files.write.mode("overwrite").parquet(path)
    return files


_NUMBERS = "array<array<array<array<double>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """geom, properties (map of strings) of FeatureCollections and bare geometries.

    A feature's id joins its properties. Unknown geometry types give a null geometry.
    """
    text = spark.read.text(path, wholetext=True)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    one = text.select(F.explode(F.coalesce(features, F.array("value"))).alias("f"))
    shape = F.coalesce(F.get_json_object("f", "$.geometry"), F.get_json_object("f", "$"))
    listed = F.from_json(F.get_json_object(shape, "$.geometries"), "array<string>")
    rows = one.select("f", F.explode(F.coalesce(listed, F.array(shape))).alias("g"))
    kind, at = F.upper(F.get_json_object("g", "$.type")), F.get_json_object("g", "$.coordinates")
    depth = {"POINT": "[[[{}]]]", "MULTIPOINT": "[[{}]]", "LINESTRING": "[[{}]]", "MULTILINESTRING": "[{}]", "POLYGON": "[{}]", "MULTIPOLYGON": "{}"}
    nested = None
    for name, frame in depth.items():
        text_of = F.concat(F.lit(frame.split("{}")[0]), at, F.lit(frame.split("{}")[1]))
        nested = F.when(kind == name, text_of) if nested is None else nested.when(kind == name, text_of)
    rings = F.flatten(F.from_json(nested, _NUMBERS))
    # Each point of a multi-point is a part of its own.
    parts = F.when(kind == "MULTIPOINT", F.transform(F.flatten(rings), lambda p: F.array(p))).otherwise(rings)
    points = F.transform(
        parts, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    )
    props = F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>")
    ident = F.get_json_object("f", "$.id")
    full = F.map_concat(F.coalesce(props, F.create_map().cast("map<string,string>")), F.when(ident.isNotNull(), F.create_map(F.lit("id"), ident)).otherwise(F.create_map().cast("map<string,string>")))
    return rows.select(F.when(points.isNotNull(), F.struct(kind.alias("type"), points.alias("parts"))).alias("geom"), full.alias("properties"))


def to_geojson(layer: DataFrame, geom: str = "geom", properties: str = "properties") -> DataFrame:
    """value: one GeoJSON feature a line."""
    g = F.col(geom)
    xy = F.transform(g["parts"], lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    kind = g["type"]
    first = F.get(xy, F.lit(0))
    body = (
        F.when(kind == "POINT", F.to_json(F.get(first, F.lit(0))))
        .when(kind == "LINESTRING", F.to_json(first))
        .when(kind == "MULTIPOINT", F.to_json(F.transform(xy, lambda r: F.get(r, F.lit(0)))))
        .when(kind == "MULTIPOLYGON", F.to_json(F.transform(xy, lambda r: F.array(r))))
        .otherwise(F.to_json(xy))
    )
    names = F.create_map(
        *(v for a, b in (("POINT", "Point"), ("LINESTRING", "LineString"), ("POLYGON", "Polygon"), ("MULTIPOINT", "MultiPoint"), ("MULTILINESTRING", "MultiLineString"), ("MULTIPOLYGON", "MultiPolygon")) for v in (F.lit(a), F.lit(b)))
    )
    return layer.select(
        F.concat(
            F.lit('{"type":"Feature","geometry":{"type":"'), names[kind], F.lit('","coordinates":'), body,
            F.lit('},"properties":'), F.coalesce(F.to_json(properties), F.lit("{}")), F.lit("}"),
        ).alias("value")
    )


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """id, name, geom of placemarks; a polygon is its outer ring, heights drop out."""
    text = spark.read.text(path, wholetext=True)
    marks = F.regexp_extract_all("value", F.lit(r"(?s)(<Placemark\b.*?</Placemark>)"), F.lit(1))
    m = text.select(F.explode(marks).alias("m"))
    kind = (
        F.when(F.contains("m", F.lit("<Polygon")), "POLYGON")
        .when(F.contains("m", F.lit("<LineString")), "LINESTRING")
        .when(F.contains("m", F.lit("<Point")), "POINT")
    )
    outer = F.when(kind == "POLYGON", F.regexp_extract("m", r"(?s)<outerBoundaryIs>(.*?)</outerBoundaryIs>", 1)).otherwise(F.col("m"))
    tuples = F.split(F.trim(F.regexp_extract(outer, r"(?s)<coordinates>\s*(.*?)\s*</coordinates>", 1)), r"\s+")
    number = lambda t, i: F.get(F.split(t, ","), F.lit(i)).try_cast("double")
    ring = F.transform(tuples, lambda t: F.struct(number(t, 0).alias("x"), number(t, 1).alias("y")))
    return m.where(kind.isNotNull()).select(
        F.regexp_extract("m", r'<Placemark[^>]*\bid="([^"]*)"', 1).alias("id"),
        F.regexp_extract("m", r"(?s)<name>\s*(.*?)\s*</name>", 1).alias("name"),
        F.struct(kind.alias("type"), F.array(ring).alias("parts")).alias("geom"),
    )


def read_osm_roads(spark: SparkSession, path: str) -> DataFrame:
    """osm_id, subtype, geom of ways with a highway tag; unknown node references are skipped."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lon double, _lat double").load(path)
    ways = (
        spark.read.format("xml")
        .option("rowTag", "way")
        .schema("_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>")
        .load(path)
    )
    road = F.get(F.filter("tag", lambda t: t["_k"] == "highway"), F.lit(0))["_v"]
    refs = ways.select(F.col("_id").alias("osm_id"), road.alias("subtype"), F.posexplode("nd").alias("at", "nd")).where("subtype is not null")
    placed = refs.join(nodes, refs["nd._ref"] == nodes["_id"])
    return placed.groupBy("osm_id", "subtype").agg(
        F.struct(
            F.lit("LINESTRING").alias("type"),
            F.array(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("at", "_lon", "_lat"))),
                    lambda p: F.struct(p["_lon"].alias("x"), p["_lat"].alias("y")),
                )
            ).alias("parts"),
        ).alias("geom")
    )


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x, y, z) and triangles (id, v0, v1, v2) of one OBJ text, ids from 0.

    Faces with more corners become fans.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "t"))
    words = F.split(F.trim("t"), r"\s+")
    head = F.get(words, F.lit(0))
    order = Window.orderBy("line")
    kept = lines.select("line", words.alias("w"), head.alias("h")).where("h in ('v', 'f')")
    number = lambda i: F.get("w", F.lit(i)).cast("double")
    vertices = kept.where("h = 'v'").select(
        (F.row_number().over(order) - 1).cast("bigint").alias("id"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z")
    )
    corner = lambda c: F.get(F.split(c, "/"), F.lit(0)).cast("bigint") - 1
    faces = kept.where("h = 'f'").select("line", F.transform(F.slice("w", 2, F.size("w")), corner).alias("c"))
    fans = faces.select("line", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k"))
    triangles = fans.select(
        (F.row_number().over(Window.orderBy("line", "k")) - 1).cast("bigint").alias("id"),
        F.get("c", F.lit(0)).alias("v0"), F.get("c", F.col("k")).alias("v1"), F.get("c", F.col("k") + 1).alias("v2"),
    )
    return vertices, triangles


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """kind, id, value: lines of an OBJ text; sort by (kind desc, id) and write."""
    v = vertices.select(F.lit("v").alias("kind"), "id", F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = faces.select(
        F.lit("f").alias("kind"), "id", F.concat_ws(" ", F.lit("f"), *(F.col(c) + 1 for c in ("v0", "v1", "v2"))).alias("value")
    )
    return v.unionByName(f)
