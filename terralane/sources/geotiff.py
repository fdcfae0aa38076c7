"""GeoTIFF: uncompressed little-endian images, tiled or in strips, as cell tables."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags and field types of the format.
_TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "strips": 273, "bands": 277,
    "rows_per_strip": 278, "strip_bytes": 279, "planar": 284, "tile_width": 322, "tile_height": 323,
    "tiles": 324, "tile_bytes": 325, "format": 339, "scale": 33550, "tie": 33922, "keys": 34735,
}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
TILE = 128


def parse(data: bytes) -> dict:
    """bands (array of bands, rows, cols), scale (x, y), tie (x, y of the north-west corner)."""
    if data[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    at = struct.unpack("<I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack("<H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack("<HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        code = _TYPES.get(kind)
        if code is None or code == "s":
            continue
        size = struct.calcsize(code) * n
        start = at + 10 + 12 * i if size <= 4 else struct.unpack("<I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        tags[tag] = struct.unpack(f"<{n}{code}", data[start : start + size])
    get = lambda name, default=None: tags.get(_TAGS[name], default)
    if get("compression", (1,))[0] != 1:
        raise ValueError("compressed images are not supported")
    width, height, bands = get("width")[0], get("height")[0], get("bands", (1,))[0]
    kind = np.dtype(f"<{_KINDS[get('format', (1,))[0]]}{get('bits')[0] // 8}")
    apart = get("planar", (1,))[0] == 2 and bands > 1
    tiled = get("tiles") is not None
    tw, th = (get("tile_width")[0], get("tile_height")[0]) if tiled else (width, get("rows_per_strip", (height,))[0])
    across, down = -(-width // tw), -(-height // th)
    out = np.zeros((bands, down * th, across * tw))
    for k, start in enumerate(get("tiles") if tiled else get("strips")):
        band, k = divmod(k, across * down) if apart else (None, k)
        row, col = divmod(k, across)
        rows = th if tiled else min(th, height - row * th)
        depth = 1 if apart else bands
        cells = np.frombuffer(data, kind, rows * tw * depth, start).reshape(rows, tw, depth)
        target = out[:, row * th : row * th + rows, col * tw : (col + 1) * tw]
        if apart:
            target[band] = cells[:, :, 0]
        else:
            target[:] = np.moveaxis(cells, 2, 0)
    tie, scale = get("tie", (0, 0, 0, 0, 0, 0)), get("scale", (1, 1, 0))
    return {
        "bands": out[:, :height, :width],
        "scale": (float(scale[0]), float(scale[1])),
        "tie": (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]),
    }


def encode(bands: np.ndarray, xmin: float, ymax: float, xstep: float, ystep: float, tile: int = TILE) -> bytes:
    """A tiled GeoTIFF of doubles (bands, rows, cols); as many tiles as the size needs."""
    n, rows, cols = bands.shape
    across, down = -(-cols // tile), -(-rows // tile)
    padded = np.zeros((n, down * tile, across * tile))
    padded[:, :rows, :cols] = bands
    tiles = [
        np.ascontiguousarray(np.moveaxis(padded[:, r * tile : (r + 1) * tile, c * tile : (c + 1) * tile], 0, 2)).astype("<f8").tobytes()
        for r in range(down)
        for c in range(across)
    ]
    offsets, at = [], 8
    for t in tiles:
        offsets.append(at)
        at += len(t)
    fields = [
        ("width", "I", [cols]), ("height", "I", [rows]), ("bits", "H", [64] * n), ("compression", "H", [1]),
        ("bands", "H", [n]), ("planar", "H", [1]), ("tile_width", "I", [tile]), ("tile_height", "I", [tile]),
        ("tiles", "I", offsets), ("tile_bytes", "I", [len(t) for t in tiles]), ("format", "H", [3] * n),
        ("scale", "d", [xstep, ystep, 0.0]), ("tie", "d", [0.0, 0.0, 0.0, xmin, ymax, 0.0]),
    ]
    codes = {v: k for k, v in _TYPES.items()}
    extra_at = at + 2 + 12 * len(fields) + 4
    entries, extra = b"", b""
    for name, code, values in fields:
        body = struct.pack(f"<{len(values)}{code}", *values)
        if len(body) <= 4:
            place = body.ljust(4, b"\0")
        else:
            place = struct.pack("<I", extra_at + len(extra))
            extra += body
        entries += struct.pack("<HHI", _TAGS[name], codes[code], len(values)) + place
    return b"II*\0" + struct.pack("<I", at) + b"".join(tiles) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra


CELLS = "path string, band int, row bigint, col bigint, x double, y double, value double"


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """path, band, row, col, x, y (cell centre), value of every cell; a file is one task's."""
    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                image = parse(bytes(data))
                (xstep, ystep), (x0, y0) = image["scale"], image["tie"]
                for b, band in enumerate(image["bands"]):
                    for low in range(0, len(band), 256):
                        part = band[low : low + 256]
                        rows, cols = np.indices(part.shape)
                        rows = rows + low
                        yield pd.DataFrame(
                            {
                                "path": name, "band": np.int32(b), "row": rows.ravel(), "col": cols.ravel(),
                                "x": x0 + (cols.ravel() + 0.5) * xstep, "y": y0 - (rows.ravel() + 0.5) * ystep,
                                "value": part.ravel(),
                            }
                        )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def to_geotiff(cells: DataFrame, grid) -> DataFrame:
    """content: one GeoTIFF of a cell table (row, col, value, band if any).

    A file is one object, so its cells meet in one task; the grid bounds them.
    """
    rows, cols = grid.rows, grid.cols
    placed = cells if "band" in cells.columns else cells.withColumn("band", F.lit(0))

    def run(frame):
        import pandas as pd

        bands = np.zeros((int(frame["band"].max()) + 1, rows, cols))
        bands[frame["band"], frame["row"], frame["col"]] = frame["value"]
        return pd.DataFrame({"content": [encode(bands, grid.xmin, grid.ymax, grid.xstep, grid.ystep)]})

    return placed.select("band", "row", "col", "value").groupBy().applyInPandas(run, "content binary")
