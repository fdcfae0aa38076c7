"""Convex clipping, line buffers and polygon fill, one geometry at a time in Arrow batches."""

from __future__ import annotations

import math

import numpy as np


def clip(subject: list, window: list) -> list:
    """Part of a ring inside a convex ring (both without the closing point); [] if none."""
    turn = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(window, window[1:] + window[:1], strict=True))
    ring = window[::-1] if turn > 0 else window
    out = list(subject)
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        kept, previous = [], out[-1] if out else None
        for p in out:
            s, t = side(previous), side(p)
            if (s >= 0) != (t >= 0):
                u = s / (s - t)
                kept.append((previous[0] + u * (p[0] - previous[0]), previous[1] + u * (p[1] - previous[1])))
            if t >= 0:
                kept.append(p)
            previous = p
        out = kept
    return out


def buffer_line(line: list, radius: float, side: str = "both", steps: int = 8) -> list:
    """Outline of a line widened by ``radius``: to the ``left``, ``right`` or ``both``.

    Corners are mitred on the outside up to twice the radius; ends are round for both
    sides. Overlaps of the outline with itself stay.
    """
    p = [np.array(q, float) for i, q in enumerate(line) if i == 0 or tuple(q) != tuple(line[i - 1])]
    if len(p) < 2:
        return [tuple(p[0] + radius * np.array([math.sin(t), math.cos(t)])) for t in np.linspace(0, 2 * math.pi, 4 * steps + 1)] if p else []
    ways = [(b - a) / np.linalg.norm(b - a) for a, b in zip(p, p[1:], strict=False)]
    normals = [np.array([-w[1], w[0]]) for w in ways]

    def offset(sign):
        out = [p[0] + sign * radius * normals[0]]
        for q, m, n in zip(p[1:-1], normals, normals[1:], strict=False):
            middle = m + n
            size = middle @ middle / 2
            reach = radius / max(size, 0.25) if size > 0 else radius
            out.append(q + sign * reach * middle)
        return [*out, p[-1] + sign * radius * normals[-1]]

    if side != "both":
        return [tuple(map(float, q)) for q in [*offset(1 if side == "left" else -1), *p[::-1]]]
    cap = lambda q, w, n: [q + radius * (math.cos(t) * n + math.sin(t) * w) for t in np.linspace(0, math.pi, steps + 1)[1:-1]]
    ring = [*offset(1), *cap(p[-1], ways[-1], normals[-1]), *offset(-1)[::-1], *cap(p[0], -ways[0], -normals[0])]
    return [tuple(map(float, q)) for q in ring]


def fill_cells(rings: list, size: float) -> list[tuple[int, int]]:
    """(cell_x, cell_y) whose centres lie inside the rings, holes left out (even-odd)."""
    points = [q for r in rings for q in r]
    if not points:
        return []
    ys = [q[1] for q in points]
    out = []
    for cy in range(math.floor(min(ys) / size), math.floor(max(ys) / size) + 1):
        y, hits = (cy + 0.5) * size, []
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
                if (y1 > y) != (y2 > y):
                    hits.append((x2 - x1) / (y2 - y1) * (y - y1) + x1)
        hits.sort()
        for a, b in zip(hits[::2], hits[1::2], strict=False):
            out += [(cx, cy) for cx in range(math.ceil(a / size - 0.5), math.ceil(b / size - 0.5))]
    return out


#: Bytes of Arrow data that become Python values at once: they take some thirty times as much.
PIECE_BYTES = 262_144


def _pieces(batch):
    """Slices of a batch of ``PIECE_BYTES`` each, or of one row if that is larger."""
    start = size = 0
    for i in range(batch.num_rows):
        own = batch.slice(i, 1).nbytes
        if i > start and size + own > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += own
    if start < batch.num_rows:
        yield batch.slice(start)


def _rows(df, columns: list[str], schema: str, make):
    """``make(values of a row)`` gives rows of the schema; nested values stay plain lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in _pieces(batch):
                rows = [r for values in zip(*(c.to_pylist() for c in piece.columns), strict=True) for r in make(*values)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], [f.name for f in fields]
                )

    return df.select(*columns).mapInArrow(run, schema)


_xy = lambda points: [(q["x"], q["y"]) for q in points]
_named = lambda points: [{"x": x, "y": y} for x, y in points]
_RING = "array<struct<x:double,y:double>>"


def polygon_index(polygons, size: float):
    """cell_x, cell_y, id of polygons (region, rings): the cells whose centres they hold."""
    make = lambda region, rings: [(x, y, region) for x, y in fill_cells([*map(_xy, rings)], size)]
    return _rows(polygons, ["region", "rings"], "cell_x bigint, cell_y bigint, id string", make)


def clipped(polygons, window: list):
    """region, ring: the outer rings of polygons, cut to one convex window."""
    make = lambda region, rings: [(region, _named(clip(_xy(rings[0]), window)))]
    return _rows(polygons, ["region", "rings"], f"region string, ring {_RING}", make)


def buffered(lines, radius: float, side: str = "both"):
    """id, ring of lines (id, line) widened by ``radius``."""
    kind = lines.schema["id"].dataType.simpleString()
    make = lambda i, line: [(i, _named(buffer_line(_xy(line), radius, side)))]
    return _rows(lines, ["id", "line"], f"id {kind}, ring {_RING}", make)


def _side(ax, ay, bx, by, px, py):
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _to_segment(ax, ay, bx, by, px, py):
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(square > 0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square, 0.0)
    t = np.clip(t, 0.0, 1.0)
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return np.sqrt((y - py) * (y - py) + (x - px) * (x - px))


def _between(v, a, b):
    return (v >= np.minimum(a, b)) & (v <= np.maximum(a, b))


def distance_to_edge(ax, ay, bx, by, cx, cy, dx, dy):
    """As ``geodesy.segment_distance`` of arrays of segments and one edge: 0 if they meet."""
    d1, d2 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    d3, d4 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    on = lambda d, x, y, px, py, qx, qy: (d == 0) & _between(x, px, qx) & _between(y, py, qy)
    meets = (
        ((d1 * d2 < 0) & (d3 * d4 < 0))
        | on(d1, ax, ay, cx, cy, dx, dy)
        | on(d2, bx, by, cx, cy, dx, dy)
        | on(d3, cx, cy, ax, ay, bx, by)
        | on(d4, dx, dy, ax, ay, bx, by)
    )
    edge, own = (cx, cy, dx, dy), (ax, ay, bx, by)
    ends = np.minimum(_to_segment(*edge, ax, ay), _to_segment(*edge, bx, by))
    return np.where(meets, 0.0, np.minimum(ends, np.minimum(_to_segment(*own, cx, cy), _to_segment(*own, dx, dy))))


def segment_distances(segments, edges):
    """fid, region, distance: for each batch of segments (fid, x1, y1, x2, y2) the least of every fid.

    ``edges`` (region, x1, y1, x2, y2) are a stated, small set that goes to all tasks; the least of
    all batches is the least distance of a line.
    """
    sides: dict = {}
    for r in edges.select("region", "x1", "y1", "x2", "y2").collect():
        sides.setdefault(r.region, []).append(tuple(r)[1:])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            keys = batch.column(0).dictionary_encode("encode")
            code = keys.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.nonzero(np.r_[True, np.diff(code[order]) > 0])[0]
            names = pc.take(keys.dictionary, pa.array(code[order][starts]))
            for region, own in sides.items():
                d = distance_to_edge(*ends, *own[0])
                for edge in own[1:]:
                    d = np.minimum(d, distance_to_edge(*ends, *edge))
                least = pa.array(np.fmin.reduceat(d[order], starts), from_pandas=True)
                yield pa.RecordBatch.from_arrays([names, pa.array([region] * len(starts), pa.string()), least], ["fid", "region", "distance"])

    kind = segments.schema["fid"].dataType.simpleString()
    return segments.select("fid", "x1", "y1", "x2", "y2").mapInArrow(run, f"fid {kind}, region string, distance double")
