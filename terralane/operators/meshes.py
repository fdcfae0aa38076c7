"""Triangle meshes: vertices (id, x, y, z) and faces (id, v0, v1, v2).

Measures and one-level subdivisions are joins; greedy simplification runs as one task
over one mesh (or one mesh of a group).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .networks import within

_CORNERS = ("v0", "v1", "v2")
#: Faces of a mesh that one task simplifies.
ONE_MESH_FACES = 500_000


def _sub(a, b) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def _cross(a, b) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a) -> Column:
    return F.sqrt(_dot(a, a))


def _at(i: int) -> list[Column]:
    return [F.col(f"{c}{i}") for c in "xyz"]


def placed(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with x0..z2, the places of their corners."""
    out = faces
    for i, corner in enumerate(_CORNERS):
        side = vertices.select(F.col("id").alias(corner), *(F.col(c).alias(f"{c}{i}") for c in "xyz"))
        out = out.join(side, corner)
    return out


def measured(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with area, unit normal (nx, ny, nz) and corner angles (a0, a1, a2)."""
    p = placed(vertices, faces)
    n = _cross(_sub(_at(1), _at(0)), _sub(_at(2), _at(0)))
    length = F.nullif(_norm(n), F.lit(0.0))

    def angle(i):
        u, v = _sub(_at((i + 1) % 3), _at(i)), _sub(_at((i + 2) % 3), _at(i))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v) / F.nullif(_norm(u) * _norm(v), F.lit(0.0)))))

    return p.withColumns(
        {
            "area": _norm(n) / 2,
            **{f"n{c}": n[i] / length for i, c in enumerate("xyz")},
            **{f"a{i}": angle(i) for i in range(3)},
        }
    )


def half_edges(faces: DataFrame) -> DataFrame:
    """face, src, dst, opposite: three a face; ``opposite`` is the face on the other side."""
    three = faces.select(
        F.col("id").alias("face"),
        F.explode(
            F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True)))
        ).alias("e"),
    ).select("face", "e.src", "e.dst")
    other = three.select(F.col("face").alias("opposite"), F.col("src").alias("dst"), F.col("dst").alias("src"))
    return three.join(other, ["src", "dst"], "left").select("face", "src", "dst", "opposite")


def edges(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """a, b, n_faces, length of each edge once; an edge of one face is a border."""
    h = half_edges(faces).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.count("*").alias("n_faces")
    )
    p = vertices.select("id", "x", "y", "z")
    a = p.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}0") for c in "xyz"))
    b = p.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    joined = h.join(a, "a").join(b, "b")
    return joined.select("a", "b", "n_faces", _norm(_sub(_at(0), _at(1))).alias("length"))


def summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: counts, Euler number, border edges, area, signed volume, mean edge."""
    e = edges(vertices, faces).agg(
        F.count("*").alias("n_edges"),
        F.sum((F.col("n_faces") == 1).cast("int")).alias("border_edges"),
        F.avg("length").alias("mean_edge"),
    )
    m = measured(vertices, faces).agg(
        F.count("*").alias("n_faces"),
        F.sum("area").alias("area"),
        (F.sum(_dot(_at(0), _cross(_at(1), _at(2)))) / 6).alias("volume"),
    )
    v = vertices.agg(F.count("*").alias("n_vertices"))
    return v.join(e).join(m).withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def one_ring(faces: DataFrame) -> DataFrame:
    """id, neighbour of all vertices that share an edge."""
    h = half_edges(faces)
    return h.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).union(
        h.select(F.col("dst"), F.col("src"))
    ).distinct()


def vertex_normals(vertices: DataFrame, faces: DataFrame, weight: str = "area") -> DataFrame:
    """id, nx, ny, nz: mean of face normals, ``uniform``, by ``area`` or by corner ``angle``."""
    m = measured(vertices, faces)
    w = {"uniform": lambda i: F.lit(1.0), "area": lambda i: F.col("area"), "angle": lambda i: F.col(f"a{i}")}[weight]
    parts = m.select(
        F.explode(
            F.array(*(F.struct(F.col(c).alias("id"), w(i).alias("w")) for i, c in enumerate(_CORNERS)))
        ).alias("p"),
        "nx", "ny", "nz",
    )
    sums = parts.groupBy(F.col("p.id").alias("id")).agg(*(F.sum(F.col("p.w") * F.col(f"n{c}")).alias(f"s{c}") for c in "xyz"))
    length = F.nullif(_norm([F.col("sx"), F.col("sy"), F.col("sz")]), F.lit(0.0))
    return sums.select("id", *((F.col(f"s{c}") / length).alias(f"n{c}") for c in "xyz"))


def curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """id, area (a third of its faces), gaussian: the angle missing to a full turn, over area."""
    m = measured(vertices, faces)
    parts = m.select(
        F.explode(F.array(*(F.struct(F.col(c).alias("id"), F.col(f"a{i}").alias("a")) for i, c in enumerate(_CORNERS)))).alias("p"), "area"
    )
    sums = parts.groupBy(F.col("p.id").alias("id")).agg((F.sum("area") / 3).alias("area"), F.sum("p.a").alias("turn"))
    return sums.select("id", "area", ((2 * F.pi() - F.col("turn")) / F.nullif("area", F.lit(0.0))).alias("gaussian"))


def face_components(faces: DataFrame) -> DataFrame:
    """id, component: faces that share edges, by the network's components."""
    from .networks import components

    arcs = half_edges(faces).where("opposite is not null and opposite <> face").select(F.col("face").alias("src"), F.col("opposite").alias("dst"))
    return components(faces.select("id"), arcs)


def border(faces: DataFrame) -> DataFrame:
    """src, dst of the half-edges without a face on the other side."""
    return half_edges(faces).where("opposite is null").select("src", "dst")


def _edge_key(a: Column, b: Column) -> Column:
    """Id of the vertex made on an edge: a hash, negative so that it meets no old id."""
    return -F.abs(F.xxhash64(F.least(a, b), F.greatest(a, b))) - 1


def subdivide_loop(vertices: DataFrame, faces: DataFrame, smooth: bool = True) -> tuple[DataFrame, DataFrame]:
    """Each face into four; with ``smooth`` by Loop's weights, else at midpoints."""
    p = vertices.select("id", "x", "y", "z")
    wings = faces.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"), F.col(c).alias("wing"))
                    for a, b, c in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1"))
                )
            )
        ).alias("e")
    ).select("e.*")
    w = wings.join(p.withColumnRenamed("id", "wing"), "wing").groupBy("a", "b").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(f"w{c}") for c in "xyz")
    )
    a = p.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}0") for c in "xyz"))
    b = p.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    middle = w.join(a, "a").join(b, "b")
    inner = (F.col("n") == 2) & F.lit(smooth)
    made = middle.select(
        _edge_key(F.col("a"), F.col("b")).alias("id"),
        *(
            F.when(inner, (F.col(f"{c}0") + F.col(f"{c}1")) * 0.375 + F.col(f"w{c}") * 0.125)
            .otherwise((F.col(f"{c}0") + F.col(f"{c}1")) / 2)
            .alias(c)
            for c in "xyz"
        ),
    )
    old = p
    if smooth:
        ring = one_ring(faces).join(p.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id").agg(
            F.count("*").alias("k"), *(F.sum(c).alias(f"r{c}") for c in "xyz")
        )
        open_ends = border(faces).select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("open", F.lit(True))
        joined = p.join(ring, "id", "left").join(open_ends, "id", "left")
        beta = (0.625 - F.pow(0.375 + 0.25 * F.cos(2 * F.pi() / F.col("k")), F.lit(2.0))) / F.col("k")
        moved = F.col("open").isNull() & F.col("k").isNotNull()
        old = joined.select(
            "id", *(F.when(moved, F.col(c) * (1 - F.col("k") * beta) + F.col(f"r{c}") * beta).otherwise(F.col(c)).alias(c) for c in "xyz")
        )
    m01, m12, m20 = (_edge_key(F.col(s), F.col(t)) for s, t in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))
    v0, v1, v2 = (F.col(c) for c in _CORNERS)
    four = [(v0, m01, m20), (m01, v1, m12), (m20, m12, v2), (m01, m12, m20)]
    new = faces.select(
        F.col("id").alias("old"),
        F.posexplode(F.array(*(F.struct(x.alias("v0"), y.alias("v1"), z.alias("v2")) for x, y, z in four))).alias("k", "t"),
    ).select((F.col("old") * 4 + F.col("k")).alias("id"), "t.*")
    return old.unionByName(made), new


def subdivide_sqrt3(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vertex in each face and edges flipped across the old ones; borders stay."""
    p = placed(vertices, faces)
    key = lambda f: -F.abs(F.xxhash64(F.lit("face"), f)) - 1
    centres = p.select(key(F.col("id")).alias("id"), *((sum(F.col(f"{c}{i}") for i in range(3)) / 3).alias(c) for c in "xyz"))
    h = half_edges(faces)
    inner = h.where("opposite is not null").select(
        F.col("src").alias("v0"), key(F.col("opposite")).alias("v1"), key(F.col("face")).alias("v2"), "face", "src", "dst"
    )
    outer = h.where("opposite is null").select("src", "dst", key(F.col("face")).alias("v2"), "face")
    new = inner.select(F.xxhash64("face", "src", "dst").alias("id"), "v0", "v1", "v2").unionByName(
        outer.select(F.xxhash64("face", "src", "dst").alias("id"), F.col("src").alias("v0"), F.col("dst").alias("v1"), "v2")
    )
    ring = one_ring(faces).join(vertices.select(F.col("id").alias("neighbour"), "x", "y", "z"), "neighbour").groupBy("id").agg(
        F.count("*").alias("k"), *(F.avg(c).alias(f"r{c}") for c in "xyz")
    )
    alpha = (4 - 2 * F.cos(2 * F.pi() / F.col("k"))) / 9
    relaxed = vertices.select("id", "x", "y", "z").join(ring, "id", "left").select(
        "id", *(F.when(F.col("k").isNull(), F.col(c)).otherwise(F.col(c) * (1 - alpha) + F.col(f"r{c}") * alpha).alias(c) for c in "xyz")
    )
    return relaxed.unionByName(centres), new


def cluster_vertices(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of one grid cell become their mean; faces that collapse drop out."""
    cell = F.xxhash64(*(F.floor(F.col(c) / size) for c in "xyz"))
    named = vertices.select("id", "x", "y", "z", cell.alias("cell"))
    new = named.groupBy("cell").agg(*(F.avg(c).alias(c) for c in "xyz")).withColumnRenamed("cell", "id")
    out = faces
    for corner in _CORNERS:
        side = named.select(F.col("id").alias(corner), F.col("cell").alias(f"{corner}_"))
        out = out.join(side, corner).drop(corner).withColumnRenamed(f"{corner}_", corner)
    alive = out.where("v0 <> v1 and v1 <> v2 and v0 <> v2").select("id", *_CORNERS)
    return new, alive.dropDuplicates(list(_CORNERS))


def simplify(vertices: DataFrame, faces: DataFrame, keep_faces: int, cost: str = "quadric") -> tuple[DataFrame, DataFrame]:
    """Collapse the cheapest edges (``quadric`` or ``length``) until few enough faces stay.

    An edge is left alone if its ends share more neighbours than its two wings, or if
    both are on the border and it is not. One mesh is one task; over ``ONE_MESH_FACES`` it
    raises.
    """
    within(faces, ONE_MESH_FACES, "faces")
    table = vertices.select(F.lit(0).alias("k"), "id", "x", "y", "z", F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    rows = table.unionByName(
        faces.select(F.lit(1).alias("k"), "id", F.col("v0").cast("double").alias("x"), F.col("v1").cast("double").alias("y"), F.col("v2").cast("double").alias("z"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    )

    def run(frame):
        import pandas as pd

        v = {int(r.id): (r.x, r.y, r.z) for r in frame[frame["k"] == 0].itertuples()}
        f = {int(r.id): (int(r.x), int(r.y), int(r.z)) for r in frame[frame["k"] == 1].itertuples()}
        v, f = collapse(v, f, keep_faces, cost)
        used = {c for t in f.values() for c in t}
        rows = [(0, i, *p) for i, p in sorted(v.items()) if i in used] + [(1, i, *map(float, t)) for i, t in sorted(f.items())]
        return pd.DataFrame(rows, columns=["k", "id", "x", "y", "z"])

    out = rows.groupBy().applyInPandas(run, "k int, id bigint, x double, y double, z double")
    return out.where("k = 0").drop("k"), out.where("k = 1").select(
        "id", *(F.col(c).cast("bigint").alias(n) for c, n in zip("xyz", _CORNERS, strict=True))
    )


def collapse(v: dict, f: dict, keep_faces: int, cost: str = "quadric") -> tuple[dict, dict]:
    import numpy as np

    v = {i: np.array(p, float) for i, p in v.items()}
    f = dict(f)
    around: dict = {i: set() for i in v}
    for k, t in f.items():
        for c in t:
            around[c].add(k)

    def plane(t):
        a, b, c = (v[i] for i in t)
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        q = np.append(n / size, -n @ a / size) if size else np.zeros(4)
        return np.outer(q, q)

    quadric = {i: sum((plane(f[k]) for k in around[i]), np.zeros((4, 4))) for i in v}
    near = lambda i: {c for k in around[i] for c in f[k]} - {i}
    on_border = lambda i: any(len(around[i] & around[j]) == 1 for j in near(i))

    def offer(i, j):
        middle = (v[i] + v[j]) / 2
        if cost == "length":
            return float(np.linalg.norm(v[i] - v[j])), middle
        q = quadric[i] + quadric[j]
        best = middle
        if abs(np.linalg.det(q[:3, :3])) > 1e-9:
            best = np.linalg.solve(q[:3, :3], -q[:3, 3])
        h = np.append(best, 1)
        return float(h @ q @ h), best

    version = dict.fromkeys(v, 0)
    queue = []

    def push(i, j):
        i, j = min(i, j), max(i, j)
        heapq.heappush(queue, (offer(i, j)[0], i, j, version[i], version[j]))

    for i in v:
        for j in near(i):
            if i < j:
                push(i, j)
    while len(f) > keep_faces and queue:
        _, i, j, vi, vj = heapq.heappop(queue)
        if i not in v or j not in v or version[i] != vi or version[j] != vj:
            continue
        shared = around[i] & around[j]
        if not shared or len(near(i) & near(j)) > len(shared):
            continue
        if len(shared) > 1 and on_border(i) and on_border(j):
            continue
        place = offer(i, j)[1]
        for k in shared:
            for c in f[k]:
                around[c].discard(k)
            del f[k]
        for k in around.pop(j):
            f[k] = tuple(i if c == j else c for c in f[k])
            around[i].add(k)
        quadric[i] = quadric[i] + quadric[j]
        v[i] = place
        del v[j]
        version[i] += 1
        for n in near(i):
            push(i, n)
    return {i: tuple(map(float, p)) for i, p in v.items()}, f


def simplification_error(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: hausdorff and mean distance from the old vertices to the nearest new one."""
    new = after.select(*(F.col(c).alias(f"{c}1") for c in "xyz"))
    near = (
        before.select("id", *(F.col(c).alias(f"{c}0") for c in "xyz"))
        .join(F.broadcast(new))
        .groupBy("id")
        .agg(F.min(_norm(_sub(_at(0), _at(1)))).alias("d"))
    )
    return near.agg(F.max("d").alias("hausdorff"), F.avg("d").alias("mean"))


def morse(vertices: DataFrame, faces: DataFrame, value: str = "z") -> DataFrame:
    """id, kind of each inner vertex by how often its ring changes between above and below.

    0: minimum or maximum, 2: regular, 4 and more: saddle; ties go by id.
    """
    side = vertices.select("id", F.struct(F.col(value).alias("v"), "id").alias("rank"))
    h = half_edges(faces)
    third = faces.select(F.col("id").alias("face"), *_CORNERS)
    ring = h.join(third, "face").select(
        F.col("src").alias("id"), F.col("dst").alias("a"),
        (F.col("v0") + F.col("v1") + F.col("v2") - F.col("src") - F.col("dst")).alias("b"),
    )
    r = ring.join(side.withColumnRenamed("rank", "own"), "id")
    for c in "ab":
        r = r.join(side.select(F.col("id").alias(c), F.col("rank").alias(f"{c}_rank")), c)
    above = lambda c: F.col(f"{c}_rank") > F.col("own")
    n = r.groupBy("id").agg(
        F.sum((above("a") != above("b")).cast("int")).alias("changes"), F.max(above("a")).alias("up")
    )
    kind = (
        F.when((F.col("changes") == 0) & F.col("up"), "minimum")
        .when(F.col("changes") == 0, "maximum")
        .when(F.col("changes") == 2, "regular")
        .otherwise("saddle")
    )
    closed = border(faces).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return n.join(closed, "id", "left_anti").select("id", kind.alias("kind"))


def fill_holes(faces: DataFrame) -> DataFrame:
    """Faces that close every border loop by a fan from its least vertex.

    Loops are told apart by components of the border; each is ordered by one task.
    """
    from .networks import components

    b = border(faces)
    nodes = b.select(F.col("src").alias("id")).distinct()
    loops = b.join(components(nodes, b).select(F.col("id").alias("src"), "component"), "src")

    def run(frame):
        import pandas as pd

        after = dict(zip(frame["dst"], frame["src"], strict=True))  # against the faces' turn
        start = min(after)
        loop = [start]
        while after.get(loop[-1], start) != start and len(loop) <= len(after):
            loop.append(after[loop[-1]])
        return pd.DataFrame([(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)], columns=list(_CORNERS))

    return loops.groupBy("component").applyInPandas(run, "v0 bigint, v1 bigint, v2 bigint")


def grid_mesh(spark, rows: int, cols: int, height=None) -> tuple[DataFrame, DataFrame]:
    """A rectangle of rows x cols cells with unit steps; ``height`` is an expression of x, y."""
    ids = spark.range((rows + 1) * (cols + 1))
    x, y = (F.col("id") % (cols + 1)).cast("double"), F.floor(F.col("id") / (cols + 1)).cast("double")
    v = ids.select("id", x.alias("x"), y.alias("y")).withColumn("z", F.lit(0.0) if height is None else height)
    c = spark.range(rows * cols)
    corner = F.floor(F.col("id") / cols) * (cols + 1) + F.col("id") % cols
    two = F.array(
        F.struct(corner.alias("v0"), (corner + 1).alias("v1"), (corner + cols + 2).alias("v2")),
        F.struct(corner.alias("v0"), (corner + cols + 2).alias("v1"), (corner + cols + 1).alias("v2")),
    )
    f = c.select(F.col("id").alias("cell"), F.posexplode(two).alias("k", "t")).select(
        (F.col("cell") * 2 + F.col("k")).alias("id"), "t.v0", "t.v1", "t.v2"
    )
    return v, f


def sphere(spark, stacks: int = 16, slices: int = 32, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A closed sphere: two poles and stacks - 1 rings."""
    ring = spark.range((stacks - 1) * slices)
    up = (F.floor(F.col("id") / slices) + 1) * (F.pi() / stacks)
    turn = (F.col("id") % slices) * (2 * F.pi() / slices)
    v = ring.select(
        "id", (F.sin(up) * F.cos(turn) * radius).alias("x"), (F.sin(up) * F.sin(turn) * radius).alias("y"), (F.cos(up) * radius).alias("z")
    )
    top, bottom = (stacks - 1) * slices, (stacks - 1) * slices + 1
    poles = spark.createDataFrame([(top, 0.0, 0.0, radius), (bottom, 0.0, 0.0, -radius)], "id bigint, x double, y double, z double")
    cell = spark.range(stacks * slices)
    s, k = F.floor(F.col("id") / slices), F.col("id") % slices
    nxt = (k + 1) % slices
    low, high = s * slices, (s - 1) * slices
    tri = lambda a, b, c: F.struct(a.cast("bigint").alias("v0"), b.cast("bigint").alias("v1"), c.cast("bigint").alias("v2"))
    parts = (
        F.when(s == 0, F.array(tri(F.lit(top), low + k, low + nxt)))
        .when(s == stacks - 1, F.array(tri(F.lit(bottom), high + nxt, high + k)))
        .otherwise(F.array(tri(high + k, low + k, low + nxt), tri(high + k, low + nxt, high + nxt)))
    )
    f = cell.select(F.col("id").alias("cell"), F.posexplode(parts).alias("i", "t")).select((F.col("cell") * 2 + F.col("i")).alias("id"), "t.*")
    return v.unionByName(poles), f


def cone(spark, slices: int = 32, radius: float = 1.0, height: float = 1.0) -> tuple[DataFrame, DataFrame]:
    turn = F.col("id") * (2 * F.pi() / slices)
    ring = spark.range(slices).select("id", (F.cos(turn) * radius).alias("x"), (F.sin(turn) * radius).alias("y"), F.lit(0.0).alias("z"))
    ends = spark.createDataFrame([(slices, 0.0, 0.0, 0.0), (slices + 1, 0.0, 0.0, height)], "id bigint, x double, y double, z double")
    nxt = (F.col("id") + 1) % slices
    tri = lambda a, b, c: F.struct(a.cast("bigint").alias("v0"), b.cast("bigint").alias("v1"), c.cast("bigint").alias("v2"))
    two = F.array(tri(F.lit(slices), nxt, F.col("id")), tri(F.lit(slices + 1), F.col("id"), nxt))
    f = spark.range(slices).select(F.col("id").alias("s"), F.posexplode(two).alias("i", "t")).select((F.col("s") * 2 + F.col("i")).alias("id"), "t.*")
    return ring.unionByName(ends), f


def extrude(polygons: DataFrame, level_height: float = 3.0) -> DataFrame:
    """region, level, x1, y1, x2, y2, z1, z2: wall panels of outlines (region, rings, height)."""
    from .spatial_joins import ring_edges

    walls = ring_edges(polygons).join(polygons.select("region", "height"), "region")
    levels = F.floor(F.col("height") / level_height).cast("int") + 1
    return walls.withColumn("level", F.explode(F.sequence(F.lit(0), levels - 1))).select(
        "region", "level", "x1", "y1", "x2", "y2", (F.col("level") * level_height).alias("z1"), ((F.col("level") + 1) * level_height).alias("z2")
    )
