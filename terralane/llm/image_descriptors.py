"""Copies of images by local descriptors: cropped, rotated, scaled or re-toned.

Each image gives all its corners on scales down to the size of a patch, each with an
orientation and 256 binary brightness tests in a patch turned upright. Some chosen bits of
a descriptor are a key in each of several Hamming tables. A candidate is a copy if enough
of its best descriptor matches agree on one similarity transform; copies are joined to
classes.

1. Stars: in the first tables each feature names only the first one of its bucket that is
   near enough to match. What these candidates confirm joins large groups of copies.
2. All tables: in a bucket each feature is held against all others, and those pairs stay
   whose descriptors are near enough and whose images are of different classes so far. So
   no pair that could join two classes is left out, and none is made within a class.

Matches by chance between unrelated images grow with the square of the corpus, and most
meet once only, so they are not rows where that can be helped: images are dealt out as
block pairs (``block_links``), and the task that holds all features of two blocks goes
through all tables, counts the votes and confirms. Only the links that join classes leave
it. Every block is read as often as there are blocks, so beyond ``MOST_BLOCKS`` of them
(about 16 million features) they are dealt out by key, one table at a time
(``keyed_groups``): less is moved then, but every match is a row. A large bucket is dealt
out as block pairs there, so no task holds more than two blocks of it.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_shuffles, shared_dir
from .components import UnionFind, connected_components

#: Each scale is so much smaller than the one before, down to the size of a patch.
STEP = 0.75
RADIUS = 15
TESTS = 256
#: Tables and bits of their keys up to 16 million features; see ``table_plan``.
TABLES = 10
KEY_BITS = 20
#: Features that a bucket holds on average, at most, if descriptors were random.
BUCKET_ROWS = 16
#: Bits of a match that may differ, as a share; more bits a key need so many more tables.
FLIPPED = 0.1
#: Tables in which stars are sought first.
STAR_TABLES = 2
#: Rows of one block of a bucket; larger buckets are dealt out as block pairs.
BLOCK_ROWS = 1024
#: Features of one block of images, of which a task holds two, and the most blocks that are held against each other.
BLOCK_FEATURES, MOST_BLOCKS = 3 << 17, 40
#: Smaller corpora make up to so many blocks of fewer features, so there are enough tasks.
SPREAD_BLOCKS, SPREAD_FEATURES = 8, 1 << 16
#: Partners of each block that are dealt out together: a bound of the disk in use.
TURNS_AT_ONCE = 2
#: Row pairs of buckets that are compared in one step, and votes that are gathered before they are counted.
_PORTION, _VOTES = 1 << 18, 1 << 22
#: Candidates that are confirmed together, for each image: a bound of the disk in use.
PAIRS_AT_ONCE = 1
MAX_DISTANCE = 48
MIN_INLIERS = 12
#: Where the smaller image has few corners, a quarter of them is enough, but never fewer than these.
LEAST_INLIERS = 6
#: Pixels of images, corners or pairs of features that are worked on together.
_PIXELS, _CORNERS, _CELLS = 1 << 20, 2048, 1 << 18
BITS = tuple(f"bits_{i}" for i in range(4))
FEATURE = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "<u8", 4)])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM, PPM or 8-bit PNG; None for anything else or broken data."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            return _decode_pnm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _decode_png(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _grey(samples: np.ndarray) -> np.ndarray:
    samples = samples.astype(np.float32)
    if samples.shape[2] >= 3:
        return samples[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32)
    return samples[:, :, 0]


def _decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    depth = 3 if data[:2] == b"P6" else 1
    if top > 255:
        raise ValueError("only one byte a sample")
    body = np.frombuffer(data, np.uint8, width * height * depth, at + 1)
    return _grey(body.reshape(height, width, depth))


def _decode_png(data: bytes) -> np.ndarray:
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, bits, colour, _, _, interlaced = head
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if bits != 8 or depth is None or interlaced:
        raise ValueError("only plain 8-bit grey or true colour")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * depth + 1)
    out = np.zeros((height + 1, width * depth + depth), np.int64)
    for y in range(height):
        kind, line, up, now = raw[y, 0], raw[y, 1:].astype(np.int64), out[y], out[y + 1]
        if kind == 0:
            now[depth:] = line
        elif kind == 1:
            now[depth:] = (np.cumsum(line.reshape(-1, depth), 0) & 255).reshape(-1)
        elif kind == 2:
            now[depth:] = (line + up[depth:]) & 255
        elif kind in (3, 4):
            for x in range(depth, len(now)):
                a, b, c = now[x - depth], up[x], up[x - depth]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[x] = (line[x - depth] + guess) & 255
        else:
            raise ValueError("unknown filter")
    return _grey(out[1:, depth:].reshape(height, width, depth))


def encode_pgm(grey: np.ndarray) -> bytes:
    height, width = grey.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _blur(stack: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)-squares, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        sums = np.cumsum(np.pad(stack, pad, "edge"), axis=axis, dtype=np.float64)
        n = stack.shape[axis]
        stack = (
            np.take(sums, np.arange(2 * r + 1, 2 * r + 1 + n), axis)
            - np.take(sums, np.arange(n), axis)
        ).astype(np.float32) / (2 * r + 1)
    return stack


def _resized(stack: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return stack
    h, w = (max(1, round(n * scale)) for n in stack.shape[1:])
    y = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, stack.shape[1] - 1)
    x = np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, stack.shape[2] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, stack.shape[1] - 1), np.minimum(x0 + 1, stack.shape[2] - 1)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)
    rows = stack[:, y0] * (1 - fy) + stack[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


@lru_cache(maxsize=1)
def _patterns():
    """Test positions and disc positions for the orientation."""
    draw = np.random.Generator(np.random.PCG64(7))
    tests = draw.normal(0, RADIUS / 2, (2, TESTS, 2))
    # An upright patch grows brighter to the right, so tests along that way all agree;
    # those across it tell patches apart.
    tests[1, :, 0] = tests[0, :, 0] + draw.normal(0, 1, TESTS)
    tests = np.clip(tests, -RADIUS * 0.7, RADIUS * 0.7)
    span = np.arange(-RADIUS, RADIUS + 1)
    disc = np.stack(np.meshgrid(span, span), -1).reshape(-1, 2)
    disc = disc[(disc**2).sum(1) <= RADIUS**2]
    return tests.astype(np.float32), disc


def table_plan(n_features: int) -> tuple[int, int]:
    """(bits of a key, tables) for so many features.

    Buckets keep their size as the corpus grows, so keys get longer; a match then meets
    less often in one table, which more tables make up for.
    """
    bits = min(60, max(KEY_BITS, math.ceil(math.log2(max(1, n_features) / BUCKET_ROWS))))
    return bits, math.ceil(TABLES / (1 - FLIPPED) ** (bits - KEY_BITS))


@lru_cache(maxsize=256)
def _chosen_bits(table: int, bits: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([7, table])).choice(TESTS, bits, replace=False)


def _at_scale(stack: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(image number, feature) of all corners of same-sized images, resized to one scale."""
    _, height, width = stack.shape
    smooth = _blur(stack, 1)
    gy, gx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = (_blur(p, 2) for p in (gx * gx, gy * gy, gx * gy))
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = np.zeros((height, width), bool)
    inner[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1] = True
    best = np.pad(response, ((0, 0), (2, 2), (2, 2)), constant_values=-np.inf)
    around = reduce(
        np.maximum, (best[:, i : i + height, j : j + width] for i in range(5) for j in range(5))
    )
    image, y, x = np.nonzero(inner & (response >= around) & (response > 1.0))
    order = np.lexsort((x, y, -response[image, y, x], image))
    image, y, x = image[order], y[order], x[order]
    wide = _blur(stack, 2)
    found = [
        _features(stack, wide, scale, *(v[low : low + _CORNERS] for v in (image, y, x)))
        for low in range(0, len(image), _CORNERS)
    ]
    return image, np.concatenate(found) if found else np.zeros(0, FEATURE)


def _features(stack, wide, scale: float, image, y, x) -> np.ndarray:
    """Orientation and tests of given corners."""
    _, height, width = stack.shape
    tests, disc = _patterns()
    values = stack[image[:, None], y[:, None] + disc[:, 1], x[:, None] + disc[:, 0]]
    values = values - values.mean(1, keepdims=True)
    angle = np.arctan2(values @ disc[:, 1].astype(np.float32), values @ disc[:, 0].astype(np.float32))
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    seen = []
    for dx, dy in ((t[:, 0], t[:, 1]) for t in tests):
        px = np.rint(x[:, None] + cos * dx - sin * dy).astype(np.int64)
        py = np.rint(y[:, None] + sin * dx + cos * dy).astype(np.int64)
        seen.append(wide[image[:, None], np.clip(py, 0, height - 1), np.clip(px, 0, width - 1)])
    found = np.zeros(len(image), FEATURE)
    found["x"], found["y"] = (x + 0.5) / scale, (y + 0.5) / scale
    found["scale"], found["angle"] = 1 / scale, angle
    found["bits"] = np.packbits(seen[0] < seen[1], axis=1, bitorder="little").view("<u8")
    return found


def describe(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """Features of each image; images of one size are worked on together."""
    out: list[list[np.ndarray]] = [[] for _ in images]
    by_size: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        if image is not None and image.size:
            by_size.setdefault(image.shape, []).append(i)
    for members in by_size.values():
        together = max(1, min(64, _PIXELS // images[members[0]].size))
        for low in range(0, len(members), together):
            part = members[low : low + together]
            stack, scale = np.stack([images[i] for i in part]), 1.0
            while min(stack.shape[1:]) >= 2 * RADIUS + 3:
                owner, found = _at_scale(stack, scale)
                for k, i in enumerate(part):
                    out[i].append(found[owner == k])
                stack, scale = _resized(stack, STEP), scale * STEP
    return [np.concatenate(f) if f else np.zeros(0, FEATURE) for f in out]


def table_keys(features: np.ndarray, table: int = 0, bits: int = KEY_BITS) -> np.ndarray:
    """The key of every feature in a table: its chosen bits."""
    words = [features["bits"][:, i].astype(np.uint64) for i in range(TESTS // 64)]
    key = np.zeros(len(features), np.uint64)
    for place, bit in enumerate(_chosen_bits(table, bits).tolist()):
        key |= (words[bit // 64] >> np.uint64(bit % 64) & np.uint64(1)) << np.uint64(place)
    return key.view(np.int64)


def _near_partners(bits, classes, start, partners, stars: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j near enough to match and of different classes, by portions.

    Row i has ``partners`` of them, from row ``start`` on; as ``stars`` the first that fits.
    """
    ends = np.concatenate([[0], np.cumsum(partners, dtype=np.int64)])
    at = 0
    while at < len(partners):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _PORTION, "right")) - 1)
        n = partners[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) + np.repeat(start[at:to] - (ends[at:to] - ends[at]), n)
        apart = classes[i] != classes[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= MAX_DISTANCE
        i, j = i[near], j[near]
        if stars:
            i, first = np.unique(i, return_index=True)
            j = j[first]
        yield i, j
        at = to


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """Most matches that one similarity transform explains.

    Matches are mutual nearest descriptors within the distance. Each match proposes the
    transform of its own scale, turn and place; matches that land near where it says
    support it, each place once.
    """
    if not len(a) or not len(b):
        return 0
    near, least = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    back, back_least = np.zeros(len(b), np.int64), np.full(len(b), TESTS + 1)
    rows = max(1, _CELLS // len(b))
    for low in range(0, len(a), rows):
        part = a["bits"][low : low + rows, None]
        distance = np.bitwise_count(part ^ b["bits"][None]).sum(2, dtype=np.int64)
        near[low : low + rows], least[low : low + rows] = distance.argmin(1), distance.min(1)
        nearer = distance.min(0) < back_least
        back[nearer] = low + distance.argmin(0)[nearer]
        back_least[nearer] = distance.min(0)[nearer]
    i = np.flatnonzero((back[near] == np.arange(len(a))) & (least <= MAX_DISTANCE))
    if len(i) < 2:
        return len(i)
    p, q = a[i], b[near[i]]
    ratio = (q["scale"] / p["scale"])[:, None]
    turn = (q["angle"] - p["angle"])[:, None]
    cos, sin = ratio * np.cos(turn), ratio * np.sin(turn)
    row, rows = np.zeros(len(i), bool), max(1, _CELLS // len(i))
    for low in range(0, len(i), rows):
        of = slice(low, low + rows)
        dx, dy = p["x"][None] - p["x"][of, None], p["y"][None] - p["y"][of, None]
        ex = q["x"][of, None] + cos[of] * dx - sin[of] * dy - q["x"][None]
        ey = q["y"][of, None] + sin[of] * dx + cos[of] * dy - q["y"][None]
        agree = np.hypot(ex, ey) <= 3 + 0.1 * np.hypot(dx, dy)
        best = agree[agree.sum(1).argmax()]
        if best.sum() > row.sum():
            row = best
    places = np.rint(np.stack([p["x"][row], p["y"][row]]) / 4)
    return len(np.unique(places, axis=1).T)


def needed_inliers(a: np.ndarray, b: np.ndarray, min_inliers: int = MIN_INLIERS) -> int:
    """Inliers that make a link, by the corners of the smaller image.

    A crop with few corners needs fewer. Of thousands of corners some agree by chance, 17 of
    2,770 between unrelated images, so a fiftieth is needed there.
    """
    smaller = min(len(a), len(b))
    return max(min(min_inliers, max(LEAST_INLIERS, -(-smaller // 4))), -(-smaller // 50))


def features(images: DataFrame) -> DataFrame:
    """image_id, digest, n_features, features (packed)."""
    id_type = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                data = batch.column(1).to_pylist()
                found = describe([decode(d) for d in data])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([hashlib.sha256(d or b"").hexdigest() for d in data]),
                        pa.array([len(f) for f in found], pa.int32()),
                        pa.array([f.tobytes() for f in found], pa.binary()),
                    ],
                    ["image_id", "digest", "n_features", "features"],
                )

    return images.select("image_id", "media").mapInArrow(
        run, f"image_id {id_type}, digest string, n_features int, features binary"
    )


def table_rows(heads: DataFrame, table: int = 0, bits: int = KEY_BITS) -> DataFrame:
    """image_id, class, key, corner, bits_0 to bits_3: a row for each feature.

    ``heads`` has image_id, features and class (of the image so far).
    """
    id_type = heads.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                found = [np.frombuffer(f, FEATURE) for f in batch.column(2).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                every = np.concatenate(found)
                number = np.concatenate([np.arange(len(f), dtype=np.int32) for f in found])
                tests = every["bits"].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(owner),
                        batch.column(1).take(owner),
                        pa.array(table_keys(every, table, bits)),
                        pa.array(number),
                        *(pa.array(tests[:, i]) for i in range(4)),
                    ],
                    ["image_id", "class", "key", "corner", *BITS],
                )

    return heads.select("image_id", "class", "features").mapInArrow(
        run,
        f"image_id {id_type}, class {id_type}, key bigint, corner int, " + ", ".join(f"{c} bigint" for c in BITS),
    )


def bucket_pairs(rows: DataFrame, block: int = BLOCK_ROWS, stars: bool = False) -> DataFrame:
    """a, b, corner (of a) for features in one bucket that are near enough to match.

    All pairs of images of different classes or, as ``stars``, for each feature the first
    of these. A bucket of more than ``block`` rows is cut into blocks by a hash and dealt
    out as block pairs, each feature of one block against each of the other.
    """
    id_type = rows.schema["image_id"].dataType.simpleString()
    # Written first: its size is known then, and the rows needn't be dealt out for this join.
    large = materialize(
        rows.groupBy("key")
        .agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_blocks"))
        .where("n_blocks > 1"),
        "image-large-buckets",
    )
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    dealt = (
        rows.join(large, "key", "left")
        .withColumn("own", F.pmod(F.xxhash64("image_id", "corner"), n_blocks.cast("bigint")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .select(
            "key",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "image_id",
            "class",
            "corner",
            *BITS,
        )
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "own", "image_id", "corner")
    )

    def compare(table) -> Iterator:
        """Pairs of whole groups: rows of one key and block pair, in order of their block."""
        import pyarrow as pa
        import pyarrow.compute as pc

        key, low, high, own = (table.column(i).to_numpy() for i in range(4))
        ids, corner = table.column(4), table.column(6).to_numpy()
        classes = pc.dictionary_encode(table.column(5).combine_chunks()).indices.to_numpy()
        bits = np.stack([table.column(7 + i).to_numpy() for i in range(4)], 1)
        place = np.arange(len(key))
        opens = np.ones(len(key), bool)
        opens[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        start = np.maximum.accumulate(np.where(opens, place, 0))
        group = np.cumsum(opens) - 1
        of_low = np.bincount(group, weights=own == low).astype(np.int64)[group]
        # Partners are the rows before in the same block, or all rows of the other block.
        partners = np.where(low == high, place - start, np.where(own == low, 0, of_low))
        for i, j in _near_partners(bits, classes, start, partners, stars):
            a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
            less = pc.less(a, b)
            chosen = np.where(less.to_numpy(), corner[i], corner[j])
            out = [pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(chosen)]
            yield from pa.table(out, names=["a", "b", "corner"]).to_batches()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group of a batch may go on in the next.
            key, low, high = (batch.column(i).to_numpy() for i in range(3))
            last = (key == key[-1]) & (low == low[-1]) & (high == high[-1])
            cut = int(last.argmax())
            if kept:
                before = [kept[-1].column(i)[-1].as_py() for i in range(3)]
                same = before == [int(key[-1]), int(low[-1]), int(high[-1])]
                if cut == 0 and same:
                    kept.append(batch)
                    continue
            done = [*kept, *([batch.slice(0, cut)] if cut else [])]
            if done:
                yield from compare(pa.Table.from_batches(done).combine_chunks())
            kept = [batch.slice(cut)]
        if kept:
            yield from compare(pa.Table.from_batches(kept).combine_chunks())

    return dealt.mapInArrow(run, f"a {id_type}, b {id_type}, corner int")


def confirm(pairs: DataFrame, min_inliers: int = MIN_INLIERS) -> DataFrame:
    """a, b, inliers of the pairs (a, b, features_a, features_b) that agree enough."""
    id_type = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, enough = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, FEATURE), np.frombuffer(y, FEATURE)
                n.append(consensus(x, y))
                enough.append(n[-1] >= needed_inliers(x, y, min_inliers))
            kept = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["a", "b", "inliers"]
            )
            yield kept.filter(pa.array(enough, pa.bool_()))

    return pairs.select("a", "b", "features_a", "features_b").mapInArrow(
        run, f"a {id_type}, b {id_type}, inliers int"
    )


def _stored(described: DataFrame) -> DataFrame:
    """``described`` as files in buckets of image_id, so joins on it never deal out features again."""
    spark = described.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"image_features_{uuid.uuid4().hex}"
    described.repartition(buckets, "image_id").write.bucketBy(buckets, "image_id").sortBy("image_id").option(
        "path", f"{shared_dir(spark)}/{name}"
    ).option("compression", "zstd").saveAsTable(name)
    release_shuffles(spark)
    return spark.table(name)


def _heads(stored: DataFrame, own: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """image_id, class (so far), features of the first image of each class of equal bytes."""
    if groups is None:
        labelled = own.withColumn("class", F.col("image_id"))
    else:
        labelled = own.join(groups.hint("merge"), "image_id", "left").withColumn(
            "class", F.coalesce("component", "image_id")
        )
    kept = labelled.select("image_id", "class", F.col("digest").alias("kept"))
    # Digests are of one length. As an equality this would become a second key of the join,
    # and the buckets, which are by image_id alone, would no longer do.
    same = F.startswith(F.col("digest"), F.col("kept"))
    return stored.join(kept.hint("merge"), "image_id").where(same).select("image_id", "class", "features")


def _voted(met: list[DataFrame], min_votes: int, groups: DataFrame | None, tested: DataFrame | None) -> DataFrame:
    """a, b that met with ``min_votes`` different corners of a, of different classes, not confirmed before."""
    every = reduce(DataFrame.unionByName, met).distinct()
    pairs = every.groupBy("a", "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes).select("a", "b")
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    if groups is not None:
        for side in "ab":
            of = groups.select(F.col("image_id").alias(side), F.col("component").alias(f"class_{side}"))
            pairs = pairs.join(of.hint("merge"), side, "left")
        same = F.coalesce("class_a", "a") == F.coalesce("class_b", "b")
        pairs = pairs.where(~same).select("a", "b")
    return materialize(pairs, "image-pairs")


def _confirmed(heads: DataFrame, pairs: DataFrame, n_heads: int, min_inliers: int) -> DataFrame:
    """a, b, inliers of all ``pairs`` that agree, in portions: each pair brings two feature lists."""
    spark = heads.sparkSession
    side = lambda name: heads.select(
        F.col("image_id").alias(name), F.col("features").alias(f"features_{name}")
    )
    portions = max(1, -(-pairs.count() // max(1, PAIRS_AT_ONCE * n_heads)))
    links = []
    for k in range(portions):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(portions)) == k)
        with_features = part.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        links.append(materialize(confirm(with_features, min_inliers), "image-links"))
        release_shuffles(spark)
    return reduce(DataFrame.unionByName, links)


def _links_within(
    every: np.ndarray, sizes: list[int], high: np.ndarray, bits: int, tables: int, min_votes: int, min_inliers: int
) -> list:
    """(a, b, inliers) that join classes of images, which are told by their place.

    Images come by ascending id: ``sizes`` are the numbers of their features in ``every``.
    ``high`` tells the images of the second block, held against those of the first only;
    if there are none, all are held against each other. Classes begin as single images.
    """
    n = len(sizes)
    found = np.split(every, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(n), sizes)
    second, apart = high[owner], bool(high.any())
    place = np.arange(len(every), dtype=np.int32)
    sets, tested, links = UnionFind(), np.zeros(0, np.int64), []

    def matches(table: int, stars: bool) -> Iterator[np.ndarray]:
        """A vote each: the feature of a, times ``n``, plus b."""
        key = table_keys(every, table, bits)
        order = np.argsort(key << 1 | second)
        key, after = key[order], second[order]
        opens = np.ones(len(key), bool)
        opens[1:] = key[1:] != key[:-1]
        del key
        start = np.maximum.accumulate(np.where(opens, place, 0))
        partners = place - start
        if apart:
            # Of a bucket, rows of the first block come first.
            opens[1:] |= after[1:] != after[:-1]
            partners = np.where(after, np.maximum.accumulate(np.where(opens, place, 0)) - start, 0)
        classes = np.array([sets.find(k) for k in range(n)], np.int32)[owner[order]]
        for i, j in _near_partners(every["bits"][order], classes, start, partners, stars):
            i, j = order[i], order[j]
            yield np.minimum(i, j) * n + owner[np.maximum(i, j)]

    def settle(votes: np.ndarray) -> np.ndarray:
        """Confirm what has its votes; the others are still wanted."""
        nonlocal tested
        votes = np.unique(votes)
        feature, b = np.divmod(votes, n)
        pairs, of, count = np.unique(owner[feature] * n + b, return_inverse=True, return_counts=True)
        full = (count >= min_votes) & ~np.isin(pairs, tested)
        # Most votes first: these join classes, and pairs within one need no test.
        for pair in pairs[full][np.argsort(-count[full], kind="stable")].tolist():
            a, b = divmod(pair, n)
            if sets.find(a) == sets.find(b):
                continue
            inliers = consensus(found[a], found[b])
            if inliers >= needed_inliers(found[a], found[b], min_inliers):
                sets.union(a, b)
                links.append((a, b, inliers))
        tested = np.union1d(tested, pairs[full])
        return votes[(count < min_votes)[of]]

    held = np.zeros(0, np.int64)
    for table, stars in [(t, True) for t in range(STAR_TABLES)] + [(t, False) for t in range(tables)]:
        more: list[np.ndarray] = []
        for votes in matches(table, stars):
            more.append(votes)
            if sum(map(len, more)) > _VOTES:
                held, more = settle(np.concatenate([held, *more])), []
        held = settle(np.concatenate([held, *more]))
    return links


def block_links(heads: DataFrame, n_blocks: int, bits: int, tables: int, min_votes: int, min_inliers: int) -> DataFrame:
    """a, b, inliers: links that join all images of ``heads`` that have some path of links.

    Images lie in ``n_blocks`` blocks by a hash. In a turn each block meets one other (or
    itself) and in as many turns as blocks every one, so an image is one row a turn. All
    features of the pair are in one task: votes are counted and candidates confirmed there,
    and only links between classes of the task leave it, fewer than it has images.
    """
    spark = heads.sparkSession
    id_type = heads.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, high, media, schema = [], [], [], None
        for batch in batches:
            schema = batch.schema
            ids += batch.column(1).to_pylist()
            high += batch.column(2).to_pylist()
            media += [np.frombuffer(f, FEATURE) for f in batch.column(3).to_pylist()]
        if not ids:
            return
        # Rows that repeat an id are the same image.
        at = {x: k for k, x in reversed(list(enumerate(ids)))}
        order = [at[x] for x in sorted(at)]
        names, of = [ids[k] for k in order], np.array([high[k] for k in order], bool)
        every, sizes = np.concatenate([media[k] for k in order]), [len(media[k]) for k in order]
        media.clear()
        links = _links_within(every, sizes, of, bits, tables, min_votes, min_inliers)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[a] for a, _, _ in links], schema.field(1).type),
                pa.array([names[b] for _, b, _ in links], schema.field(1).type),
                pa.array([n for _, _, n in links], pa.int32()),
            ],
            ["a", "b", "inliers"],
        )

    block = F.pmod(F.xxhash64("image_id"), F.lit(n_blocks)).cast("int")
    links = []
    for first in range(0, n_blocks, TURNS_AT_ONCE):
        turns = range(first, min(n_blocks, first + TURNS_AT_ONCE))
        dealt = (
            heads.withColumn("own", block)
            .withColumn("turn", F.explode(F.array(*(F.lit(t) for t in turns))))
            .withColumn("other", F.pmod(F.col("turn") - F.col("own"), F.lit(n_blocks)))
            # A turn's pair is told by its lesser block. Each has a task of its own.
            .withColumn("pair", (F.col("turn") - first) * n_blocks + F.least("own", "other"))
            .select("pair", "image_id", (F.col("own") > F.col("other")).alias("high"), "features")
            .repartitionById(len(turns) * n_blocks, "pair")
        )
        links.append(materialize(dealt.mapInArrow(run, f"a {id_type}, b {id_type}, inliers int"), "image-links"))
        release_shuffles(spark)
    return reduce(DataFrame.unionByName, links)


def keyed_groups(stored: DataFrame, own: DataFrame, n: int, bits: int, tables: int, min_votes: int, min_inliers: int) -> DataFrame:
    """image_id, component: features are dealt out by key, one table at a time."""
    spark = stored.sparkSession
    rounds = [(t, True) for t in range(STAR_TABLES)] + [(t, False) for t in range(tables)]
    groups = tested = links = None
    met: list[DataFrame] = []
    for i, (table, stars) in enumerate(rounds):
        rows = table_rows(_heads(stored, own, groups), table, bits)
        met.append(materialize(bucket_pairs(rows, stars=stars).distinct(), "image-met"))
        release_shuffles(spark)
        if not stars and i < len(rounds) - 1:
            continue
        pairs = _voted(met, min_votes, groups, tested)
        more = _confirmed(_heads(stored, own), pairs, n, min_inliers)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = more if links is None else links.unionByName(more)
        groups = _components(links)
        release_shuffles(spark)
    return groups


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links.select("a", "b")).withColumnRenamed("node", "image_id")
    return materialize(found, "image-groups")


def image_groups(stored: DataFrame, own: DataFrame, min_votes: int, min_inliers: int) -> DataFrame:
    """image_id, component of the images in ``own`` (image_id, digest, n_features) that have a copy."""
    size = own.agg(F.count("*").alias("n"), F.sum("n_features").alias("features")).first()
    n_features = size.features or 0
    bits, tables = table_plan(n_features)
    n_blocks = max(-(-n_features // BLOCK_FEATURES), min(SPREAD_BLOCKS, -(-n_features // SPREAD_FEATURES)), 1)
    if n_blocks > MOST_BLOCKS:
        return keyed_groups(stored, own, size.n, bits, tables, min_votes, min_inliers)
    return _components(block_links(_heads(stored, own), n_blocks, bits, tables, min_votes, min_inliers))


def image_copies(images: DataFrame, min_votes: int = 2, min_inliers: int = MIN_INLIERS) -> DataFrame:
    """image_id, n_features, class_id for every row of ``images``.

    ``images`` has image_id and media (bytes). Equal bytes form a class at once. Classes are
    joined where their first images meet with ``min_votes`` different corners and agree in
    place on ``min_inliers`` corners (see ``needed_inliers``); ``class_id`` is the least id
    that links reach. Null, empty and unreadable media have no features and only equal bytes
    in their class; a null id has a null class. Rows that repeat an id share a class if their
    bytes are equal; other columns are ignored; no rows give no rows.
    """
    stored = _stored(features(images))
    narrow = stored.select("image_id", "digest", "n_features")
    classes = narrow.where("image_id is not null").groupBy("digest").agg(F.min("image_id").alias("head"))
    placed = materialize(narrow.join(classes.hint("merge"), "digest", "left"), "image-classes")
    own = materialize(
        placed.where("image_id = head and n_features > 0")
        .groupBy("image_id")
        .agg(F.min(F.struct("digest", "n_features")).alias("m"))
        .select("image_id", "m.*"),
        "image-heads",
    )
    groups = image_groups(stored, own, min_votes, min_inliers).select(F.col("image_id").alias("head"), "component")
    return (
        placed.select("image_id", "n_features", "head")
        .join(groups.hint("merge"), "head", "left")
        .select(
            "image_id",
            "n_features",
            F.when(F.col("image_id").isNotNull(), F.coalesce("component", "head")).alias("class_id"),
        )
    )


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50) -> DataFrame:
    """Synthetic images of vectors: image_id, media, one for each row and edited copies.

    A vector's values weigh fixed smooth textures, so near vectors give near images. The copy of an id that ``every``
    divides has the id -1 - id; it is cropped, re-toned and, every second one, turned.
    Null or empty vectors give null media.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                ids, media = [], []
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    image = _picture(v)
                    ids.append(i)
                    media.append(None if image is None else encode_pgm(image))
                    if i is not None and i % every == 0:
                        ids.append(-1 - i)
                        media.append(None if image is None else encode_pgm(_edited(image, i // every)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(media, pa.binary())],
                    ["image_id", "media"],
                )

    return vectors.select(id_col, vector_col).mapInArrow(run, f"image_id {id_type}, media binary")


@lru_cache(maxsize=4)
def _textures(count: int, side: int) -> np.ndarray:
    """Fixed smooth noise images, one for each value of a vector."""
    noise = np.random.Generator(np.random.PCG64(11)).normal(size=(count, side, side))
    smooth = _blur(_blur(noise.astype(np.float32), 1), 1)
    return (smooth / smooth.std(axis=(1, 2), keepdims=True)).reshape(count, -1)


def _picture(vector, side: int = 96) -> np.ndarray | None:
    if not vector:
        return None
    values = np.nan_to_num(np.array([0 if v is None else v for v in vector], np.float32))
    tones = (values @ _textures(len(values), side)).reshape(side, side)
    return 128 + 70 * np.tanh(tones / (tones.std() or 1))


def _edited(image: np.ndarray, turn: int) -> np.ndarray:
    h, w = image.shape
    cut = image[h // 16 : h - h // 32, w // 32 : w - w // 16]
    toned = 0.8 * cut + 30
    return np.rot90(toned) if turn % 2 else toned
