"""Point texts and the track-set text format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralane.functions.projections import Mercator, map_points
from terralane.functions.scalars import to_epoch

BASE_FIELDS = ("ID", "Longitude", "Latitude", "Timestamp", "Speed", "Direction")
#: First line of a track-set file; the word in the middle names the program that wrote it.
MAGIC = r"^Stardard \S+ TrajectorySet File$"


def _text(spark: SparkSession, path: str, header: bool, separator: str, columns: int) -> DataFrame:
    parts = F.split("value", separator, -1)
    lines = spark.read.text(path).where("value <> ''")
    if header:
        # A header is the line whose place columns don't read as numbers.
        lines = lines.where(F.get(parts, F.lit(columns)).try_cast("double").isNotNull())
    return lines.select(parts.alias("p"))


def _at(i: int):
    return F.get("p", F.lit(i))


def read_points(spark: SparkSession, path: str, header: bool = False, box=None) -> DataFrame:
    """``ID,X,Y,yyyy-MM-dd HH:mm:ss`` lines of a file or folder: traj_id, x, y, ts.

    Lines that don't fit drop out; ``box`` (xmin, ymin, xmax, ymax) is inclusive.
    """
    out = _text(spark, path, header, ",", 1).select(
        _at(0).alias("traj_id"),
        _at(1).try_cast("double").alias("x"),
        _at(2).try_cast("double").alias("y"),
        to_epoch(_at(3)).cast("double").alias("ts"),
    ).dropna()
    return out if box is None else out.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def read_ais(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``~`` lines: id, _, type, epoch seconds, x and y in 1/600000 degree."""
    return _text(spark, path, header, "~", 4).select(
        _at(0).alias("traj_id"),
        (_at(4).try_cast("double") / 600000).alias("x"),
        (_at(5).try_cast("double") / 600000).alias("y"),
        _at(3).try_cast("double").alias("ts"),
        F.create_map(F.lit("aistype"), _at(2)).alias("extra"),
    ).dropna(subset=["x", "y", "ts"])


def read_flights(spark: SparkSession, path: str, header: bool = False, box=None) -> DataFrame:
    """Flight csv: lon, lat, id, ..., 9 origin, 11 destination, 16 time; Mercator metres.

    ``box`` is strict, in metres.
    """
    out = _text(spark, path, header, ",", 0).select(
        _at(2).alias("traj_id"),
        _at(0).try_cast("double").alias("x"),
        _at(1).try_cast("double").alias("y"),
        to_epoch(_at(16)).cast("double").alias("ts"),
        F.create_map(F.lit("Origin"), _at(9), F.lit("Destination"), _at(11)).alias("extra"),
    ).dropna(subset=["x", "y", "ts"])
    out = map_points(out, Mercator().forward)
    if box is None:
        return out
    x, y = F.col("x"), F.col("y")
    return out.where((x > box[0]) & (x < box[2]) & (y > box[1]) & (y < box[3]))


def with_two_points(points: DataFrame) -> DataFrame:
    """Points of tracks that have at least two."""
    n = F.count("*").over(Window.partitionBy("traj_id"))
    return points.withColumn("_n", n).where("_n >= 2").drop("_n")


def parse_track_set(text: str) -> list[tuple]:
    """(traj_id, crs, seq, x, y, ts, speed, direction, extra) of one track-set text."""
    return list(_track_set_rows(text))


def _track_set_rows(text: str):
    import re

    lines = iter(text.splitlines())
    if not re.match(MAGIC, next(lines, "")):
        raise ValueError("not a track-set text")
    count, separator = next(lines).split("\t")[:2]
    fields = next(lines).split("\t")
    for _ in range(int(count)):
        name, n = next(lines).split("\t")[:2]
        crs = next(lines)
        for seq in range(int(n)):
            v = next(lines).split(separator)
            extra = dict(zip(fields[6:], v[6:], strict=False))
            yield (name, crs, seq, *map(float, v[1:6]), extra)


TRACK_SET = (
    "traj_id string, crs string, seq int, x double, y double, ts double, speed double, "
    "direction double, extra map<string,string>"
)


def read_track_set(spark: SparkSession, path: str) -> DataFrame:
    """Track-set files, each read whole by one task; ten thousand points at most are parsed at once."""
    def run(frames):
        from itertools import islice

        import pandas as pd

        for frame in frames:
            for text in frame["value"]:
                rows = _track_set_rows(text)
                while piece := list(islice(rows, 10_000)):
                    yield pd.DataFrame(piece, columns=[c.split()[0] for c in TRACK_SET.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, TRACK_SET)


def track_set_lines(
    points: DataFrame, crs: str = "Unknown", separator: str = ",", program: str = "Terralane", files: int = 1
) -> DataFrame:
    """file, place, value: the lines of ``files`` track-set texts, each in order of ``place``.

    A track is whole in one file, which a hash of its id chooses. Extra keys of all points
    become columns, blank where a point lacks one.
    """
    keys = [r[0] for r in points.select(F.explode(F.map_keys("extra")).alias("k")).distinct().orderBy("k").collect()]
    file = F.pmod(F.xxhash64("traj_id"), F.lit(files)).cast("int").alias("file")
    place = lambda t, a, b: F.struct(t.alias("track"), F.lit(a).alias("kind"), b.cast("double").alias("at"), F.lit(0).alias("seq")).alias("place")
    tracks = points.groupBy("traj_id").agg(F.count("*").alias("n"))
    counts = tracks.groupBy(file).agg(F.count("*").alias("n"))
    every = points.sparkSession.range(files).select(F.col("id").cast("int").alias("file")).join(counts, "file", "left")
    head = F.array(
        F.lit(f"Stardard {program} TrajectorySet File"),
        F.concat_ws("\t", F.coalesce("n", F.lit(0)), F.lit(separator)),
        F.lit("\t".join([*BASE_FIELDS, *keys])),
    )
    first = every.select("file", F.posexplode(head).alias("i", "value")).select(
        "file", place(F.lit(""), 0, F.col("i")), "value"
    )
    names = tracks.select(file, place(F.col("traj_id"), 1, F.lit(0)), F.concat_ws("\t", "traj_id", "n").alias("value"))
    systems = tracks.select(file, place(F.col("traj_id"), 2, F.lit(0)), F.lit(crs).alias("value"))
    values = [F.coalesce(F.col("extra")[k], F.lit("")) for k in keys]
    rows = points.select(
        file,
        F.struct(F.col("traj_id").alias("track"), F.lit(3).alias("kind"), F.col("ts").alias("at"), F.col("seq").alias("seq")).alias("place"),
        F.concat_ws(
            separator,
            F.col("traj_id"),
            *(F.coalesce(F.col(c), F.lit(-1.0)).cast("string") for c in ("x", "y", "ts", "speed", "direction")),
            *values,
        ).alias("value"),
    )
    return first.unionByName(names).unionByName(systems).unionByName(rows)


#: Points of one track-set text, on average, where the number of texts follows the points.
FILE_POINTS = 50_000


def files_for(points: DataFrame, least: int = 1) -> int:
    """How many texts hold ``FILE_POINTS`` points each, ``least`` at least: a text is read whole by one task."""
    return max(least, -(-points.count() // FILE_POINTS))


def write_track_set(points: DataFrame, path: str, files: int = 1, **settings) -> None:
    """One text or, with more ``files``, folders file=0, file=1, ... with a whole track set each.

    The format is one ordered stream, so a text is written by one task; more files spread
    the tracks over as many tasks.
    """
    lines = track_set_lines(points, files=files, **settings)
    ordered = lines.repartition(files, "file").sortWithinPartitions("file", "place")
    if files == 1:
        ordered.select("value").write.mode("overwrite").text(path)
    else:
        ordered.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def hash_split(df: DataFrame, path: str, key: str, buckets: int, how: str = "chars") -> None:
    """Write rows into one folder per bucket of a string hash of ``key``."""
    from terralane.functions.scalars import string_hash

    df.withColumn("bucket", string_hash(F.col(key).cast("string"), how, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def reservoir(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A repeatable sample of n rows: those that a hash of the key ranks first."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
