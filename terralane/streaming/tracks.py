"""Streaming twins of track operators: gap splits and stays as points arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "part bigint, ts double, x double, y double"
PARTS = "traj_id bigint, seq bigint, ts double, x double, y double, part bigint"


def stream_gap_split(points: DataFrame, max_seconds: float = 300.0, max_distance: float = 5000.0) -> DataFrame:
    """Number the parts of each track as its points arrive in order (planar coordinates)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator, state: GroupState):
        import pandas as pd

        part, ts, x, y = state.get if state.exists else (0, None, None, None)
        for frame in frames:
            rows = []
            for r in frame.sort_values(["ts", "seq"]).itertuples(index=False):
                if ts is not None and (
                    r.ts - ts >= max_seconds or ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5 >= max_distance
                ):
                    part += 1
                ts, x, y = float(r.ts), float(r.x), float(r.y)
                rows.append((key[0], r.seq, ts, x, y, part))
            state.update((int(part), ts, x, y))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return points.groupBy("traj_id").applyInPandasWithState(
        run, PARTS, STATE, "append", GroupStateTimeout.NoTimeout
    )


def stream_density(points: DataFrame, grid, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points in each cell and time window; ``points`` has time (timestamp), x and y."""
    from terralane.operators.rasters import with_cell

    timed = with_cell(points.withWatermark("time", late), grid)
    return timed.groupBy(F.window("time", window), "row", "col").agg(F.count("*").alias("n"))


def start_queue(stream: DataFrame, handle, checkpoint: str):
    """Hand every micro-batch to ``handle(frame, id)``, once each, until stopped."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
