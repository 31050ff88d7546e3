"""Geometry on streams with state: sessions by cell, and paths of moving points.

State is bounded by the watermark: sessions are Spark's own; a path keeps its last settled point, its length,
and the points that are not yet older than the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.operators.frame import GeoFrame

PATHS = "key {kind}, time timestamp, x double, y double, length double"
_STATE = "x double, y double, length double, n long, times array<long>, xs array<double>, ys array<double>"


def session_counts(frame: GeoFrame, time: str, late: str, gap: str, keys: list[str | Column], bounds, level: int = 8) -> DataFrame:
    """Counts per session (visits to a Hilbert cell of fixed bounds with less than ``gap`` between them); rows later than the watermark are dropped."""
    keyed = frame.hilbert_distance(bounds, level, "cell").df.withWatermark(time, late)
    return keyed.groupBy(F.session_window(time, gap).alias("session"), "cell", *keys).agg(F.count("*").alias("n"))


def path_lengths(frame: GeoFrame, key: str, time: str, late: str) -> DataFrame:
    """key, time, x, y, length: each point of a key's path with the length so far, in order of time.

    A point is given out once the watermark has passed it, so points that come late, within ``late``, take their place in
    the path; later ones are dropped.  Points of one time follow each other by coordinates.  Rows without key, time or
    geometry have no place on a path.
    """
    b = frame.bbox
    points = frame.df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").cast("timestamp").alias("time"), b["xmin"].alias("x"), b["ymin"].alias("y"))
    points = points.withWatermark("time", late).filter("key is not null and time is not null and x is not null")
    kind = points.schema["key"].dataType.simpleString()

    def step(key, batches, state):
        import math

        import pandas as pd

        x, y, length, n, times, xs, ys = state.get if state.exists else (0.0, 0.0, 0.0, 0, [], [], [])
        due = state.getCurrentWatermarkMs() * 1000
        waiting = list(zip(times, xs, ys))
        if not state.hasTimedOut:
            for pdf in batches:
                t = pdf["time"].astype("datetime64[us]").astype("int64")
                waiting += [r for r in zip(t.tolist(), pdf["x"].tolist(), pdf["y"].tolist()) if r[0] > due]
        waiting.sort()
        out = []
        while waiting and waiting[0][0] <= due:
            t, px, py = waiting.pop(0)
            length += math.hypot(px - x, py - y) if n else 0.0
            x, y, n = px, py, n + 1
            out.append((key[0], pd.Timestamp(t, unit="us"), px, py, length))
        state.update((x, y, length, n, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "time", "x", "y", "length"])

    return points.groupBy("key").applyInPandasWithState(step, PATHS.format(kind=kind), _STATE, "append", "EventTimeTimeout")
