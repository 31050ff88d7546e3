"""Geometry on streams: row operations, fixed-bounds curves, box slices and stream-static joins carry no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import st
from tesselon.operators.frame import GeoFrame, box_name, points_from_xy
from tesselon.operators.sjoin import Grid, cell_join


def stream_points(stream: DataFrame, x: str, y: str, crs=None) -> GeoFrame:
    return points_from_xy(stream, x, y, crs=crs)


def windowed_counts(frame: GeoFrame, time: str, late: str, window: str, keys: list[str | Column], bounds, level: int = 8) -> DataFrame:
    """Counts per time window and Hilbert cell of fixed bounds; rows later than the watermark are dropped by Spark."""
    keyed = frame.hilbert_distance(bounds, level, "cell").df.withWatermark(time, late)
    return keyed.groupBy(F.window(time, window), "cell", *keys).count()


def join_static(stream: GeoFrame, static: GeoFrame, size: float, predicate: str = "within", top: int = 0) -> DataFrame:
    """Inner spatial join of a stream with a table on grid cells of a given size."""
    right = static.df.withColumnsRenamed({static.name: "_rg", box_name(static.name): "_rb"})
    levels = frozenset(range(top + 1))
    met = cell_join(stream.df, box_name(stream.name), right, "_rb", predicate, Grid(size, top, levels, levels))
    return met.filter(st.predicates[predicate](stream.geometry, F.col("_rg"))).drop("_rg", "_rb")
