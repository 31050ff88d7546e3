"""Spatial partitioning and the extents of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.kernels import geometry as G
from tesselon.kernels import measures as M
from tesselon.operators.frame import BOX, GeoFrame

CURVES = ("hilbert", "morton", "geohash")


def spatial_shuffle(frame: GeoFrame, by: str = "hilbert", level: int | None = None, calculate_partitions: bool = True, npartitions: int | None = None, divisions=None) -> GeoFrame:
    """Rows in ranges of a curve, sorted by it; the curve's column stays as the order."""
    if by not in CURVES:
        raise ValueError(f"by must be one of {', '.join(CURVES)}")
    if by == "geohash":
        keyed, col = frame.geohash(as_string=False), "geohash"
    else:
        col = f"{by}_distance"
        keyed = getattr(frame, col)(level=16 if level is None else level)
    out = range_partition(keyed, col, npartitions, divisions)
    return out.calculate_spatial_partitions() if calculate_partitions else out


def range_partition(frame: GeoFrame, col: str, npartitions: int | None = None, divisions=None, sorted_: bool = False) -> GeoFrame:
    """Range partitions by a column; explicit ``divisions`` give exactly one partition between each two of them."""
    if sorted_:
        return frame
    if divisions is not None:
        d = list(divisions)
        bucket = F.lit(0)
        for k, v in enumerate(d[1:-1], 1):
            bucket = F.when(F.col(f"`{col}`") >= F.lit(v), F.lit(k)).otherwise(bucket)
        out = frame.df.repartitionById(len(d) - 1, bucket.cast("int"))
    else:
        out = frame.df.repartitionByRange(npartitions, col) if npartitions else frame.df.repartitionByRange(col)
    return GeoFrame(out.sortWithinPartitions(col), frame.name)


def partition_extents(frame: GeoFrame, hull: bool = False) -> DataFrame:
    """Per partition the box of its rows and, if asked for, the convex hull as WKB.

    Partition ids hold for a layout that is not planned anew: persist or write the frame before.
    """
    b = frame.bbox
    if not hull:
        d = frame.df.select(F.spark_partition_id().alias("partition_id"), *[b[k].alias(k) for k in BOX])
        return d.groupBy("partition_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))

    def run(batches):
        import pandas as pd

        part, points = None, []
        for pdf in batches:
            for pid, wkb in zip(pdf["partition_id"], pdf["g"]):
                part = pid
                if wkb is not None:
                    points += [c[:2] for c in G.from_wkb(bytes(wkb)).coords()]
            points = [c[:2] for c in M.convex_hull(_points(points)).coords()]
        if part is not None:
            h = M.convex_hull(_points(points))
            yield pd.DataFrame([(part, *(h.bounds() or (None,) * 4), G.to_wkb(h))], columns=["partition_id", *BOX, "hull"])

    d = frame.df.select(F.spark_partition_id().alias("partition_id"), frame.geometry.alias("g"))
    return d.mapInPandas(run, "partition_id int, xmin double, ymin double, xmax double, ymax double, hull binary")


def _points(c) -> G.Geom:
    return G.Geom(G.MULTIPOINT, [G.Geom(G.POINT, tuple(p)) for p in c])
