"""Spatial join as an equi-join on grid cells.

Boxes are dealt to levels of a grid hierarchy by their size, so a box covers at most four cells of its
level.  A pair meets at the coarser of its two levels: every row is placed on its own level and on those
coarser ones that occur on the other side.  The coarsest level still has ``SPREAD`` cells along each side
of the common extent; a larger box is cut into cells of it, at most ``(SPREAD + 1) ** 2``, so one box over
everything neither multiplies the other side nor makes a key that holds it whole.  Of the cells that a pair
shares only the one that holds the lower corner of their common box reports it, so no distinct is needed.
Box conditions are part of the join; the exact relation runs on what is left, or is itself arithmetic where
both sides are known to hold points or boxes.  Hot cells are split by adaptive skew handling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import st
from tesselon.operators.frame import ROW_ID, GeoFrame, box_condition, box_name, box_predicate, fixed, geometry_columns

PREDICATES = ("contains", "contains_properly", "covered_by", "covers", "crosses", "intersects", "overlaps", "touches", "within")


SPREAD = 16


@dataclass(frozen=True)
class Grid:
    """Cell size of level 0, the coarsest level, and the levels on which each side has boxes."""

    size: float
    top: int
    left: frozenset[int]
    right: frozenset[int]


def _extent(box: Column) -> Column:
    return F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])


def _stats(df: DataFrame, box: str):
    """By binary exponent of the box size (null for points): how many, their mean size and total bounds.  A few rows."""
    b = F.col(box)
    size = _extent(b)
    e = F.when(size > 0, F.ceil(F.log2(size)).cast("int")).alias("e")
    return df.filter(b.isNotNull()).groupBy(e).agg(F.count("*"), F.sum(size), F.min(b["xmin"]), F.min(b["ymin"]), F.max(b["xmax"]), F.max(b["ymax"])).collect()


def grid(left: DataFrame, lbox: str, right: DataFrame, rbox: str) -> Grid | None:
    """The grid of a join; None if a side has no boxes."""
    sides = _stats(left, lbox), _stats(right, rbox)
    if not all(sides):
        return None
    every = [r for s in sides for r in s]
    extent = max(max(r[5] for r in every) - min(r[3] for r in every), max(r[6] for r in every) - min(r[4] for r in every))
    n = [sum(r[1] for r in s) for s in sides]
    mean = [sum(r[2] for r in s) / k for s, k in zip(sides, n)]
    # About one row to a cell if spread evenly, but no finer than the typical box of the side with smaller ones.
    size = max(min(mean), extent / max(1.0, math.sqrt(max(n))), max(extent, 1e-9) / 2**20)
    base = math.ceil(math.log2(size))
    top = max(0, math.floor(math.log2(max(extent, size))) - base - int(math.log2(SPREAD)))
    level = lambda e: 0 if e is None else min(top, max(0, e - base))
    return Grid(2.0**base, top, *(frozenset(level(r[0]) for r in s) for s in sides))


def _cells(df: DataFrame, box: str, g: Grid, other: frozenset[int]) -> DataFrame:
    """A row for the box's own level and each coarser one of the other side, and for each cell that it meets there."""
    b = F.col(box)
    size = _extent(b)
    own = F.when(size > g.size, F.ceil(F.log2(size / F.lit(g.size)))).otherwise(F.lit(0)).cast("int")
    d = df.filter(b.isNotNull()).withColumn("_own", F.greatest(F.lit(0), F.least(own, F.lit(g.top))))
    coarser = F.filter(F.array(*[F.lit(k) for k in sorted(other)]), lambda k: k > F.col("_own"))
    d = d.withColumn("_level", F.explode(F.concat(F.array("_own"), coarser)))
    cell = lambda k: F.floor(b[k] / (F.lit(g.size) * F.pow(F.lit(2.0), F.col("_level"))))
    d = d.withColumn("_cx", F.explode(F.sequence(cell("xmin"), cell("xmax"))))
    return d.withColumn("_cy", F.explode(F.sequence(cell("ymin"), cell("ymax"))))


def cell_join(left: DataFrame, lbox: str, right: DataFrame, rbox: str, predicate: str, on: Grid) -> DataFrame:
    """Pairs whose boxes allow the relation, each once."""
    a, b = _cells(left, lbox, on, on.right), _cells(right, rbox, on, on.left).withColumnRenamed("_own", "_rown")
    p, q = F.col(f"`{lbox}`"), F.col(f"`{rbox}`")
    g = F.lit(on.size) * F.pow(F.lit(2.0), F.col("_level"))
    met = a.join(b, ["_level", "_cx", "_cy"]).filter(
        (F.col("_level") == F.greatest("_own", "_rown"))
        & box_condition(predicate, p, q)
        & (F.col("_cx") == F.floor(F.greatest(p["xmin"], q["xmin"]) / g))
        & (F.col("_cy") == F.floor(F.greatest(p["ymin"], q["ymin"]) / g))
    )
    return met.drop("_level", "_cx", "_cy", "_own", "_rown")


def sjoin(left: GeoFrame, right: GeoFrame, how: str = "inner", predicate: str = "intersects", lsuffix: str = "left", rsuffix: str = "right", index_right: str | None = None, op: str | None = None) -> GeoFrame:
    """Left rows with the attributes of each right row they relate to; the left geometry is kept.

    ``how`` is inner, left (rows without a partner get nulls), semi or anti.  ``index_right`` names a
    right column to report as ``index_right``.
    """
    if op is not None:
        import warnings

        warnings.warn("op is deprecated; use predicate", FutureWarning, stacklevel=2)
        predicate = op
    if predicate not in PREDICATES:
        raise ValueError(f"predicate must be one of {', '.join(PREDICATES)}")
    if how not in ("inner", "left", "semi", "anti"):
        raise NotImplementedError("how must be inner, left, semi or anti")
    lg, rg = left.name, right.name
    # Files that no file of the other side can meet are not read; of the left side only where its rows may go.
    reach = lambda f: [b for _, b in f.files.boxes]
    if left.files is not None:
        right = right.within_reach(reach(left))
    if right.files is not None and how in ("inner", "semi"):
        left = left.within_reach(reach(right))
    skip = {rg, box_name(rg)} | {c for g in geometry_columns(right.df) for c in (g, box_name(g))}
    values = [c for c in right.df.columns if c not in skip]
    clash = {c for c in values if c in left.df.columns}
    l = left.df.withColumnsRenamed({c: f"{c}_{lsuffix}" for c in clash})
    r = right.df.select(
        F.col(f"`{rg}`").alias("_rg"),
        F.col(f"`{box_name(rg)}`").alias("_rb"),
        *[F.col(f"`{c}`").alias(f"{c}_{rsuffix}" if c in clash else c) for c in values],
        *([F.col(f"`{index_right}`").alias("index_right")] if index_right else []),
    )
    new = [c for c in r.columns if c not in ("_rg", "_rb")]
    if how != "inner":
        # An explicit row id where there is one; else one that a checkpoint fixes, since both sides of the last join need it.
        l = l.withColumn("_lid", F.col(ROW_ID)) if ROW_ID in l.columns else fixed(l.withColumn("_lid", F.monotonically_increasing_id()))
    lb = box_name(lg)
    sized = grid(left.df, lb, right.df, box_name(rg))
    if sized is None:
        found = l.limit(0).crossJoin(r.limit(0))
    else:
        p, q = F.col(f"`{lb}`"), F.col("_rb")
        joined = cell_join(l, lb, r, "_rb", predicate, sized)
        types = [f.meta.get("types") for f in (left, right)]
        exact = box_predicate(predicate, p, types[0] == ["Point"], q, types[1] == ["Point"]) if all(t in (["Point"], ["Box"]) for t in types) else None
        found = joined.filter(st.predicates[predicate](F.col(f"`{lg}`"), F.col("_rg")) if exact is None else exact)
    if how == "inner":
        out = found.select(*[F.col(f"`{c}`") for c in l.columns], *[F.col(f"`{c}`") for c in new])
    elif how == "left":
        out = l.join(found.select("_lid", *[F.col(f"`{c}`") for c in new]), "_lid", "left").drop("_lid")
    else:
        out = l.join(found.select("_lid").distinct(), "_lid", f"left_{how}").drop("_lid")
    return GeoFrame(out, lg)


def sjoin_nearest(left: GeoFrame, right: GeoFrame, k: int = 1, max_distance: float | None = None, distance_col: str = "distance", max_rounds: int = 40) -> DataFrame:
    """Each left row with its ``k`` nearest right rows by distance, ties to the smaller right row id.

    Expanding search: rows look in boxes of a radius; those whose ``k``-th partner is not surely nearest
    go on with twice the radius.  Both frames need ``__row_id``.  Rows without geometry find nothing.
    """
    from pyspark.sql.window import Window

    for f in (left, right):
        if ROW_ID not in f.df.columns:
            raise ValueError("both frames need an explicit __row_id")
    sized = grid(left.df, box_name(left.name), right.df, box_name(right.name))
    right_rows = right.df.select(F.col(ROW_ID).alias("right_id"), F.col(f"`{right.name}`").alias("_rg"), F.col(f"`{box_name(right.name)}`").alias("_rb")).filter("_rb is not null")
    n = right_rows.count()
    todo = left.df.select(F.col(ROW_ID).alias("left_id"), F.col(f"`{left.name}`").alias("_lg"), F.col(f"`{box_name(left.name)}`").alias("_lb")).filter("_lb is not null")
    schema = "left_id bigint, right_id bigint, distance double"
    done = left.df.sparkSession.createDataFrame([], schema)
    if sized is not None and n:
        radius, want = sized.size, min(k, n)
        for _ in range(max_rounds):
            limit = radius if max_distance is None else min(radius, max_distance)
            b = F.col("_lb")
            wide = todo.withColumn("_wide", F.struct(*[(b[c] + F.lit(s * limit)).alias(c) for c, s in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))]))
            near = grid(wide, "_wide", right_rows, "_rb")
            if near is None:  # no row is left to look for
                break
            hits = cell_join(wide, "_wide", right_rows, "_rb", "intersects", near)
            hits = hits.select("left_id", "right_id", st.distance("_lg", "_rg").alias("distance")).filter(F.col("distance") <= limit)
            rank = F.row_number().over(Window.partitionBy("left_id").orderBy("distance", "right_id"))
            best = fixed(hits.withColumn("_r", rank).filter(F.col("_r") <= want))
            last = max_distance is not None and limit >= max_distance
            full = best.groupBy("left_id").agg(F.count("*").alias("_n")).filter(F.lit(last) | (F.col("_n") >= want)).select("left_id")
            done = fixed(done.unionByName(best.join(full, "left_id", "left_semi").select("left_id", "right_id", "distance")))
            todo = fixed(todo.join(full, "left_id", "left_anti"))
            if last or todo.isEmpty():
                break
            radius *= 2
    return done.withColumnRenamed("distance", distance_col)
