"""Dissolve and union of many geometries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import st
from tesselon.kernels import geometry as G
from tesselon.kernels import topology as T
from tesselon.kernels import unions as U
from tesselon.operators.frame import BOX, ROW_ID, GeoFrame, box_name, geometry_columns

#: Geometries united at once by one task before it passes a partial union on.
CHUNK = 512
#: Unions of one size that are united with each other.
FAN = 8
#: Bytes of WKB that a task holds over all its keys before it passes its partial unions on.
HELD_BYTES = 64 << 20
SALTS = 64
#: Bytes of the rows in which partial unions travel: a union of more parts takes several.
PIECE_BYTES = 1 << 20

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
    "median": F.median, "nunique": F.count_distinct, "last": lambda c: F.last(c, ignorenulls=True), "list": F.collect_list,
}


class Tiers:
    """Geometries of one key on their way to a union: ``CHUNK`` are united at once, then ``FAN`` unions of about one size, so
    each geometry is united a number of times that is logarithmic in how many there are."""

    def __init__(self):
        self.tiers: list[list[G.Geom]] = [[]]

    def add(self, g: G.Geom) -> None:
        for k in range(len(self.tiers) + 1):
            if k == len(self.tiers):
                self.tiers.append([])
            self.tiers[k].append(g)
            if len(self.tiers[k]) < (FAN if k else CHUNK):
                return
            g, self.tiers[k] = T.union_all(self.tiers[k]), []

    def union(self) -> G.Geom:
        return T.union_all([g for tier in self.tiers for g in tier])


def in_tiers(geoms: Iterable[G.Geom]) -> G.Geom:
    tiers = Tiers()
    for g in geoms:
        tiers.add(g)
    return tiers.union()


def partial_unions(df: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """Per task and key the union of the geometries it sees: what is shuffled afterwards is partial unions only.

    A task of many keys passes on what it has whenever ``HELD_BYTES`` have come in, so a key may have several partial unions.
    That of nulls alone is null.
    """
    schema = df.select(*keys, geometry).schema

    def run(batches):
        import pandas as pd

        held: dict[tuple, list[bytes]] = {}
        size = 0

        def united():
            rows, n = [], 0
            while held:
                k, v = held.popitem()
                for b in U.pieces(v, PIECE_BYTES, in_tiers) if v else [None]:
                    rows.append((*k, b))
                    n += len(b or b"")
                    if n >= PIECE_BYTES:
                        yield pd.DataFrame(rows, columns=[*keys, geometry])
                        rows, n = [], 0
            yield pd.DataFrame(rows, columns=[*keys, geometry])

        for pdf in batches:
            for row in zip(*(pdf[c].tolist() for c in pdf.columns)):
                *key, b = row
                known = held.setdefault(tuple(key), [])
                if b is not None:
                    known.append(bytes(b))
                    size += len(b)
                if size >= HELD_BYTES:
                    yield from united()
                    size = 0
        yield from united()

    return df.select(*keys, geometry).mapInPandas(run, schema)


def _unite(df: DataFrame, keys: list[str], geometry: str) -> DataFrame:
    """Partial unions, united per key and salt, then per key, as a struct ``_g``: no task gathers a large group as it came, and
    only the last result, which has to, is a row of more than a few pieces."""
    d = partial_unions(df, keys, geometry)
    salt = F.pmod(F.xxhash64(geometry), F.lit(SALTS))
    d = d.groupBy(*keys, salt.alias("_salt")).agg(F.collect_list(geometry).alias("_g"))
    d = d.select(*keys, F.explode(st.union_pieces("_g", PIECE_BYTES)).alias(geometry))
    schema = d.select(*keys, F.lit(None).cast("binary").alias("_wkb"), *[F.lit(None).cast("double").alias(f"_{c}") for c in BOX]).schema

    def run(batches):
        import pyarrow as pa

        done, size = [], 0
        key, held, types = None, [], None

        def close():
            # One alone is a union already.
            return (*key, *((U.unite(held) if len(held) > 1 else U.boxed(held[0])) if held else (None,) * 5))

        def rows():
            made = [*types, pa.binary(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), made)], names=schema.names)

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            for *k, b in zip(*(c.to_pylist() for c in batch.columns)):
                # Keys follow each other in order; NaN is one key.
                if key is None or not (k == key or all(x == y or (x != x and y != y) for x, y in zip(k, key))):
                    if key is not None:
                        done.append(close())
                    key, held = k, []
                if b is not None:
                    held.append(b)
                    size += len(b)
                if done and (size >= HELD_BYTES or len(done) >= 10_000):
                    yield rows()
                    done, size = [], 0
        if key is not None:
            done.append(close())
            yield rows()

    d = d.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    # Columns of their own, as a struct would be copied to take the geometry out of it.
    return d.select(*keys, F.struct(*[F.col(f"_{c}").alias(c) for c in ("wkb", *BOX)]).alias("_g"))


def union_all(frame: GeoFrame) -> DataFrame:
    """One row with the union of all geometries; an empty collection where there are none."""
    d = frame.df.select(F.lit(0).alias("_all"), F.col(f"`{frame.name}`").alias("geometry"))
    none = d.sparkSession.range(1).select(F.lit(0).alias("_all"), st.literal(G.EMPTY).alias("geometry"))
    return _unite(d.unionAll(none), ["_all"], "geometry").select(F.col("_g.wkb").alias("geometry"))


def dissolve(frame: GeoFrame, by: str | list[str] | None = None, aggfunc="first", dropna: bool = True, large_groups: bool = True, split_out: int | None = None) -> GeoFrame:
    """Groups rows, unites their geometries and aggregates the other columns.

    ``aggfunc`` is a name, a function from column to column, or a dict of these that also selects the
    columns.  "first" is the first non-null value by ``__row_id`` where there is one, else by the
    smallest value, so that results do not depend on the order of arrival.  ``split_out`` partitions
    the result.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    df = frame.df
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    elif dropna:
        for k in keys:
            df = df.filter(F.col(f"`{k}`").isNotNull())
    geos = {c for g in geometry_columns(df) for c in (g, box_name(g))} | {frame.name, box_name(frame.name)}
    plan = dict(aggfunc) if isinstance(aggfunc, dict) else {c: aggfunc for c in df.columns if c not in geos | set(keys) | {ROW_ID}}

    def one(c: str, f) -> Column:
        col = F.col(f"`{c}`")
        if callable(f):
            return f(col).alias(c)
        if f == "first":
            out = F.expr(f"min_by(`{c}`, `{ROW_ID}`) FILTER (WHERE `{c}` IS NOT NULL)") if ROW_ID in df.columns else F.min(col)
            return out.alias(c)
        if f not in AGGREGATES:
            raise ValueError(f"unknown aggregate {f!r}")
        return AGGREGATES[f](col).alias(c)

    values = [one(c, f) for c, f in plan.items()]
    name = frame.name
    if large_groups:
        united = _unite(df, keys, name)
        if values:
            attributes = df.groupBy(*keys).agg(*values)
            # Without keys there is one row of each, and that of the attributes is the small one.
            united = F.broadcast(attributes).join(united, keys) if not by else attributes.join(united, keys, "left") if dropna else attributes.join(united, [attributes[k].eqNullSafe(united[k]) for k in keys], "left").drop(*[united[k] for k in keys])
    else:
        # One shuffle; for groups that fit a task.
        united = df.groupBy(*keys).agg(*values, F.collect_list(name).alias("_g"))
    out = GeoFrame._built(united, name, F.col("_g") if large_groups else st.union_list("_g"), {"crs": frame.crs})
    d = out.df.drop("_g", "_all")
    return GeoFrame(d.repartition(split_out, *keys) if split_out and by else d, name)
