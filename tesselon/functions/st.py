"""Geometry functions on columns of WKB.

What the type code or the bounding box decides is a Catalyst expression; the rest are Arrow batches
through the planar kernels.  Functions that build geometries return ``struct<wkb, xmin, ymin, xmax,
ymax>``, so that the box companion costs no second pass.  A null or unreadable-by-absence input gives
null; comparisons with a missing side give false.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tesselon.kernels import columns as K
from tesselon.kernels import geometry as G
from tesselon.kernels import measures as M
from tesselon.kernels import topology as T
from tesselon.kernels import unions as U

BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
BUILT = "struct<wkb:binary,xmin:double,ymin:double,xmax:double,ymax:double>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(g) -> Column:
    """A geometry constant as WKB."""
    return F.lit(bytearray(G.to_wkb(G.as_geom(g))))


@cache
def _decoder():
    """WKB to geometry, keeping the last few: join outputs repeat one side."""
    kept: dict[bytes, G.Geom] = {}

    def read(b):
        if b is None:
            return None
        b = bytes(b)
        g = kept.get(b)
        if g is None:
            if len(kept) > 256:
                kept.clear()
            g = kept[b] = G.from_wkb(b)
        return g

    return read


def scalar(f: Callable, returns: str, missing=None, arity: int = 1):
    """A column function from a kernel that takes geometries first and then constants."""

    def apply(*cols, **constants):
        def run(*series: pd.Series) -> pd.Series:
            read = _decoder()
            out = []
            for row in zip(*series):
                g = [read(b) for b in row]
                out.append(missing if any(x is None for x in g) else f(*g, **constants))
            return pd.Series(out, dtype=object)

        body = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[arity]
        body.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series} if arity == 2 else {"a": pd.Series, "return": pd.Series}
        return F.pandas_udf(body, returns)(*[_col(c) for c in cols])

    return apply


def _row(g: G.Geom | None):
    if g is None:
        return (None,) * 5
    return (G.to_wkb(g), *(g.bounds() or (None,) * 4))


def builder(f: Callable, arity: int = 1):
    """As ``scalar`` for kernels that give a geometry: a struct of its WKB and box."""

    def apply(*cols, **constants):
        def run(*series: pd.Series) -> pd.DataFrame:
            read = _decoder()
            rows = []
            for row in zip(*series):
                g = [read(b) for b in row]
                rows.append(_row(None if any(x is None for x in g) else f(*g, **constants)))
            return pd.DataFrame(rows, columns=["wkb", "xmin", "ymin", "xmax", "ymax"])

        body = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[arity]
        body.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame} if arity == 2 else {"a": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(body, BUILT)(*[_col(c) for c in cols])

    return apply


# By type code and box alone

def type_code(wkb: Column | str) -> Column:
    """ISO type code of little-endian WKB."""
    h = F.hex(F.substring(_col(wkb), 2, 4))
    swapped = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.conv(swapped, 16, 10).cast("int")


def geom_type(wkb: Column | str) -> Column:
    code = type_code(wkb) % 1000
    return F.element_at(F.array(*[F.lit(G.NAMES[k]) for k in sorted(G.NAMES)]), code)


def has_z(wkb: Column | str) -> Column:
    return type_code(wkb) >= 1000


def is_point(wkb: Column | str) -> Column:
    return type_code(wkb) % 1000 == 1


# Measures and predicates of one geometry

def _measure(columns: Callable, kernel: Callable):
    """A measure whose values of one shape are computed together, the rest one by one."""

    def run(s: pd.Series) -> pd.Series:
        values = s.tolist()
        out, left = columns(values)
        found = pd.Series(out, dtype="Float64").mask(pd.Series([v is None for v in values], dtype=bool))
        for i in left.tolist():
            found[i] = kernel(G.from_wkb(bytes(values[i])))
        return found.astype(object).where(found.notna(), None)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(run, "double")(_col(c))


area = _measure(K.area, M.area)
length = _measure(K.length, M.length)
is_valid = scalar(T.is_valid, "boolean", False)
is_simple = scalar(T.is_simple, "boolean", False)
is_empty = scalar(lambda g: g.is_empty, "boolean", False)
is_ring = scalar(lambda g: g.kind == G.LINE and len(g.data) > 2 and g.data[0][:2] == g.data[-1][:2] and T.is_simple(g), "boolean", False)
interiors = scalar(lambda g: None if M.interiors(g) is None else [G.to_wkb(r) for r in M.interiors(g)], "array<binary>")
parts = scalar(lambda g: [G.to_wkb(p) for p in (g.data if g.kind > G.POLYGON else [g])], "array<binary>")
wkt = scalar(lambda g, rounding_precision=6, trim=True: G.to_wkt(g, rounding_precision, trim), "string")
geojson = scalar(lambda g: __import__("json").dumps(G.to_mapping(g)), "string")


def _ordinate(k: int):
    def f(g):
        if g.kind != G.POINT:
            raise ValueError("x, y and z are given for points only")
        return None if g.data is None or len(g.data) <= k else float(g.data[k])

    return f


x, y, z = (scalar(_ordinate(k), "double") for k in range(3))


def bbox(wkb: Column | str) -> Column:
    """The box of any geometry, null for null and empty ones."""

    def run(s: pd.Series) -> pd.DataFrame:
        read = _decoder()
        rows = [(None if b is None else read(b).bounds()) or (None,) * 4 for b in s]
        return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")

    out = F.pandas_udf(run, BBOX)(_col(wkb))
    return F.when(out["xmin"].isNotNull(), out)


# Builders of one geometry

def _same(g):
    return g


normalize = builder(_same)
boundary = builder(M.boundary)
def centroid(c: Column | str) -> Column:
    """Centroids; those of values of one shape are computed together."""

    def run(s: pd.Series) -> pd.DataFrame:
        import numpy as np

        values = s.tolist()
        x, y, left = K.centroid(values)
        rec = np.empty(len(values), np.dtype([("b", "u1"), ("t", "<u4"), ("x", "<f8"), ("y", "<f8")]))
        rec["b"], rec["t"], rec["x"], rec["y"] = 1, 1, x, y
        data, size = rec.tobytes(), rec.dtype.itemsize
        rows = [_row(None) if v is None else (data[i * size : (i + 1) * size], *xy, *xy) for i, (v, xy) in enumerate(zip(values, zip(x.tolist(), y.tolist())))]
        for i in left.tolist():
            rows[i] = _row(M.centroid(G.from_wkb(bytes(values[i]))))
        return pd.DataFrame(rows, columns=["wkb", "xmin", "ymin", "xmax", "ymax"])

    return F.pandas_udf(run, BUILT)(_col(c))


convex_hull = builder(M.convex_hull)
envelope = builder(M.envelope)
exterior = builder(M.exterior)
representative_point = builder(M.representative_point)
_buffer = builder(T.buffer)


def buffer(c: Column | str, distance: float, resolution: int = 16, cap_style: str = "round", join_style: str = "round", mitre_limit: float = 5.0, single_sided: bool = False) -> Column:
    """Buffers; those inwards of convex polygons, whose corners no style can change, are computed together."""
    styles = {"resolution": resolution, "cap_style": cap_style, "join_style": join_style, "mitre_limit": mitre_limit}
    if not distance < 0 or resolution < 1 or single_sided:
        return _buffer(c, distance=distance, single_sided=single_sided, **styles)

    def run(s: pd.Series) -> pd.DataFrame:
        values = s.tolist()
        found, left = K.inset(values, -distance)
        for i in left:
            found[i] = _row(T.buffer(G.from_wkb(bytes(values[i])), distance, **styles))
        rows = [found.get(i) or _row(None) for i in range(len(values))]
        return pd.DataFrame(rows, columns=["wkb", "xmin", "ymin", "xmax", "ymax"])

    return F.pandas_udf(run, BUILT)(_col(c))


simplify = builder(M.simplify)
interpolate = builder(M.interpolate)
affine_transform = builder(M.affine)
translate = builder(M.translate)
rotate = builder(M.rotate)
scale = builder(M.scale)
skew = builder(M.skew)

# Two geometries

PREDICATES = ("contains", "geom_equals", "crosses", "disjoint", "intersects", "overlaps", "touches", "within", "covers", "covered_by", "contains_properly")


def _named(name: str):
    return lambda a, b: T.predicate(name, a, b)


# Relations that the location of a point decides, by whether the point is the first or the second geometry.
_BY_LOCATION = {
    True: {"within": (T.I,), "covered_by": (T.I, T.B), "intersects": (T.I, T.B), "touches": (T.B,), "disjoint": (T.E,)},
    False: {"contains": (T.I,), "contains_properly": (T.I,), "covers": (T.I, T.B), "intersects": (T.I, T.B), "touches": (T.B,), "disjoint": (T.E,)},
}
_POINT_HEAD = b"\x01\x01\x00\x00\x00"


def _by_location(name: str, points: list, areas: list, first: bool, out: list) -> None:
    """Settles the rows of a batch that hold points against one area, a whole array of points at a time."""
    import numpy as np

    accept = _BY_LOCATION[first].get(name)
    if accept is None:
        return
    groups: dict[bytes, list[int]] = {}
    for i, (p, q) in enumerate(zip(points, areas)):
        if p is not None and q is not None and len(p) == 21 and len(q) > 21 and bytes(p[:5]) == _POINT_HEAD:
            groups.setdefault(bytes(q), []).append(i)
    read = _decoder()
    for wkb, rows in groups.items():
        if len(rows) < 4:
            continue
        g = read(wkb)
        if g.kind not in (G.POLYGON, G.MULTIPOLYGON) or g.is_empty:
            continue
        xy = np.frombuffer(b"".join(bytes(points[i][5:]) for i in rows), "<f8").reshape(-1, 2) + 0.0
        at = T.locate_many(T.Member(g), xy[:, 0], xy[:, 1])
        empty = np.isnan(xy[:, 0])
        for i, v, e in zip(rows, np.isin(at, accept).tolist(), empty.tolist()):
            out[i] = name == "disjoint" if e else v


def _predicate(name: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        read = _decoder()
        out: list = [None] * len(a)
        left, right = a.tolist(), b.tolist()
        _by_location(name, left, right, True, out)
        _by_location(name, right, left, False, out)
        for i, (p, q) in enumerate(zip(left, right)):
            if out[i] is None:
                out[i] = False if p is None or q is None else T.predicate(name, read(p), read(q))
        return pd.Series(out, dtype=bool)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return lambda a, b: F.pandas_udf(run, "boolean")(_col(a), _col(b))


predicates = {n: _predicate(n) for n in PREDICATES}
equals_exact = scalar(T.equals_exact, "boolean", False, 2)
distance = scalar(T.distance, "double", None, 2)
relate = scalar(T.relate, "string", None, 2)
project = scalar(M.project, "double", None, 2)


def _op(name: str):
    return lambda a, b: T.overlay(name, a, b)


overlays = {n: builder(_op(n), 2) for n in T.OPS}


# From and to other forms

def points(px: Column | str, py: Column | str, pz: Column | str | None = None) -> Column:
    """WKB points packed from whole Arrow columns; null where a coordinate is."""
    import pyarrow as pa

    def run(*cols):
        import numpy as np
        import pyarrow.compute as pc

        cols = [c.cast(pa.float64()) for c in cols]
        dim = len(cols)
        rec = np.empty(len(cols[0]), np.dtype([("b", "u1"), ("t", "<u4"), *[(f"c{i}", "<f8") for i in range(dim)]]))
        rec["b"], rec["t"] = 1, 1 if dim == 2 else 1001
        for i, c in enumerate(cols):
            rec[f"c{i}"] = pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False)
        out = pa.Array.from_buffers(pa.binary(rec.dtype.itemsize), len(rec), [None, pa.py_buffer(rec.tobytes())]).cast(pa.binary())
        valid = cols[0].is_valid()
        for c in cols[1:]:
            valid = pc.and_(valid, c.is_valid())
        return pc.if_else(valid, out, pa.scalar(None, pa.binary()))

    if pz is None:
        body = lambda a, b: run(a, b)
        body.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
        return F.arrow_udf(body, "binary")(_col(px).cast("double"), _col(py).cast("double"))
    body = lambda a, b, c: run(a, b, c)
    body.__annotations__ = {"a": pa.Array, "b": pa.Array, "c": pa.Array, "return": pa.Array}
    return F.arrow_udf(body, "binary")(_col(px).cast("double"), _col(py).cast("double"), _col(pz).cast("double"))


def boxes(xmin, ymin, xmax, ymax) -> Column:
    """WKB boxes packed from four columns; null where one is."""
    import pyarrow as pa

    def run(a, b, c, d):
        import numpy as np
        import pyarrow.compute as pc

        v = [pc.fill_null(s.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for s in (a, b, c, d)]
        rec = np.empty(len(v[0]), np.dtype([("b", "u1"), ("t", "<u4"), ("r", "<u4"), ("n", "<u4"), ("c", "<f8", (5, 2))]))
        rec["b"], rec["t"], rec["r"], rec["n"] = 1, 3, 1, 5
        for k, (i, j) in enumerate(((2, 1), (2, 3), (0, 3), (0, 1), (2, 1))):
            rec["c"][:, k, 0], rec["c"][:, k, 1] = v[i], v[j]
        out = pa.Array.from_buffers(pa.binary(rec.dtype.itemsize), len(rec), [None, pa.py_buffer(rec.tobytes())]).cast(pa.binary())
        valid = pc.and_(pc.and_(a.is_valid(), b.is_valid()), pc.and_(c.is_valid(), d.is_valid()))
        return pc.if_else(valid, out, pa.scalar(None, pa.binary()))

    run.__annotations__ = {k: pa.Array for k in ("a", "b", "c", "d", "return")}
    return F.arrow_udf(run, "binary")(*[_col(c).cast("double") for c in (xmin, ymin, xmax, ymax)])


def from_wkt(text: Column | str) -> Column:
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(None if t is None else G.from_wkt(t)) for t in s], columns=["wkb", "xmin", "ymin", "xmax", "ymax"])

    return F.pandas_udf(run, BUILT)(_col(text))


def union_list(geoms: Column | str) -> Column:
    """Union of an array of WKB."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if a is None else U.unite([bytes(b) for b in a if b is not None]) for a in s]
        return pd.DataFrame(rows, columns=["wkb", "xmin", "ymin", "xmax", "ymax"])

    return F.pandas_udf(run, BUILT)(_col(geoms))


def union_pieces(geoms: Column | str, size: int) -> Column:
    """Union of an array of unions as an array of geometries of about ``size`` bytes; one null where there are none."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([U.pieces([bytes(b) for b in a], size) if len(a) > 1 else list(a) or [None] for a in s], dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<binary>")(_col(geoms))


def union_agg(geoms: Column | str) -> Column:
    """Union of a group as an aggregate function.  It gathers each group whole; see ``dissolve`` for large groups."""

    def run(s: pd.Series) -> bytes:
        return U.unite([bytes(b) for b in s if b is not None])[0]

    run.__annotations__ = {"s": pd.Series, "return": bytes}
    return F.pandas_udf(run, "binary")(_col(geoms))


class Dump:
    """Table function: the parts of a geometry, numbered from 0; a null or empty one has none."""

    def eval(self, g: bytes):
        if g is not None:
            for i, part in enumerate(G.from_wkb(bytes(g)).parts()):
                yield i, G.to_wkb(part)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions that need no constants callable from SQL as ``st_*``, and ``st_dump`` as a table function; names registered are returned."""

    def one(f, returns, nulls=None):
        def run(s: pd.Series) -> pd.Series:
            read = _decoder()
            return pd.Series([nulls if b is None else f(read(b)) for b in s], dtype=object)

        return F.pandas_udf(run, returns)

    def two(f, returns, nulls=None):
        def run(s: pd.Series, t: pd.Series) -> pd.Series:
            read = _decoder()
            return pd.Series([nulls if a is None or b is None else f(read(a), read(b)) for a, b in zip(s, t)], dtype=object)

        return F.pandas_udf(run, returns)

    def parse(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else G.to_wkb(G.from_wkt(t)) for t in s], dtype=object)

    wkb = lambda f: lambda *g: None if (r := f(*g)) is None else G.to_wkb(r)
    made = {
        "st_area": one(M.area, "double"), "st_length": one(M.length, "double"), "st_isvalid": one(T.is_valid, "boolean", False),
        "st_issimple": one(T.is_simple, "boolean", False), "st_isempty": one(lambda g: g.is_empty, "boolean", False), "st_aswkt": one(G.to_wkt, "string"),
        "st_geometrytype": one(lambda g: g.name, "string"), "st_geomfromwkt": F.pandas_udf(parse, "binary"), "st_distance": two(T.distance, "double"),
        "st_relate": two(T.relate, "string"),
    }
    made |= {f"st_{n.replace('_', '')}": one(wkb(f), "binary") for n, f in {"boundary": M.boundary, "centroid": M.centroid, "convex_hull": M.convex_hull, "envelope": M.envelope, "exteriorring": M.exterior, "pointonsurface": M.representative_point}.items()}
    made |= {f"st_{n.replace('_', '')}": two(_named(n), "boolean", False) for n in PREDICATES}
    made |= {f"st_{n.replace('_', '')}": two(wkb(_op(n)), "binary") for n in T.OPS}
    for name, f in made.items():
        spark.udf.register(name, f)
    spark.udtf.register("st_dump", F.udtf(Dump, returnType="part: int, geometry: binary"))
    return sorted([*made, "st_dump"])
