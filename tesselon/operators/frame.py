"""GeoFrame: a Spark DataFrame with an active geometry column.

A geometry column ``g`` is WKB; ``g__bbox`` beside it holds its box, null for null and empty values.
CRS, known types and the active flag are field metadata.  Frames are immutable; every method returns
a new one.  Measures come as Spark columns, to be selected; constructions as frames.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import crs as C
from tesselon.functions import curves, st
from tesselon.kernels import geometry as G

ROW_ID = "__row_id"
BOX = ("xmin", "ymin", "xmax", "ymax")
#: Boxes beyond this number are taken together when files are looked for.
MANY_BOXES = 256


def box_name(geometry: str) -> str:
    return f"{geometry}__bbox"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _box_of(built: Column) -> Column:
    return F.when(built["xmin"].isNotNull(), F.struct(*[built[k].alias(k) for k in BOX]))


def geometry_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if "geo" in f.metadata]


def with_geometry(df: DataFrame, name: str, wkb: Column, box: Column, meta: dict) -> DataFrame:
    """Adds or replaces a geometry column, its companion and its metadata."""
    df = df.withColumns({name: wkb, box_name(name): box})
    return df.withMetadata(name, {"geo": {k: v for k, v in meta.items() if v is not None}})


@dataclass(frozen=True)
class Files:
    """The files a frame is read from, each with its box, and how to read some of them in the same way."""

    boxes: tuple[tuple[str, tuple[float, float, float, float]], ...]
    read: Callable[[list[str]], GeoFrame]


class GeoFrame:
    def __init__(self, df: DataFrame, geometry: str = "geometry", extents: DataFrame | None = None, files: Files | None = None):
        if geometry not in df.columns or box_name(geometry) not in df.columns:
            raise ValueError(f"{geometry!r} is not a geometry column; use from_df or set_geometry")
        self.df, self.name, self.extents, self.files = df, geometry, extents, files

    def within_reach(self, boxes: Iterable[tuple[float, float, float, float]]) -> GeoFrame:
        """The frame without the files whose box meets none of ``boxes``; frames not freshly read stay as they are."""
        if self.files is None:
            return self
        boxes = list(boxes)
        if len(boxes) > MANY_BOXES:
            boxes = [(min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))]
        meets = lambda p: any(p[0] <= b[2] and b[0] <= p[2] and p[1] <= b[3] and b[1] <= p[3] for b in boxes)
        kept = [path for path, box in self.files.boxes if meets(box)]
        if len(kept) == len(self.files.boxes):
            return self
        return self.files.read(kept) if kept else GeoFrame(self.df.filter(F.lit(False)), self.name)

    # Construction

    @classmethod
    def from_df(cls, df: DataFrame, geometry: str | Column = "geometry", crs=None, name: str = "geometry") -> GeoFrame:
        """Promotes a plain frame whose column, or the given expression, holds WKB."""
        if isinstance(geometry, Column):
            df, geometry = df.withColumn(name, geometry), name
        old = _meta(df, geometry)
        return cls._built(df, geometry, st.normalize(_q(geometry)), {"crs": C.name_of(crs) or old.get("crs")})

    @classmethod
    def _built(cls, df: DataFrame, name: str, built: Column, meta: dict) -> GeoFrame:
        keep = [c for c in df.columns if c not in (name, box_name(name), "_built")]
        d = df.withColumn("_built", built)
        b = F.col("_built")
        order = [c for c in df.columns if c not in (box_name(name), "_built")] + ([name] if name not in df.columns else [])
        d = with_geometry(d.select(*[_q(c) for c in keep], "_built"), name, b["wkb"], _box_of(b), meta)
        return cls(d.select(*[_q(c) for c in order], _q(box_name(name))), name)

    @classmethod
    def from_local(cls, spark: SparkSession, rows, geometry: str = "geometry", crs=None, npartitions: int | None = None, chunksize: int | None = None) -> GeoFrame:
        """From a pandas frame, an Arrow table or a list of dicts whose geometries are WKB, hex, WKT, mappings or geo-interface objects."""
        import math

        import pandas as pd

        pdf = rows.to_pandas() if hasattr(rows, "to_pandas") else rows.copy() if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows)
        if (npartitions is None) == (chunksize is None) and npartitions is not None:
            raise ValueError("give npartitions or chunksize, not both")
        crs = crs or getattr(pdf, "crs", None)
        pdf[geometry] = [None if g is None else bytearray(G.to_wkb(G.as_geom(g))) for g in pdf[geometry]]
        pdf = pd.DataFrame(pdf).astype({geometry: object})
        n = npartitions or (math.ceil(len(pdf) / chunksize) if chunksize else None)
        df = _local_frame(spark, pdf, geometry)
        return cls.from_df(df.repartition(n) if n else df, geometry, crs)

    def _on(self, df: DataFrame, keep_extents: bool = False) -> GeoFrame | DataFrame:
        """The same geometry over another frame, or a plain frame when the geometry is gone."""
        if self.name not in df.columns:
            return df
        return GeoFrame(df, self.name, self.extents if keep_extents else None)

    # Geometry, CRS

    @property
    def geometry(self) -> Column:
        return _q(self.name)

    @property
    def bbox(self) -> Column:
        return _q(box_name(self.name))

    @property
    def meta(self) -> dict:
        return _meta(self.df, self.name)

    @property
    def crs(self) -> str | None:
        return self.meta.get("crs")

    def _with_meta(self, **changes) -> GeoFrame:
        meta = {k: v for k, v in (self.meta | changes).items() if v is not None}
        return GeoFrame(self.df.withMetadata(self.name, {"geo": meta}), self.name, self.extents)

    def set_crs(self, crs=None, allow_override: bool = False, epsg: int | None = None) -> GeoFrame:
        """Labels the coordinates; they stay as they are."""
        new = C.name_of(epsg if crs is None else crs)
        if self.crs is not None and not allow_override and not C.same(self.crs, new):
            raise ValueError("the geometry already has a CRS which is not equal to the passed CRS; pass allow_override=True to replace it")
        return self._with_meta(crs=new)

    def to_crs(self, crs=None, epsg: int | None = None) -> GeoFrame:
        """Transforms the coordinates."""
        target = C.name_of(epsg if crs is None else crs)
        source = self.crs
        if source is None:
            raise ValueError("a geometry without CRS cannot be transformed; set_crs first")
        if C.same(source, target):
            return self._with_meta(crs=target)
        C.transformer(source, target)
        return GeoFrame._built(self.df, self.name, st.builder(C.transform)(self.geometry, source=source, target=target), self.meta | {"crs": target})

    def set_geometry(self, col: str | Column, crs=None, name: str | None = None) -> GeoFrame:
        if isinstance(col, Column):
            return GeoFrame.from_df(self.df, col, crs or self.crs, name or self.name)
        if box_name(col) in self.df.columns and "geo" in self.df.schema[col].metadata:
            out = GeoFrame(self.df, col)
            return out if crs is None else out.set_crs(crs)
        return GeoFrame.from_df(self.df, col, crs)

    def rename_geometry(self, col: str) -> GeoFrame:
        if col in self.df.columns:
            raise ValueError(f"Column named {col} already exists")
        df = self.df.withColumnsRenamed({self.name: col, box_name(self.name): box_name(col)})
        return GeoFrame(df.withMetadata(col, {"geo": self.meta}), col, self.extents)

    # Columns and rows

    @property
    def columns(self) -> list[str]:
        boxes = {box_name(g) for g in geometry_columns(self.df)}
        return [c for c in self.df.columns if c not in boxes]

    def __getitem__(self, key):
        if isinstance(key, Column):
            return self.filter(key)
        if isinstance(key, str):
            return self.df[key]
        return self.select(*key)

    def select(self, *cols: str) -> GeoFrame | DataFrame:
        boxes = [box_name(c) for c in cols if box_name(c) in self.df.columns]
        return self._on(self.df.select(*[_q(c) for c in [*cols, *boxes]]), True)

    def filter(self, condition: Column | str) -> GeoFrame:
        return self._on(self.df.filter(condition), True)

    def drop(self, labels=None, axis: int | str = 0, columns=None, errors: str = "raise") -> GeoFrame | DataFrame:
        if columns is None and labels is None:
            raise TypeError("labels or columns must be given")
        if columns is None:
            if axis not in (0, 1, "index", "columns"):
                raise ValueError(f"No axis named {axis}")
            if axis in (0, "index"):
                raise NotImplementedError("rows are dropped by filter")
            columns = labels
        columns = [columns] if isinstance(columns, str) else list(columns)
        missing = [c for c in columns if c not in self.df.columns]
        if missing and errors == "raise":
            raise KeyError(f"{missing} not found")
        gone = columns + [box_name(c) for c in columns]
        return self._on(self.df.drop(*[c for c in gone if c in self.df.columns]), True)

    def assign(self, **cols: Column) -> GeoFrame:
        return self._on(self.df.withColumns(cols), self.name not in cols)

    def rename(self, columns: dict[str, str]) -> GeoFrame:
        plain = {k: v for k, v in columns.items() if k != self.name}
        out = GeoFrame(self.df.withColumnsRenamed(plain), self.name, self.extents)
        return out.rename_geometry(columns[self.name]) if self.name in columns else out

    def astype(self, kinds: dict[str, str]) -> GeoFrame:
        return self._on(self.df.withColumns({c: _q(c).cast(k) for c, k in kinds.items()}), True)

    def map_partitions(self, f: Callable, schema) -> DataFrame:
        """Applies a function on iterators of pandas frames; the result is a plain frame."""
        return self.df.mapInPandas(f, schema)

    def apply(self, f: Callable, returns: str) -> Column:
        """A column from a Python function of each geometry, given as a kernel value."""
        return st.scalar(f, returns)(self.geometry)

    def isna(self) -> Column:
        return self.geometry.isNull()

    def fillna(self, value) -> GeoFrame:
        g = G.as_geom(value)
        b = g.bounds()
        box = F.lit(None).cast(st.BBOX) if b is None else F.struct(*[F.lit(v).alias(k) for k, v in zip(BOX, b)])
        wkb = F.coalesce(self.geometry, st.literal(g))
        return GeoFrame(with_geometry(self.df, self.name, wkb, F.when(self.isna(), box).otherwise(self.bbox), self.meta), self.name)

    def with_row_id(self) -> GeoFrame:
        """An explicit identity for each row, where index semantics are wanted; persist or write before relying on it."""
        return self._on(self.df.withColumn(ROW_ID, F.monotonically_increasing_id()), True)

    @property
    def npartitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def partition(self, i: int) -> GeoFrame:
        return self._on(self.df.filter(F.spark_partition_id() == i), True)

    def repartition(self, *args) -> GeoFrame:
        return self._on(self.df.repartition(*args))

    def __len__(self) -> int:
        return self.df.count()

    def head(self, n: int = 5) -> list:
        return self.df.limit(n).collect()

    @property
    def sindex(self):
        raise NotImplementedError("a partitioned frame has no single spatial index")

    def persist(self) -> GeoFrame:
        return GeoFrame(self.df.persist(), self.name, self.extents)

    def copy(self) -> GeoFrame:
        return self

    def compute(self):
        """All rows as a pandas frame on the driver, without the box companions."""
        return self.df.select(*[_q(c) for c in self.columns]).toPandas()

    def to_df(self) -> DataFrame:
        """A plain frame, the WKB column kept as data."""
        return self.df.select(*[_q(c).alias(c, metadata={}) if c == self.name else _q(c) for c in self.columns])

    def __repr__(self) -> str:
        return f"GeoFrame[{', '.join(self.columns)}; geometry={self.name}, crs={self.crs}]"

    def _repr_html_(self) -> str:
        """Columns and their types, without running anything."""
        from html import escape

        kinds = dict(self.df.dtypes)
        rows = "".join(f"<tr><td>{escape(c)}</td><td>{'geometry' if c in geometry_columns(self.df) else escape(kinds[c])}</td></tr>" for c in self.columns)
        return f"<table><caption>GeoFrame, geometry {escape(self.name)}, CRS {escape(str(self.crs))}</caption><tr><th>column</th><th>type</th></tr>{rows}</table>"

    # Measures: columns

    area = property(lambda self: st.area(self.geometry))
    length = property(lambda self: st.length(self.geometry))
    is_valid = property(lambda self: st.is_valid(self.geometry))
    is_simple = property(lambda self: st.is_simple(self.geometry))
    is_ring = property(lambda self: st.is_ring(self.geometry))
    is_empty = property(lambda self: self.geometry.isNotNull() & self.bbox.isNull())
    has_z = property(lambda self: st.has_z(self.geometry))
    geom_type = property(lambda self: st.geom_type(self.geometry))
    type = geom_type
    interiors = property(lambda self: st.interiors(self.geometry))
    z = property(lambda self: st.z(self.geometry))

    def _ordinate(self, k: str) -> Column:
        wrong = self.geometry.isNotNull() & ~st.is_point(self.geometry)
        return F.when(wrong, F.raise_error(F.lit("x, y and z are given for points only")).cast("double")).otherwise(self.bbox[k])

    x = property(lambda self: self._ordinate("xmin"))
    y = property(lambda self: self._ordinate("ymin"))

    @property
    def bounds(self) -> list[Column]:
        """minx, miny, maxx, maxy; NaN for empty geometries."""
        nan = F.lit(float("nan"))
        return [F.when(self.geometry.isNotNull(), F.coalesce(self.bbox[k], nan)).alias(n) for k, n in zip(BOX, ("minx", "miny", "maxx", "maxy"))]

    def total_bounds(self) -> DataFrame:
        b, nan = self.bbox, F.lit(float("nan"))
        lo = [F.coalesce(F.min(b[k]), nan).alias(n) for k, n in (("xmin", "xmin"), ("ymin", "ymin"))]
        return self.df.agg(*lo, *[F.coalesce(F.max(b[k]), nan).alias(k) for k in ("xmax", "ymax")])

    # Constructions: frames

    def _construct(self, built: Column, **meta) -> GeoFrame:
        return GeoFrame._built(self.df, self.name, built, {"crs": self.crs} | meta)

    boundary = property(lambda self: self._construct(st.boundary(self.geometry)))
    centroid = property(lambda self: self._construct(st.centroid(self.geometry), types=["Point"]))
    convex_hull = property(lambda self: self._construct(st.convex_hull(self.geometry)))
    envelope = property(lambda self: self._construct(st.envelope(self.geometry)))
    exterior = property(lambda self: self._construct(st.exterior(self.geometry)))

    def representative_point(self) -> GeoFrame:
        return self._construct(st.representative_point(self.geometry), types=["Point"])

    def buffer(self, distance: float, resolution: int = 16, **kw) -> GeoFrame:
        return self._construct(st.buffer(self.geometry, distance=distance, resolution=resolution, **kw))

    def simplify(self, tolerance: float, preserve_topology: bool = True) -> GeoFrame:
        return self._construct(st.simplify(self.geometry, tolerance=tolerance, preserve_topology=preserve_topology))

    def interpolate(self, distance: float, normalized: bool = False) -> GeoFrame:
        return self._construct(st.interpolate(self.geometry, distance=distance, normalized=normalized), types=["Point"])

    def affine_transform(self, matrix) -> GeoFrame:
        return self._construct(st.affine_transform(self.geometry, matrix=list(matrix)))

    def translate(self, xoff=0.0, yoff=0.0, zoff=0.0) -> GeoFrame:
        return self._construct(st.translate(self.geometry, xoff=xoff, yoff=yoff, zoff=zoff), types=self.meta.get("types"))

    def rotate(self, angle, origin="center", use_radians=False) -> GeoFrame:
        return self._construct(st.rotate(self.geometry, angle=angle, origin=origin, use_radians=use_radians))

    def scale(self, xfact=1.0, yfact=1.0, zfact=1.0, origin="center") -> GeoFrame:
        return self._construct(st.scale(self.geometry, xfact=xfact, yfact=yfact, zfact=zfact, origin=origin))

    def skew(self, xs=0.0, ys=0.0, origin="center", use_radians=False) -> GeoFrame:
        return self._construct(st.skew(self.geometry, xs=xs, ys=ys, origin=origin, use_radians=use_radians))

    def explode(self, column: str | None = None, ignore_index: bool = False, index_parts: bool = False) -> GeoFrame:
        """One row per part of multi-part geometries; another column than a geometry is exploded as an array."""
        name = column or self.name
        if "geo" not in self.df.schema[name].metadata:
            return self._on(self.df.withColumn(name, F.explode(_q(name))), True)
        meta = _meta(self.df, name)
        d = self.df.withColumn("_parts", st.parts(_q(name))).drop(box_name(name))
        d = d.select(*[_q(c) for c in d.columns if c not in (name, "_parts")], F.posexplode_outer("_parts").alias("_pos", name))
        if index_parts:
            d = d.withColumnRenamed("_pos", "index_parts")
        elif ignore_index:
            d = d.drop("_pos").withColumn("index", F.monotonically_increasing_id())
        else:
            d = d.drop("_pos")
        out = GeoFrame._built(d, name, st.normalize(_q(name)), meta | {"types": None})
        return out if name == self.name else GeoFrame(out.df, self.name)

    # Two geometries

    def _other(self, other) -> tuple[Column, Column | None]:
        """WKB and box of a constant, or of another column of this frame."""
        if isinstance(other, Column):
            return other, None
        if isinstance(other, str) and other in self.df.columns:
            return _q(other), _q(box_name(other)) if box_name(other) in self.df.columns else None
        g = G.as_geom(other)
        b = g.bounds()
        return st.literal(g), None if b is None else F.struct(*[F.lit(v).alias(k) for k, v in zip(BOX, b)])

    def _predicate(self, name: str, other) -> Column:
        if not isinstance(other, Column) and not (isinstance(other, str) and other in self.df.columns):
            fast = self._point_in_box(name, G.as_geom(other))
            if fast is not None:
                return F.coalesce(fast, F.lit(False))
        wkb, box = self._other(other)
        exact = st.predicates[name](self.geometry, wkb)
        if box is None:
            return exact
        if isinstance(other, str) and other in self.df.columns:
            # Two empty values have no boxes and may still be equal.
            near = F.coalesce(box_condition(name, self.bbox, box), F.lit(True))
            return ~near | exact if name == "disjoint" else near & exact
        b = G.as_geom(other).bounds()
        near = box_condition(name, self.bbox, dict(zip(BOX, map(F.lit, b))))
        # As conjuncts on the companion these reach the files' statistics; a missing box makes the exact test false as well.
        return F.coalesce(~near, F.lit(False)) | exact if name == "disjoint" else near & exact

    def _point_in_box(self, name: str, g: G.Geom) -> Column | None:
        """For columns known to hold points and a constant box the comparison is arithmetic on the companion."""
        if self.meta.get("types") != ["Point"] or not is_box(g):
            return None
        return box_predicate(name, self.bbox, True, F.struct(*[F.lit(v).alias(k) for k, v in zip(BOX, g.bounds())]), False)

    def geom_equals_exact(self, other, tolerance: float) -> Column:
        return st.equals_exact(self.geometry, self._other(other)[0], tolerance=tolerance)

    def distance(self, other) -> Column:
        wkb, box = self._other(other)
        constant = not isinstance(other, Column) and not (isinstance(other, str) and other in self.df.columns)
        if self.meta.get("types") == ["Point"] and constant and G.as_geom(other).kind == G.POINT and box is not None:
            return F.hypot(self.bbox["xmin"] - box["xmin"], self.bbox["ymin"] - box["ymin"])
        return st.distance(self.geometry, wkb)

    def relate(self, other) -> Column:
        return st.relate(self.geometry, self._other(other)[0])

    def project(self, other, normalized: bool = False) -> Column:
        return st.project(self.geometry, self._other(other)[0], normalized=normalized)

    def _overlay(self, op: str, other) -> GeoFrame:
        return self._construct(st.overlays[op](self.geometry, self._other(other)[0]))

    def difference(self, other) -> GeoFrame:
        return self._overlay("difference", other)

    def intersection(self, other) -> GeoFrame:
        return self._overlay("intersection", other)

    def union(self, other) -> GeoFrame:
        return self._overlay("union", other)

    def symmetric_difference(self, other) -> GeoFrame:
        return self._overlay("symmetric_difference", other)

    def equal_to(self, other) -> Column:
        """Structural equality: the same canonical WKB."""
        return F.coalesce(self.geometry == self._other(other)[0], F.lit(False))

    def align(self, other: GeoFrame, on: str = ROW_ID, suffix: str = "_other") -> GeoFrame:
        """Rows of both frames side by side by an explicit key; a missing side is null."""
        right = other.df.select(_q(on), *[_q(c).alias(_suffixed(c, suffix)) for c in other.df.columns if c != on])
        return GeoFrame(self.df.join(right, on, "full_outer"), self.name)

    # Output forms

    def to_wkt(self, rounding_precision: int = 6, trim: bool = True) -> DataFrame:
        return self._forms(lambda c: st.wkt(c, rounding_precision=rounding_precision, trim=trim))

    def to_wkb(self, hex: bool = False) -> DataFrame:  # noqa: A002
        return self._forms(lambda c: F.lower(F.hex(c)) if hex else c)

    def _forms(self, f) -> DataFrame:
        geos = set(geometry_columns(self.df))
        return self.df.select(*[f(_q(c)).alias(c, metadata={}) if c in geos else _q(c) for c in self.columns])

    # Bounding boxes, clipping, joining, aggregating: see the modules

    @property
    def cx(self):
        from tesselon.operators.select import BoxIndexer

        return BoxIndexer(self)

    def clip(self, mask, keep_geom_type: bool = False) -> GeoFrame:
        from tesselon.operators.select import clip

        return clip(self, mask, keep_geom_type)

    def sjoin(self, other: GeoFrame, how: str = "inner", predicate: str = "intersects", **kw) -> GeoFrame:
        from tesselon.operators.sjoin import sjoin

        return sjoin(self, other, how, predicate, **kw)

    def dissolve(self, by=None, aggfunc="first", **kw) -> GeoFrame:
        from tesselon.operators.aggregate import dissolve

        return dissolve(self, by, aggfunc, **kw)

    def union_all(self) -> DataFrame:
        from tesselon.operators.aggregate import union_all

        return union_all(self)

    def unary_union(self) -> DataFrame:
        warnings.warn("unary_union is deprecated; use union_all", FutureWarning, stacklevel=2)
        return self.union_all()

    # Curves and partitions

    def _curve(self, f, bounds, level: int, name: str) -> GeoFrame:
        curves.check_level(level)
        if bounds is None:
            r = self.total_bounds().first()
            bounds = tuple(r)
        return self._on(f(self.df, box_name(self.name), tuple(map(float, bounds)), level, name), True)

    def hilbert_distance(self, total_bounds=None, level: int = 16, name: str = "hilbert_distance") -> GeoFrame:
        """The frame with its positions on the Hilbert curve."""
        return self._curve(curves.with_hilbert, total_bounds, level, name)

    def morton_distance(self, total_bounds=None, level: int = 16, name: str = "morton_distance") -> GeoFrame:
        return self._curve(curves.with_morton, total_bounds, level, name)

    def geohash(self, as_string: bool = True, precision: int = 12, name: str = "geohash") -> GeoFrame:
        return self._on(curves.with_geohash(self.df, box_name(self.name), as_string, precision, name), True)

    def spatial_shuffle(self, by: str = "hilbert", level: int | None = None, calculate_partitions: bool = True, npartitions: int | None = None, divisions=None) -> GeoFrame:
        from tesselon.operators.partition import spatial_shuffle

        return spatial_shuffle(self, by, level, calculate_partitions, npartitions, divisions)

    def set_index(self, col: str, npartitions: int | None = None, divisions=None, sorted: bool = False) -> GeoFrame:  # noqa: A002
        from tesselon.operators.partition import range_partition

        return range_partition(self, col, npartitions, divisions, sorted)

    def calculate_spatial_partitions(self, hull: bool = False) -> GeoFrame:
        from tesselon.operators.partition import partition_extents

        return GeoFrame(self.df, self.name, partition_extents(self, hull))

    @property
    def spatial_partitions(self) -> DataFrame | None:
        return self.extents

    def with_spatial_partitions(self, extents: DataFrame) -> GeoFrame:
        """Attaches extents by partition, one row each."""
        if not isinstance(extents, DataFrame) or "partition_id" not in extents.columns:
            raise TypeError("extents must be a frame with partition_id and a box")
        if extents.count() != self.npartitions:
            raise ValueError("extents must have one row per partition")
        return GeoFrame(self.df, self.name, extents)

    # Files

    def to_parquet(self, path: str, **kw) -> None:
        from tesselon.sources.geoparquet import to_parquet

        to_parquet(self, path, **kw)

    def to_feather(self, path: str, **kw):
        from tesselon.sources.geofeather import to_feather

        return to_feather(self, path, **kw)


    @property
    def series(self) -> GeoSeries:
        """The active geometry column alone, with the row id where there is one."""
        keep = [self.name, box_name(self.name), *([ROW_ID] if ROW_ID in self.df.columns else [])]
        return GeoSeries(self.df.select(*[_q(c) for c in keep]), self.name, self.extents)


class GeoSeries(GeoFrame):
    """A frame of one geometry column.  Methods that keep the column give series, others what frames give."""

    def _on(self, df: DataFrame, keep_extents: bool = False):
        out = super()._on(df, keep_extents)
        return out.series if isinstance(out, GeoFrame) and set(out.columns) <= {self.name, ROW_ID} else out

    def _construct(self, built: Column, **meta) -> GeoSeries:
        return super()._construct(built, **meta).series

    def to_frame(self, name: str | None = None) -> GeoFrame:
        out = GeoFrame(self.df, self.name, self.extents)
        return out.rename_geometry(name) if name and name != self.name else out


def _predicate_method(name: str):
    def method(self, other) -> Column:
        return self._predicate(name, other)

    method.__name__, method.__doc__ = name, f"Whether each geometry's relation to the other is {name!r}; a missing side gives false."
    return method


for _n in st.PREDICATES:
    setattr(GeoFrame, _n, _predicate_method(_n))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may leave it unset and gets one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="tesselon-")


def fixed(df: DataFrame) -> DataFrame:
    """The rows as they are now, checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def is_box(g: G.Geom) -> bool:
    if g.kind != G.POLYGON or len(g.data) != 1 or len(g.data[0]) != 5:
        return False
    b = g.bounds()
    return b[0] < b[2] and b[1] < b[3] and {c[:2] for c in g.data[0]} == {(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])} and all(
        (p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(g.data[0], g.data[0][1:])
    )


def box_condition(predicate: str, a: Column, b: Column) -> Column:
    """What the boxes of two non-empty geometries must satisfy for a relation other than disjoint."""
    inside = lambda p, q: (q["xmin"] <= p["xmin"]) & (p["xmax"] <= q["xmax"]) & (q["ymin"] <= p["ymin"]) & (p["ymax"] <= q["ymax"])
    if predicate in ("within", "covered_by"):
        return inside(a, b)
    if predicate in ("contains", "covers", "contains_properly"):
        return inside(b, a)
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_predicate(name: str, a: Column, a_point: bool, b: Column, b_point: bool) -> Column | None:
    """A relation of points and axis-parallel boxes with area as arithmetic on their bounds; None where it is not one."""
    meet = (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    inner = (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])
    a_in_b = (b["xmin"] <= a["xmin"]) & (a["xmax"] <= b["xmax"]) & (b["ymin"] <= a["ymin"]) & (a["ymax"] <= b["ymax"])
    b_in_a = (a["xmin"] <= b["xmin"]) & (b["xmax"] <= a["xmax"]) & (a["ymin"] <= b["ymin"]) & (b["ymax"] <= a["ymax"])
    mixed, points = a_point != b_point, a_point and b_point
    no = F.lit(False) & meet
    return {
        "intersects": meet,
        "disjoint": ~meet,
        "within": (a_in_b & inner) if mixed and a_point else no if mixed else a_in_b,
        "contains": (b_in_a & inner) if mixed and b_point else no if mixed else b_in_a,
        "covered_by": a_in_b,
        "covers": b_in_a,
        "touches": no if points else meet & ~inner,
        "overlaps": no if mixed or points else inner & ~a_in_b & ~b_in_a,
        "crosses": no,
        "geom_equals": no if mixed else a_in_b & b_in_a,
    }.get(name)


def _meta(df: DataFrame, name: str) -> dict:
    return dict(df.schema[name].metadata.get("geo", {})) if name in df.columns else {}


def _suffixed(c: str, suffix: str) -> str:
    return box_name(c[: -len("__bbox")] + suffix) if c.endswith("__bbox") else c + suffix


def _local_frame(spark: SparkSession, pdf, geometry: str) -> DataFrame:
    import pyarrow as pa

    rest = pa.Table.from_pandas(pdf.drop(columns=[geometry]), preserve_index=False)
    wkb = pa.array([None if g is None else bytes(g) for g in pdf[geometry]], pa.binary())
    return spark.createDataFrame(rest.append_column(geometry, wkb))


# Frames from columns

from_df = GeoFrame.from_df
from_local = GeoFrame.from_local


def points_from_xy(df: DataFrame, x: str = "x", y: str = "y", z: str | None = None, crs=None, name: str = "geometry") -> GeoFrame:
    """Points from numeric columns; their box is the coordinates themselves, without a pass over Python."""
    cx, cy = _q(x).cast("double"), _q(y).cast("double")
    box = F.when(cx.isNotNull() & cy.isNotNull(), F.struct(cx.alias("xmin"), cy.alias("ymin"), cx.alias("xmax"), cy.alias("ymax")))
    wkb = st.points(cx, cy, None if z is None else _q(z))
    return GeoFrame(with_geometry(df, name, wkb, box, {"crs": C.name_of(crs), "types": ["Point"]}), name)


def boxes_from_bounds(df: DataFrame, xmin: str, ymin: str, xmax: str, ymax: str, crs=None, name: str = "geometry") -> GeoFrame:
    """Axis-parallel boxes with area from numeric columns."""
    v = [_q(c).cast("double") for c in (xmin, ymin, xmax, ymax)]
    full = reduce(lambda a, b: a & b, [c.isNotNull() for c in v])
    box = F.when(full, F.struct(*[c.alias(k) for c, k in zip(v, BOX)]))
    return GeoFrame(with_geometry(df, name, st.boxes(*v), box, {"crs": C.name_of(crs), "types": ["Box"]}), name)


def from_wkt(df: DataFrame, column: str, crs=None, name: str = "geometry") -> GeoFrame:
    return GeoFrame._built(df, name, st.from_wkt(_q(column)), {"crs": C.name_of(crs)})


def from_wkb(df: DataFrame, column: str, crs=None, name: str = "geometry") -> GeoFrame:
    """From bytes, or from hex text where the column is a string."""
    c = F.unhex(_q(column)) if dict(df.dtypes)[column] == "string" else _q(column)
    return GeoFrame._built(df, name, st.normalize(c), {"crs": C.name_of(crs)})


def concat(frames: Iterable[GeoFrame]) -> GeoFrame:
    frames = list(frames)
    return GeoFrame(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df for f in frames]), frames[0].name)
