"""Vector files by row ranges: shapefiles, GeoPackages and GeoJSON, without GDAL.

``read_file`` gives one partition per range of features.  A range is read by the task that needs it:
shapefile records by their index, GeoPackage rows by SQLite, GeoJSON features by their position.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesselon.functions import crs as C
from tesselon.kernels import geometry as G
from tesselon.kernels.measures import ring_area
from tesselon.operators.frame import ROW_ID, GeoFrame


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


# Formats: each gives columns (name, Spark type), number of features, CRS, and rows of a range.

class Shapefile:
    def __init__(self, path: str, layer=None):
        self.base = path[:-4]
        self.fields, self.rows, self.head, self.width = self._dbf()
        prj = f"{self.base}.prj"
        self.crs = "EPSG:4326" if os.path.exists(prj) and "GCS_WGS_1984" in open(prj).read() else None
        kinds = {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType()}
        self.columns = [(n, T.LongType() if k in "NF" and not d and w < 19 else kinds.get(k, T.StringType())) for n, k, w, d in self.fields]

    def _dbf(self):
        with open(f"{self.base}.dbf", "rb") as f:
            h = f.read(32)
            n, size, width = struct.unpack("<IHH", h[4:12])
            fields = []
            for _ in range((size - 33) // 32):
                d = f.read(32)
                fields.append((d[:11].split(b"\0")[0].decode(), chr(d[11]), d[16], d[17]))
        return fields, n, size, width

    def count(self) -> int:
        return self.rows

    def read(self, start: int, stop: int):
        encoding = "utf-8"
        with open(f"{self.base}.dbf", "rb") as db, open(f"{self.base}.shp", "rb") as shp, open(f"{self.base}.shx", "rb") as shx:
            for i in range(start, stop):
                db.seek(self.head + i * self.width + 1)
                rec, at, values = db.read(self.width - 1), 0, []
                for (_, kind, width, _), (_, t) in zip(self.fields, self.columns):
                    raw = rec[at : at + width].decode(encoding, "replace").strip(" \0")
                    at += width
                    if raw == "" or set(raw) == {"*"}:
                        values.append(None)
                    elif kind in "NF":
                        values.append(int(float(raw)) if isinstance(t, T.LongType) else float(raw))
                    else:
                        values.append(raw.upper() in ("T", "Y") if kind == "L" else raw)
                shx.seek(100 + 8 * i)
                offset, size = struct.unpack(">II", shx.read(8))
                shp.seek(2 * offset + 8)
                yield values, self._shape(shp.read(2 * size))

    @staticmethod
    def _shape(b: bytes) -> G.Geom | None:
        (kind,) = struct.unpack_from("<i", b)
        flat = kind % 10
        if kind == 0:
            return None
        if flat == 1:
            c = struct.unpack_from("<2d", b, 4)
            return G.point(*c, *(struct.unpack_from("<d", b, 20) if kind == 11 else ()))
        if flat == 8:
            (n,) = struct.unpack_from("<i", b, 36)
            v = struct.unpack_from(f"<{2 * n}d", b, 40)
            return G.Geom(G.MULTIPOINT, [G.point(x, y) for x, y in zip(v[::2], v[1::2])])
        parts, n = struct.unpack_from("<2i", b, 36)
        starts = [*struct.unpack_from(f"<{parts}i", b, 44), n]
        v = struct.unpack_from(f"<{2 * n}d", b, 44 + 4 * parts)
        paths = [list(zip(v[2 * p : 2 * q : 2], v[2 * p + 1 : 2 * q : 2])) for p, q in zip(starts, starts[1:])]
        if flat == 3:
            return G.collect([G.Geom(G.LINE, p) for p in paths])
        # Clockwise rings are shells; a hole goes to the smallest shell around its first vertex.
        from tesselon.kernels.topology import Member

        shells = sorted((p for p in paths if ring_area(p) < 0), key=lambda p: -ring_area(p))
        polys = [[p] for p in shells or paths[:1]]
        solid = [Member(G.Geom(G.POLYGON, [p[0]])) for p in polys]
        for h in (p for p in paths if ring_area(p) > 0 and shells):
            k = next((k for k, m in enumerate(solid) if m.locate(h[0]) != 2), 0)
            polys[k].append(h)
        return G.collect([G.Geom(G.POLYGON, p) for p in polys])


class GeoPackage:
    def __init__(self, path: str, layer=None):
        self.path = path
        with self._open() as db:
            layers = [r[0] for r in db.execute("select table_name from gpkg_contents where data_type = 'features' order by rowid")]
            self.table = layers[layer] if isinstance(layer, int) else layer or layers[0]
            if self.table not in layers:
                raise ValueError(f"no layer {layer!r}; there are {layers}")
            self.geometry, srs = db.execute("select column_name, srs_id from gpkg_geometry_columns where table_name = ?", (self.table,)).fetchone()
            info = db.execute(f'pragma table_info("{self.table}")').fetchall()
            self.key = next((r[1] for r in info if r[5]), "rowid")
            self.crs = None if srs in (0, -1) else f"EPSG:{srs}"
            self.columns = [(r[1], self._kind(r[2])) for r in info if r[1] not in (self.geometry, self.key)]

    def _open(self):
        import contextlib

        return contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True))

    @staticmethod
    def _kind(name: str):
        n = name.upper().split("(")[0]
        if n in ("INT", "INTEGER", "MEDIUMINT", "SMALLINT", "TINYINT"):
            return T.LongType()
        if n in ("REAL", "DOUBLE", "FLOAT"):
            return T.DoubleType()
        return T.BooleanType() if n == "BOOLEAN" else T.BinaryType() if n == "BLOB" else T.StringType()

    def count(self) -> int:
        with self._open() as db:
            return db.execute(f'select count(*) from "{self.table}"').fetchone()[0]

    def read(self, start: int, stop: int):
        names = ", ".join(f'"{c}"' for c, _ in self.columns)
        with self._open() as db:
            q = f'select "{self.geometry}"{", " + names if names else ""} from "{self.table}" order by "{self.key}" limit ? offset ?'
            for row in db.execute(q, (stop - start, start)):
                values = [bool(v) if isinstance(t, T.BooleanType) and v is not None else v for v, (_, t) in zip(row[1:], self.columns)]
                yield values, None if row[0] is None else self._geometry(row[0])

    @staticmethod
    def _geometry(b: bytes) -> G.Geom:
        envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[b[3] >> 1 & 7]
        return G.from_wkb(b[8 + envelope :])


class GeoJSON:
    def __init__(self, path: str, layer=None):
        self.path = path
        features = self._features()
        self.n = len(features)
        kinds: dict[str, set] = {}
        for f in features:
            for k, v in (f.get("properties") or {}).items():
                kinds.setdefault(k, set()).add(type(v))
        self.columns = [(k, self._kind(t - {type(None)})) for k, t in kinds.items()]
        self.crs = "OGC:CRS84"

    def _features(self) -> list[dict]:
        with open(self.path, encoding="utf-8") as f:
            text = f.read()
        try:
            d = json.loads(text)
        except json.JSONDecodeError:
            d = {"features": [json.loads(line.lstrip("\x1e")) for line in text.splitlines() if line.strip()]}
        return d["features"] if "features" in d else [d if d.get("type") == "Feature" else {"geometry": d, "properties": {}}]

    @staticmethod
    def _kind(types: set):
        if types <= {bool} and types:
            return T.BooleanType()
        if types <= {int} and types:
            return T.LongType()
        return T.DoubleType() if types <= {int, float} and types else T.StringType()

    def count(self) -> int:
        return self.n

    def read(self, start: int, stop: int):
        for f in self._features()[start:stop]:
            p = f.get("properties") or {}
            values = []
            for k, t in self.columns:
                v = p.get(k)
                if v is not None and isinstance(t, T.DoubleType):
                    v = float(v)
                elif v is not None and isinstance(t, T.StringType) and not isinstance(v, str):
                    v = json.dumps(v)
                values.append(v)
            yield values, None if f.get("geometry") is None else G.from_mapping(f["geometry"])


FORMATS = {".shp": Shapefile, ".gpkg": GeoPackage, ".geojson": GeoJSON, ".json": GeoJSON, ".geojsonl": GeoJSON}


def open_file(path: str, layer=None):
    kind = FORMATS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}; known are {', '.join(sorted(FORMATS))}")
    return kind(path, layer)


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.o = {k: json.loads(v) for k, v in options.items() if k in ("file", "layer", "step", "total", "wanted")}

    def partitions(self):
        step, total = self.o["step"], self.o["total"]
        return [Range(i, min(total, i + step)) for i in range(0, max(total, 1), step)]

    def read(self, partition):
        f = open_file(self.o["file"], self.o["layer"])
        names = [c for c, _ in f.columns]
        for i, (values, g) in enumerate(f.read(partition.start, partition.stop), partition.start):
            row = dict(zip(names, values)) | {"geometry": None if g is None else bytearray(G.to_wkb(g)), ROW_ID: i}
            yield tuple(row[c] for c in self.o["wanted"])


class VectorSource(DataSource):
    @classmethod
    def name(cls):
        return "tesselon-vector"

    def schema(self):
        raise NotImplementedError("the schema is given by read_file")

    def reader(self, schema):
        return VectorReader(dict(self.options))


def read_file(spark: SparkSession, path: str, npartitions: int | None = None, chunksize: int | None = None, layer: int | str | None = None, columns: list[str] | None = None, **kw) -> GeoFrame | DataFrame:
    """Features of a vector file in ranges of ``chunksize``, or in ``npartitions`` ranges; ``__row_id`` is their position.

    Without "geometry" among ``columns`` no geometry is read and the result is a plain frame.
    """
    if (npartitions is None) == (chunksize is None):
        raise ValueError("exactly one of npartitions and chunksize must be given")
    if "skip_features" in kw or "max_features" in kw:
        raise ValueError("skip_features and max_features cannot be combined with ranges")
    if kw:
        raise ValueError(f"unknown arguments: {', '.join(kw)}")
    f = open_file(path, layer)
    total = f.count()
    step = max(1, chunksize or math.ceil(total / npartitions))
    known = dict(f.columns) | {"geometry": T.BinaryType(), ROW_ID: T.LongType()}
    wanted = [*(columns if columns is not None else [*dict(f.columns), "geometry"]), ROW_ID]
    if unknown := [c for c in wanted if c not in known]:
        raise ValueError(f"no such columns: {unknown}")
    spark.dataSource.register(VectorSource)
    reader = spark.read.format("tesselon-vector").schema(T.StructType([T.StructField(c, known[c]) for c in wanted]))
    for k, v in (("file", path), ("layer", layer), ("step", step), ("total", total), ("wanted", wanted)):
        reader = reader.option(k, json.dumps(v))
    df = reader.load()
    return GeoFrame.from_df(df, "geometry", f.crs) if "geometry" in wanted else df
