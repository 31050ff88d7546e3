"""Feather (Arrow IPC) files: one partition a file, in natural order of their names."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from tesselon.functions import st
from tesselon.operators.frame import ROW_ID, Files, GeoFrame, box_name, with_geometry
from tesselon.sources import arrowfiles, geometa
from tesselon.sources.geoparquet import _free, dnf, footers


def natural(path: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path)]


def discover(path: str | list[str], storage: dict | None = None) -> list[str]:
    import glob

    import pyarrow.fs as pafs

    out: list[str] = []
    for p in [path] if isinstance(path, str) else path:
        fs, root = arrowfiles.filesystem(p, storage)
        prefix = p[: len(p) - len(root)] if p.endswith(root) else ""
        if "*" in root:
            out += glob.glob(root)
        elif fs.get_file_info(root).type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            out += [prefix + f.path for f in found if f.type == pafs.FileType.File and not re.search(r"/[_.][^/]*$", f.path)]
        elif fs.get_file_info(root).type == pafs.FileType.File:
            out.append(p)
    return sorted(out, key=natural)


def hive_values(path: str) -> dict[str, str]:
    return dict(re.findall(r"/([^/=]+)=([^/]+)(?=/)", path))


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FeatherReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.columns = json.loads(options["files"]), json.loads(options["columns"])
        self.storage = json.loads(options["storage"])

    def partitions(self):
        return [FilePart(f) for f in self.files]

    def read(self, partition):
        import pyarrow as pa

        fs, p = arrowfiles.filesystem(partition.path, self.storage)
        extra = hive_values(partition.path)
        with fs.open_input_file(p) as f:
            reader = pa.ipc.open_file(f)
            for i in range(reader.num_record_batches):
                b = reader.get_batch(i)
                cols = [pa.array([extra[c]] * b.num_rows, pa.string()) if c in extra else b.column(b.schema.get_field_index(c)) for c in self.columns]
                yield pa.RecordBatch.from_arrays(cols, self.columns)


class FeatherSource(DataSource):
    @classmethod
    def name(cls):
        return "tesselon-feather"

    def schema(self):
        return self.options["ddl"]

    def reader(self, schema):
        return FeatherReader(dict(self.options))


def read_feather(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, filters=None, index: str | bool | None = None, storage_options: dict | None = None) -> GeoFrame | DataFrame:
    """A frame over Feather files; only the wanted columns of each file are handed on.

    ``filters`` is a column condition or a list in disjunctive normal form; ``index`` names a column to
    keep as the row identity.  ``storage_options`` are arguments of pyarrow's file system.  Slices, clips
    and joins of the frame leave out files that cannot matter.
    """
    import pyarrow as pa

    if index is False:
        raise NotImplementedError("index=False is not supported")
    files = discover(path, storage_options)
    if not files:
        raise ValueError("No dataset parts discovered")
    fs, p = arrowfiles.filesystem(files[0], storage_options)
    with fs.open_input_file(p) as f:
        schema = pa.ipc.open_file(f).schema
    geo = geometa.read(schema.metadata)
    for k in hive_values(files[0]):
        schema = schema.append(pa.field(k, pa.string()))
    boxes = {box_name(g) for g in geo["columns"]}
    wanted = columns or [c for c in schema.names if c not in boxes]
    unknown = [c for c in wanted if c not in schema.names]
    if unknown:
        raise ValueError(f"the following columns were not found in the dataset: {unknown}")
    used = list(wanted)
    if isinstance(filters, list):
        groups = filters if filters and isinstance(filters[0], list) else [filters]
        used += [t[0] for g in groups for t in g]
    used += [index] if isinstance(index, str) else []
    used += [box_name(g) for g in geo["columns"] if g in wanted and box_name(g) in schema.names]
    used = list(dict.fromkeys(used))
    spark.dataSource.register(FeatherSource)
    arrow = pa.schema([schema.field(c).remove_metadata() for c in used])
    geos = [g for g in geo["columns"] if g in wanted]
    keep = [c for c in used if c in wanted or c in {box_name(g) for g in geos} or c == index]

    def shaped(some: list[str]) -> DataFrame:
        reader = spark.read.format("tesselon-feather").schema(from_arrow_schema(arrow)).option("ddl", "")
        df = reader.option("files", json.dumps(some)).option("columns", json.dumps(used)).option("storage", json.dumps(storage_options or {})).load()
        if filters is not None:
            df = df.filter(dnf(filters) if isinstance(filters, list) else filters)
        df = df.select(*[F.col(f"`{c}`") for c in keep])
        if isinstance(index, str):
            df = df.withColumn(ROW_ID, F.col(f"`{index}`"))
        for g in geos:
            box = F.col(f"`{box_name(g)}`") if box_name(g) in df.columns else st.bbox(g)
            df = with_geometry(df, g, F.col(f"`{g}`"), box, {"crs": geometa.crs_of(geo["columns"][g])})
        return df

    if not geos:
        return shaped(files)
    active = geo["primary_column"] if geo["primary_column"] in geos else geos[0]
    found = {r["path"]: json.loads(r["boxes"]).get(active) for r in footers(spark, files, "feather", storage_options).collect()}

    def frame(some: list[str]) -> GeoFrame:
        if not all(found.values()):
            return GeoFrame(shaped(some), active)
        boxes = [(f, tuple(map(float, found[f]))) for f in some]
        extents = spark.createDataFrame([(i, f, *b) for i, (f, b) in enumerate(boxes)], "partition_id int, path string, xmin double, ymin double, xmax double, ymax double")
        return GeoFrame(shaped(some), active, extents, Files(tuple(boxes), frame))

    return frame(files)


def to_feather(frame: GeoFrame, path: str, write_index: bool = True, mode: str = "error", compute: bool = True, storage_options: dict | None = None):
    """``part.<i>.feather`` for each partition.  ``compute=False`` gives a function that does the writing."""
    df = frame.df if write_index or ROW_ID not in frame.df.columns else frame.df.drop(ROW_ID)

    def run():
        _free(path, mode, storage_options)
        arrowfiles.write(df, path, geometa.describe(frame, covering=False), "feather", mode, storage=storage_options)

    return run() if compute else run
