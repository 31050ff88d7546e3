"""GeoParquet.  Rows are read by Spark's own reader, footers by a distributed job that opens each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import st
from tesselon.operators.frame import Files, GeoFrame, box_name, with_geometry
from tesselon.sources import arrowfiles, geometa


def footers(spark: SparkSession, files: list[str], kind: str = "parquet", storage: dict | None = None) -> DataFrame:
    """path, the ``geo`` text (of the first file only; null where a file has none, empty for the others) and the boxes by column as JSON; read on the executors."""
    first = files[0]

    def run(batches):
        import json

        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                fs, p = arrowfiles.filesystem(path, storage)
                with fs.open_input_file(p) as f:
                    meta = pq.read_metadata(f).metadata if kind == "parquet" else pa.ipc.open_file(f).schema.metadata
                geo = (meta or {}).get(b"geo", b"").decode() or None
                # A file's text may hold a long description of its CRS; of the others only the boxes go to the driver.
                boxes = {g: geometa.box_of(c) for g, c in json.loads(geo)["columns"].items()} if geo else {}
                rows.append((path, geo if geo is None or path == first else "", json.dumps(boxes)))
            yield pd.DataFrame(rows, columns=["path", "geo", "boxes"])

    n = max(1, min(len(files), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(n).mapInPandas(run, "path string, geo string, boxes string")


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, filters=None, geometry: str | None = None, gather_spatial_partitions: bool = True, **options) -> GeoFrame | DataFrame:
    """A frame over GeoParquet files, with a table of the files' boxes where every file has one.

    ``columns`` selects (without geometry columns the result is a plain frame), ``filters`` is a column
    condition or a list in disjunctive normal form.  Hive partitions are found by Spark.  The driver
    holds the box of each file; slices, clips and joins of the frame leave out files that cannot matter.
    """
    import json

    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.options(**options).parquet(*paths)
    files = sorted(raw.inputFiles())
    if not files:
        raise ValueError("No dataset parts discovered")
    listed = footers(spark, files if gather_spatial_partitions else files[:1]).collect()
    if any(r["geo"] is None for r in listed):
        raise ValueError("Missing geo metadata: a file has no 'geo' key")
    geo = json.loads(next(r["geo"] for r in listed if r["geo"]))
    geos = [g for g in geo["columns"] if g in raw.columns]
    wanted = columns or [c for c in raw.columns if not any(c == box_name(g) for g in geos)]
    active = geometry or geo["primary_column"]
    if active not in wanted:
        active = next((g for g in geos if g in wanted), None)

    def shaped(df: DataFrame) -> DataFrame:
        if filters is not None:
            df = df.filter(dnf(filters) if isinstance(filters, list) else filters)
        have = [c for g in geos if g in wanted for c in (g, box_name(g)) if c in df.columns]
        df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*wanted, *have])])
        for g in geos:
            if g in wanted:
                box = F.col(f"`{box_name(g)}`") if box_name(g) in df.columns else st.bbox(g)
                df = with_geometry(df, g, F.col(f"`{g}`"), box, {"crs": geometa.crs_of(geo["columns"][g])})
        return df

    if active is None:
        return shaped(raw)
    boxes = {r["path"]: json.loads(r["boxes"]).get(active) for r in sorted(listed, key=lambda r: r["path"])} if gather_spatial_partitions else {}
    boxes = {p: tuple(map(float, b)) for p, b in boxes.items() if b} if all(boxes.values()) else {}

    def frame(some: list[str] | None) -> GeoFrame:
        """All files, or some of them; hive columns come from the folders below the path that was given."""
        base = {"basePath": paths[0]} if len(paths) == 1 and not any(c in paths[0] for c in "*?[{") and not paths[0].endswith(".parquet") else {}
        df = shaped(raw if some is None else spark.read.options(**options, **base).schema(raw.schema).parquet(*some))
        held = {p: boxes[p] for p in some or boxes if p in boxes}
        if not held:
            return GeoFrame(df, active)
        extents = spark.createDataFrame([(i, p, *b) for i, (p, b) in enumerate(held.items())], "partition_id int, path string, xmin double, ymin double, xmax double, ymax double")
        return GeoFrame(df, active, extents, Files(tuple(held.items()), frame))

    return frame(None)


def to_parquet(frame: GeoFrame, path: str, mode: str = "error", partition_on: str | list[str] | None = None, native: bool = False, storage_options: dict | None = None) -> None:
    """One file a partition, with ``geo`` metadata, file boxes and a covering of each row's box.

    ``partition_on`` writes hive folders; a task opens one file for each value it holds.  ``native`` uses Spark's writer,
    which is faster and cannot add the metadata.  ``storage_options`` are arguments of pyarrow's file system.
    """
    if native:
        frame.df.write.mode(mode).parquet(path)
        return
    _free(path, mode, storage_options)
    geo = geometa.describe(frame)
    by = [partition_on] if isinstance(partition_on, str) else list(partition_on or [])
    arrowfiles.write(frame.df, path, geo, "parquet", mode, by, storage_options)


def _free(path: str, mode: str, storage: dict | None = None) -> None:
    import pyarrow.fs as pafs

    fs, root = arrowfiles.filesystem(path, storage)
    if mode in ("error", "errorifexists") and fs.get_file_info(root).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} exists already; pass mode='overwrite' or 'append'")


_COMPARE = {
    "==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v),
}


def dnf(filters: list):
    """A list of (column, operator, value) is a conjunction, a list of such lists their disjunction."""
    from functools import reduce

    groups = filters if filters and isinstance(filters[0], list) else [filters]
    one = lambda t: _COMPARE[t[1]](F.col(f"`{t[0]}`"), t[2])
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [one(t) for t in g]) for g in groups])
