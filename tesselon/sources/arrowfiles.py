"""Python data source that writes Arrow batches to one Parquet or Feather file a task, with the ``geo`` key.

Spark's own writer cannot add a footer key.  Files are written under a temporary name and get their
final one when the job commits, so attempts of lost tasks leave nothing behind; overwriting removes the
old files at that moment and not before.  Paths are resolved with pyarrow's file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Characters that hive folders hold as they are.
_PLAIN = " !$&()+,-.;@^_`~"


@dataclass
class Part(WriterCommitMessage):
    """Files of one task: (temporary name, hive folder or "")."""

    files: list[tuple[str, str]]
    partition: int


def filesystem(path: str, storage: dict | None = None):
    """(file system, path in it).  ``storage`` are arguments of pyarrow's file system class for the path's scheme."""
    import pyarrow.fs as pafs

    scheme = path.split("://", 1)[0].lower() if "://" in path else "file"
    if storage:
        kinds = {"s3": "S3FileSystem", "gs": "GcsFileSystem", "gcs": "GcsFileSystem", "abfs": "AzureFileSystem", "abfss": "AzureFileSystem", "hdfs": "HadoopFileSystem"}
        if scheme not in kinds:
            raise ValueError(f"storage_options have no meaning for {scheme}://")
        return getattr(pafs, kinds[scheme])(**storage), path.split("://", 1)[1]
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.geo = options["path"].rstrip("/"), options.get("kind", "parquet"), options["geo"]
        self.by, self.storage = json.loads(options.get("by", "[]")), json.loads(options.get("storage", "{}"))
        self.job, self.overwrite = uuid.uuid4().hex, overwrite
        self.extension = "parquet" if self.kind == "parquet" else "feather"
        fs, root = filesystem(self.path, self.storage)
        fs.create_dir(root, recursive=True)

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.feather as feather
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        from tesselon.sources.geometa import Boxes

        context = TaskContext.get()
        number = context.partitionId() if context else 0
        fs, root = filesystem(self.path, self.storage)
        geo = json.loads(self.geo)
        fresh = lambda: f"{root}/_{self.job}-{number}-{uuid.uuid4().hex}"
        if self.kind == "parquet":
            # Row groups go out as they come, to a file for each hive folder; the boxes are known, and added, at the end.
            opened: dict[str, tuple] = {}
            for batch in iterator:
                for folder, part in self._split(batch):
                    if folder not in opened:
                        name = fresh()
                        out = fs.open_output_stream(name)
                        # Without a stored Arrow schema readers take schema metadata from the keys that are added below.
                        opened[folder] = name, out, pq.ParquetWriter(out, part.schema, compression="zstd", store_schema=False), Boxes(geo)
                    _, _, writer, boxes = opened[folder]
                    boxes.add(part)
                    writer.write_batch(part)
            for _, out, writer, boxes in opened.values():
                writer.add_key_value_metadata({"geo": boxes.text()})
                writer.close()
                out.close()
            return Part([(o[0], folder) for folder, o in opened.items()], number)
        # The Arrow file format has its metadata in front, so a partition is held until its boxes are known.
        batches = list(iterator)
        if not batches:
            return Part([], number)
        name, boxes = fresh(), Boxes(geo)
        for batch in batches:
            boxes.add(batch)
        table = pa.Table.from_batches(batches)
        table = table.replace_schema_metadata({**(table.schema.metadata or {}), b"geo": boxes.text().encode()})
        with fs.open_output_stream(name) as out:
            feather.write_feather(table, out, compression="lz4")
        return Part([(name, "")], number)

    def _split(self, batch):
        """(hive folder, rows without the folder's columns) of a batch."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by:
            yield "", batch
            return
        table = pa.Table.from_batches([batch])
        keys = table.select(self.by).group_by(self.by).aggregate([])
        rest = [c for c in table.column_names if c not in self.by]
        for row in keys.to_pylist():
            mask = None
            for c, v in row.items():
                m = pc.is_null(table[c]) if v is None else pc.fill_null(pc.equal(table[c], pa.scalar(v, table[c].type)), False)
                mask = m if mask is None else pc.and_(mask, m)
            folder = "".join(f"/{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else quote(str(v), safe=_PLAIN)}" for c, v in row.items())
            yield folder, table.filter(mask).select(rest).combine_chunks().to_batches()[0]

    def commit(self, messages):
        fs, root = filesystem(self.path, self.storage)
        if self.overwrite:
            # What was there goes once all new files are complete, so a failed job leaves it and the job may read it.
            import pyarrow.fs as pafs

            for f in fs.get_file_info(pafs.FileSelector(root)):
                if not f.base_name.startswith(f"_{self.job}"):
                    fs.delete_dir(f.path) if f.type == pafs.FileType.Directory else fs.delete_file(f.path)
        count: dict[str, int] = {}
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, folder in m.files:
                if folder not in count:
                    fs.create_dir(root + folder, recursive=True)
                    count[folder] = self._next(fs, root + folder)
                fs.move(name, f"{root}{folder}/part.{count[folder]}.{self.extension}")
                count[folder] += 1

    @staticmethod
    def _next(fs, folder: str) -> int:
        """The number after those of the parts that are there already."""
        import pyarrow.fs as pafs

        names = (re.search(r"/part\.(\d+)\.\w+$", f.path) for f in fs.get_file_info(pafs.FileSelector(folder)))
        return max((int(m[1]) + 1 for m in names if m), default=0)

    def abort(self, messages):
        fs, _ = filesystem(self.path, self.storage)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(name)


class GeoFiles(DataSource):
    @classmethod
    def name(cls):
        return "tesselon-files"

    def schema(self):
        raise NotImplementedError("this source is for writing")

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def write(df, path: str, geo: dict, kind: str, mode: str, by: list[str] | None = None, storage: dict | None = None) -> None:
    spark = df.sparkSession
    spark.dataSource.register(GeoFiles)
    df.write.format("tesselon-files").mode("overwrite" if mode == "overwrite" else "append").option("path", path).option("kind", kind).option("geo", json.dumps(geo)).option("by", json.dumps(by or [])).option("storage", json.dumps(storage or {})).save()
