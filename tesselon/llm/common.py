"""Helpers shared by the corpus operators: table access, shared scratch tables and the word definition.

A *word* is a maximal run of characters outside space and U+0009-U+000D.  The byte-level Python
equivalent is ``bytes.split()``, whose separators are exactly those six ASCII characters.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master (tests) may leave it unset and gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark.sparkContext, "_tesselon_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="tesselon-")
            spark.sparkContext._tesselon_scratch = base
            atexit.register(_remove_local, base[len("file://"):])
    return base.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run in the shared folder.  They replace lineage, so a lost executor costs only a reread.

    Results read them lazily; they are deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[DataFrame] = []
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def new_path(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new_path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tesselon_path = path
        self.tables.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        delete_path(self.spark, df._tesselon_path)
        self.tables = [t for t in self.tables if t is not df]

    def keep_only(self, *kept: DataFrame) -> None:
        """Deletes the tables that the result no longer reads."""
        for t in list(self.tables):
            if all(t is not k for k in kept):
                self.drop(t)


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


_BLANK = re.compile(r"[\x20\x09-\x0D]")
PIECE = 1 << 20


def pieces(text: str, size: int = PIECE):
    """The text cut at white space into pieces of about ``size`` characters, so that no list of all its words is made."""
    at = 0
    while len(text) - at > size:
        m = _BLANK.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


#: Rows and bytes of an Arrow batch, and with them what a Python worker holds.  One value for all operators: results are
#: lazy, so a setting of one operator would reach the frames of another that have not run yet.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Functions with caches that outlive a task, such as that of an encoder's vocabulary.
KEPT: list = []


def kept(cached):
    """Marks a cached function as one whose cache ``lean_worker`` empties."""
    KEPT.append(cached)
    return cached


def lean_worker() -> None:
    """Drops what tasks of other operators left in this Python worker, which Spark uses again, and gives free memory back."""
    import ctypes

    import pyarrow as pa

    for f in KEPT:
        f.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of some systems has none
    if trim is not None:
        trim(0)


def lean(run):
    """The Arrow function ``run``, before and after which the worker gives back what it does not need."""

    def lean_run(batches):
        lean_worker()
        yield from run(batches)
        lean_worker()

    return lean_run


def small_table(spark: SparkSession, columns: dict) -> DataFrame:
    """A table of Arrow arrays from the driver.  One of Python rows would start Python workers on the executors to read it."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))
