"""Shared plumbing of the training-data operators: reading, cutting lineage, words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of texts that a Python worker holds as objects at a time; a longer text comes alone.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 21

#: Held while a table is written, then set back: shuffle files go as soon as it stands, and Arrow batches are small.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
_folders: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of bounded rows and bytes of ``text``, whatever Spark puts into a batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(lengths), 0
    while at < len(lengths):
        before = int(upto[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Give memory that is free in this process back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of all batches of a task; at its end free memory is given back."""
    for batch in batches:
        yield from slices(batch, text, rows, size)
    release()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a block; the user's own are back after it."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = base or tempfile.mkdtemp(prefix="candlework-")
        folder = _folders[app] = f"{base.rstrip('/')}/candlework-{uuid.uuid4().hex}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove():
            try:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # noqa: BLE001  the session may be gone; the folder is temporary anyway
                pass

        atexit.register(remove)
    return _folders[app]


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: work done once, and kept if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, _WHILE_WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text):
    """Words of a text column; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
