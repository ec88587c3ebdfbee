"""A table written to the folder that all executors share, and read back: lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in ``spark.checkpoint.dir``; a temporary one only where that is unset, in local mode."""
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
    """The rows of ``df`` from Parquet in the shared folder. Shuffle files of the write go as soon as it stands."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
