"""Tables in the shared folder, which cut the lineage of what is built in rounds."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: session -> threads that write, and the setting before the first of them
_WRITERS: WeakKeyDictionary[SparkSession, tuple[int, str | None]] = WeakKeyDictionary()
_LOCK = threading.Lock()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends. Where no checkpoint
    folder is set, a local master (tests) gets a temporary one; a cluster is refused, as its executors share no local folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='wirespan-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top}/wirespan/{uuid.uuid4().hex}"
    folder, files = _hadoop(spark, path)
    files.deleteOnExit(folder)
    return path


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def _cleaning(spark: SparkSession):
    """The setting that releases shuffle files at the end of a query, for as long as any thread of the session writes here."""
    with _LOCK:
        writers, before = _WRITERS.get(spark, (0, None))
        if not writers:
            before = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _WRITERS[spark] = (writers + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _WRITERS[spark]
            _WRITERS[spark] = (writers - 1, before)
            if writers == 1:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, **options: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: this cuts its lineage. The
    shuffle files of the write are released when it ends. options: of the Parquet writer."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    with _cleaning(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables that written() gave and that nothing reads any more."""
    for df in tables:
        path = _FOLDERS.pop(df, None)
        if path:
            folder, files = _hadoop(df.sparkSession, path)
            files.delete(folder, True)
