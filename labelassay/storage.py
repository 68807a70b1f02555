"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED_DIR = "file:///tmp/labelassay-shared"  # only where one machine runs everything

_made: list[tuple[SparkSession, str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of tables that ``kept_table`` returned


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_SHARED_DIR
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove_path(spark, path)
        except Exception:  # the session may be gone; nothing is left to clean then
            return


#: For rows that go to Python with large values: small batches.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions inside; the former ones come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    This cuts the lineage; a lost executor costs only the tasks it ran.
    """
    path = scratch_path(df.sparkSession, name)
    with settings(df.sparkSession, ARROW_LIMITS):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Remove the files of tables that ``kept_table`` returned and nothing will read again; others are left alone."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            remove_path(t.sparkSession, path)
