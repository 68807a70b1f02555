"""Getting this package to the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, unless workers find it by PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(root) in on_path or app in _shipped:
        return
    folder = tempfile.mkdtemp()  # the driver's own; Spark hands the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, Path(__file__).parent.name), "zip", root, Path(__file__).parent.name))
    _shipped.add(app)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in turn over the session's tasks, before work that costs far more than moving a row.

    A scan makes tasks by the bytes and row groups of its files, so a million short rows may be one
    task. The number is given, as Spark would join small parts again otherwise.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
