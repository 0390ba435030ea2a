"""Shared working storage for results that several stages read.

On a cluster the folder is the one named by ``spark.checkpoint.dir``, which all executors share, so a
table written here outlives any of them. Only where that setting is missing and Spark runs in one process (tests, a laptop) is
a temporary folder made, once per application, and removed at exit; on a cluster the setting must be there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import Files

_own: dict[str, str] = {}
_placed: list[str] = []


def base(spark: SparkSession) -> str:
    """The folder for working tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def place(spark: SparkSession, name: str) -> str:
    """A path for a new working table; it lasts until ``clear`` or the end of the process."""
    if not _placed:
        atexit.register(_at_exit)
    path = f"{base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _placed.append(path)
    return path


@contextmanager
def borrowed(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``keep`` for the length of a block."""
    out = keep(df, name)
    path = _placed[-1]
    try:
        yield out
    finally:
        Files(df.sparkSession).delete(path)
        _placed.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete the working tables of this process; no DataFrame that reads one may be in use any more."""
    files = Files(spark)
    while _placed:
        files.delete(_placed.pop())


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001, S110 - the JVM may be gone already
            pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a working table and return a DataFrame that reads it: its lineage ends here."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
