"""What a Spark session needs: this package on the executors and a folder that all of them share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: list[str] = []
_OPENED: set[str] = set()


def own_folder() -> str:
    """A folder of this process, gone with it: for files that the driver serves to the executors, and for local sessions."""
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="strandline-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(own_folder(), f"strandline-{len(_SHIPPED)}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(here):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session, as in tests, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own_folder()


def own_tables(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below the shared one; ``release`` deletes it."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/strandline/{sc.applicationId}"
    if path not in _OPENED:
        _OPENED.add(path)
        atexit.register(_release_at_end, spark, path)
    return path


def _release_at_end(spark: SparkSession, path: str) -> None:
    """What is still there goes; a session that has been stopped, or whose Java side has gone, can't delete any more."""
    if path in _OPENED and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            release(spark)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any of Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Spark's file systems; it may be missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written for its own use.

    Call it when no result is read any more; DataFrames of the library can't be read afterwards. It also runs when
    the driver's process ends with its session still open; only a driver that was killed leaves its tables.
    """
    path = own_tables(spark)
    _OPENED.discard(path)
    delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there."""
    path = f"{own_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
