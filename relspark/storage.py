"""Shared-folder tables that cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process (tests) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="relspark-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there when the driver ends is deleted."""
    path = f"{shared_folder(spark)}/relspark-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _at_exit() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone: the folder's owner clears it
            break
    for path in _own.values():
        shutil.rmtree(path, ignore_errors=True)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write df as Parquet and read it back; drop() deletes it, or else the end of the driver."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by keep() that nothing reads any more."""
    _delete(df.sparkSession, df._kept_at)
