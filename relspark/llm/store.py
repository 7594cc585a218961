"""Intermediate tables in the cluster's shared folder, and session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Bytes of a shuffled partition, at most, that a join hashes instead of sorting it.  A hash table does not spill.
HASHED_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests, local mode) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="relspark-")
    return _local[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


def _at_exit() -> None:
    import shutil

    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            _forget(spark, path)
    for path in _local.values():
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_at_exit)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles that made the table are deleted as soon as it is written.  Where the session's partitions are advised
    to be no larger than HASHED_BYTES, joins one side of which has no larger ones hash it: each sort of a task, however
    few its rows, would take pages of the heap."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/relspark-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    advised = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ADVISED))
    hashes = advised <= HASHED_BYTES and spark.conf.get(_HASHED, None) is None
    now = {_CLEANUP: "true"} | ({_HASHED: str(HASHED_BYTES)} if hashes else {})
    before = {key: spark.conf.get(key, None) for key in now}
    try:
        for key, value in now.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by keep() that nothing reads any more."""
    _forget(df.sparkSession, df._kept_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, as a worker holds one at a time; let local workers import this package."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")):
        spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH"), root]))
