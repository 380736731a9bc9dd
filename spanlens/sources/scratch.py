"""Intermediate tables in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Where that setting is
absent, as in local tests, a temporary folder of this machine is used; with any
other master its absence is an error, because a machine-local folder would be
lost with an executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="spanlens-")
    return _LOCAL_ROOTS[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/spanlens-{app}/{tag}-{uuid.uuid4().hex}"
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(_clean, spark, app)
    _MADE[app].append(path)
    return path


def _clean(spark: SparkSession, app: str) -> None:
    for path in _MADE.pop(app, []):
        try:
            drop(spark, path)
        except Exception:  # the JVM may have ended before this hook
            return


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, on whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a later stage that is computed again after the loss
    of an executor reads the files instead of repeating what made them.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanlens_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    path = getattr(df, "_spanlens_path", None)
    if path:
        drop(df.sparkSession, path)
