"""What an operator may ask of the session it runs in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of sessions without a setting: spark.checkpoint.dir can't be set once a session runs.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is read from spark.checkpoint.dir. Only where that is unset and the
    master is local (tests, a laptop) a temporary folder takes its place; on a cluster
    a missing setting is an error, as a machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        root = _local[app]
    return f"{root.rstrip('/')}/gridloom/{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared folder, read back.

    A written table survives the loss of executors, keeps its schema and has
    statistics, so the plans after it are sized by what is really there. It is
    removed when the driver ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    fs, jpath = _path(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables written by cut() that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            fs, jpath = _path(t.sparkSession, path)
            fs.delete(jpath, True)
