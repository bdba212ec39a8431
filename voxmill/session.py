"""Session settings and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "voxmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are designed for.

    Shuffle partitions are left to the cluster's own setting; adaptive execution
    coalesces small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Each thread has its own: a stream's batches run beside whatever the caller settles.
_scopes = threading.local()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside belong to this block and are deleted when it ends.

    Results that still read them must be written before. Without such a block they stay
    until the shared folder is cleared.
    """
    outer, own = getattr(_scopes, "open", None), []
    _scopes.open = own
    try:
        yield
    finally:
        _scopes.open = outer
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in own:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    A table used several times is then computed once, survives the loss of executors,
    is read by column, and has a known size, by which Spark decides how to join it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    if getattr(_scopes, "open", None) is not None:
        _scopes.open.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
