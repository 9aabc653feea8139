"""Cutting a plan: a result that several later steps read is written once."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_scope: ContextVar[list[str] | None] = ContextVar("pins", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``, or the checkpoint folder of the session.

    Where neither is set, a local session (one machine, as in tests) gets a folder of its own;
    on a cluster that would scatter the rows over the machines' disks, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="recordmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/recordmill/{uuid.uuid4().hex}"


def pin(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    A table and not a cached frame: it outlives lost executors, and readers
    fetch only the columns they use. ``reader`` is the session that reads it, if not that of ``df``.
    """
    path = fresh_path(df.sparkSession)
    if (made := _scope.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


@contextmanager
def passing_pins(spark: SparkSession) -> Iterator[None]:
    """What is pinned inside is deleted at the end, when its last reader is done; for micro-batches."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in made:
            place = hadoop(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
