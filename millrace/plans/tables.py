"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Drops a finished query's shuffle files instead of waiting for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a share whose shuffle is on disk at one time.
SHARE_ROWS = 50_000_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a temporary one; on a cluster that is an error, as executors don't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext  # the setting itself can't be changed in a running session
        if not context.getCheckpointDir():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
        folder = context.getCheckpointDir()
    return folder


@contextmanager
def settings(spark: SparkSession, **values: str | int) -> Iterator[None]:
    """Session settings (``__`` for dots) that hold for what runs inside, and are put back after it."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors. ``rows``: rows in a batch for Python."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, **{_CLEANUP: "true"} | ({_BATCH: rows} if rows else {})):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def written_in_shares(share: Callable[[Column], DataFrame], key: str, rows: int, most: int, name: str) -> DataFrame:
    """A table written in as many shares as keep ``rows`` to ``most`` in each, one after the other: the shuffle of a share is gone when the next one starts.

    ``share`` makes what belongs to the keys for which the condition holds that it is given, on a column named ``key``.
    """
    shares, folder = max(1, -(-rows // most)), f"{name}-{uuid.uuid4().hex}"
    tables = [written(share((F.pmod(F.xxhash64(F.col(key)), F.lit(shares)) == i) if shares > 1 else F.lit(True)), f"{folder}/share") for i in range(shares)]
    out = tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.table_path for t in tables))
    out.table_path = tables[0].table_path.rsplit("/", 1)[0]
    return out


def small(df: DataFrame, name: str, most: int = 300_000) -> DataFrame:
    """``df`` written, and broadcast if it has at most ``most`` rows: a join on a few keys would put the other side into as few tasks."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= most else df


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
