"""Shared storage for what iterative operators keep between their rounds."""

from __future__ import annotations

import os
from collections.abc import Iterator
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one below the temporary folder where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return named or sc.getCheckpointDir()


def written(df: DataFrame, name: str, by: str | None = None) -> str:
    """Where in the shared folder df has been written as Parquet; by: a column, for each of whose values there is a folder."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return path


def batches(path: str, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of a folder of written(), read by a task from the shared storage a few at a time; none if there is no such folder."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    for f in sorted(x.path for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.path.endswith(".parquet")):
        with store.open_input_file(f) as file:
            yield from pq.ParquetFile(file).iter_batches(rows)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again, which cuts its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """The files of a folder, in any store that Spark can read, whose names end so."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f for f in (x.getPath().toString() for x in found) if f.endswith(suffix))


def size(df: DataFrame) -> int:
    """Bytes of the files that df is read from, in any store that Spark can read."""
    sc, out = df.sparkSession.sparkContext, 0
    for f in df.inputFiles():
        at = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(f))
        out += at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return out


#: Rows, of a few numbers each, up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, which is kept and has rows of a few numbers, with a broadcast hint if it is counted to have few of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
