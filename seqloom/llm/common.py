"""What the operators of this subpackage share: tables, shared storage, expressions."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table is broadcast on request only if it is measured to have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of texts that a worker looks at together.
TEXT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where no folder is named (tests in local mode) one below the temporary folder is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read from there.

    Columnar and compressed, so it takes less disk than a checkpoint and later
    reads can prune columns. The folder is the cluster's to clean, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if its measured rows and bytes are within the bounds, else df.

    size: the bytes of a row, 16 if not given. Runs one aggregate over df.
    """
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size if size is not None else F.lit(16)).alias("b")).first()
    fits = got["n"] <= BROADCAST_ROWS and (got["b"] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df


def _by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    rows = docs.withColumn("__sl_text", F.xxhash64("text"))
    keys = small(keys.select(F.col("doc_id").alias("__sl_doc"), F.col("text_hash").alias("__sl_hash")), F.lit(32))
    return rows.join(keys, rows["doc_id"].eqNullSafe(F.col("__sl_doc")) & (rows["__sl_text"] == F.col("__sl_hash")), how).drop("__sl_text")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows that keys(doc_id, text_hash) names; texts are shuffled only if keys aren't small."""
    return _by_key(docs, keys, "left_anti")


def joined(docs: DataFrame, found: DataFrame, size: Column) -> DataFrame:
    """docs(doc_id, text) with the columns of found(doc_id, text_hash, ...); size: the bytes of a row of found."""
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    found = small(found.withColumnsRenamed({"doc_id": "__sl_doc", "text_hash": "__sl_hash"}), size)
    return rows.join(found, rows["doc_id"].eqNullSafe(F.col("__sl_doc")) & (rows["text_hash"] == F.col("__sl_hash"))).drop("__sl_doc", "__sl_hash")


def held(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs that keys(doc_id, text_hash) names."""
    return _by_key(docs, keys, "left_semi")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a worker holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces_of(batches: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose texts (or files) of a column have at most so many bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


#: Where a worker keeps tokenizers and the ids of words from task to task.
WORDS_MODULE = "_seqloom_tokenizers"


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], words: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the memory that it has freed goes back to the system: a worker lives on, and the next may hold as much.

    words: whether the ids of words that the worker holds are for this kind of task; else they go first.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words:
            sys.modules.pop(WORDS_MODULE, None)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is the fast way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
