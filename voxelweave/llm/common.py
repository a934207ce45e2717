"""Shared plumbing of the text operators: tables, the shared folder, bounded batches of texts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one kernel call sees at once, in characters; a longer text is a call of its own.
BATCH_CHARS = 2_000_000
#: Bytes and rows of one Arrow batch between the JVM and a Python worker.
ARROW_BYTES = "4m"
ARROW_ROWS = "20000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that very long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset on a local master."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "voxelweave-shared"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class _Written(threading.local):
    """Tables that this thread of the driver has written to the shared folder, so that they can be taken away; those of queries of other threads stay."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in this application's part of the shared folder."""
    _WRITTEN.paths.append(f"{shared_dir(spark)}/voxelweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN.paths[-1]


def written_so_far() -> int:
    return len(_WRITTEN.paths)


def delete_written(spark: SparkSession, since: int, keep: str) -> None:
    """Take away what was written after ``since``, but for ``keep``: for a caller that knows that nothing reads it any more."""
    for path in _WRITTEN.paths[since:]:
        if path != keep:
            delete_path(spark, path)
    _WRITTEN.paths[since:] = [p for p in _WRITTEN.paths[since:] if p == keep]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder and read it back. Returns the table and its path."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are needed, so that no other column can clash; a null text is an empty one."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_chunks(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of at most BATCH_CHARS bytes of text, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_CHARS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(docs: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """Apply ``kernel`` to slices of (doc_id, text) rows; it returns columns by name, in the order of ``schema``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            out = kernel(chunk)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, kernel: Callable[[pa.RecordBatch], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, for which ``kernel`` says so of a slice; a null text is passed on as null. Nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, text_col):
            yield chunk.filter(pa.array(kernel(chunk), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc32_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))
