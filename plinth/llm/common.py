"""Shared folder, lineage cuts and small helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: The most keys that are taken for frequent, and the rows below which no key is.
HOT_KEYS, HOT_ROWS = 2000, 500
#: Used only in local mode (tests), where the session names no shared folder.
LOCAL_FALLBACK = "file:///tmp/checkpoints/plinth"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir. Unset, it has a default in local mode alone: on
    a cluster every machine would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_FALLBACK).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plinth/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later reads neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.plinth_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "plinth_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a local path or URI (file, hdfs, s3, gs), for Python tasks."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@contextlib.contextmanager
def published(path: str) -> Iterator[pa.NativeFile]:
    """An output file that appears under its name only when complete, so that a repeated task attempt is harmless."""
    fs, inner = filesystem(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    temp = f"{inner}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(temp) as out:
        yield out
    fs.move(temp, inner)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a worker holds little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def trim() -> None:
    """Give freed memory back to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that trims its worker's memory when it is done."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone; extra columns can't clash with what an operator adds."""
    small_batches(df.sparkSession)
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def hot_join(rows: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner join of rows with a table of distinct keys whose column n counts (at least) the rows of each. Keys that hold a
    share of 1 / HOT_KEYS or more are HOT_KEYS at most, whatever the data; they are broadcast, so no key meets in a task."""
    on = [key] if isinstance(key, str) else key
    total, most = keys.agg(F.sum("n"), F.max("n")).first()
    if not total or most < HOT_ROWS or most * HOT_KEYS < total:
        return rows.join(keys, on)
    hot = F.col("n") * HOT_KEYS >= total
    few = rows.join(F.broadcast(keys.where(hot).select(*on)), on, "left_anti").join(keys.where(~hot), on)
    return rows.join(F.broadcast(keys.where(hot)), on).unionByName(few)


def free(name: str, taken: list[str]) -> str:
    """A column name like this one that no column has."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def stream(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of batches as tuples of the named columns."""
    for batch in batches:
        yield from zip(*(column(batch, n) for n in names))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose DataFrames are gone (else they stay until a late collection)."""
    gc.collect()
    spark._jvm.System.gc()
