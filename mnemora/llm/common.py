"""Helpers that all training-data operators share: inputs, shared folders, written tables."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 512


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The whole documents table, pruned to cols; Arrow batches are kept small for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset, on one machine
    under the warehouse, and an error on a cluster. Never a folder of one machine's own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so lost executors cost no rerun
    and side effects of the tasks that made it (files they wrote) happen once."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def bucket(column: str, modulus: int):
    """crc32 of the column's text modulo modulus; a null value counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def give_back() -> None:
    """Returns freed memory of this process to the system, which the allocators of Python and Arrow keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)
