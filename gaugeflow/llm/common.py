"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeflow.session import work_folder

#: Rows that a Python task makes something of at once, however many a batch has.
SLICE_ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body's own lambdas look at it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, base: str) -> str:
    """A name for an internal column that ``df`` does not have, in upper or lower case."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared checkpoint folder and reads it back.

    What follows then starts from files that outlive any executor.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def worker_store(key) -> dict:
    """A dictionary that lives as long as the Python worker, so that a compiled model serves all tasks of a worker.

    A worker keeps one at a time: asking for another key drops what it had and
    gives the memory back, as workers outlive the stage that filled them.
    """
    module = sys.modules.setdefault("gaugeflow_worker_store", types.ModuleType("gaugeflow_worker_store"))
    if getattr(module, "key", None) != key:
        had = getattr(module, "kept", None)
        module.key, module.kept = key, {}
        if had:
            del had
            give_back()
    return module.kept


def give_back():
    """Frees reference cycles and returns the free memory of the allocators to the system, where they can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that little is under way at any time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


@contextmanager
def no_cycles():
    """Pauses the search for reference cycles, which would walk a worker's large tables again and again."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
