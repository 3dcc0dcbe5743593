"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.session import shared_path

#: Rows of texts that a worker holds at once.
TEXT_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage is cut and a lost
    executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet, whatever the case of letters."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def worker_cache(owner: str) -> dict:
    """What a worker process keeps between tasks of one operator. It hangs on ``sys`` because
    functions sent by value get new globals with each task. What another operator has left is
    dropped, so that only one operator's things are held."""
    cache = vars(sys).setdefault("_hearsay_cache", {})
    if cache.get("owner") != owner:
        cache.clear()
        cache["owner"] = owner
        _give_back()
    return cache


#: mallopt's numbers for the largest free end of the heap that is kept, and for the least size of
#: what is allocated outside of the heap, and the bytes that both are set to.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _LARGE = -1, -3, 1 << 20


def _give_back() -> None:
    """Hand freed memory back to the system. A worker lives on between operators, and by default the C
    library comes to keep even large arrays for itself, as Arrow does with its buffers."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if not hasattr(library, "malloc_trim"):  # not glibc
        return
    if not vars(sys).get("_hearsay_lean"):
        vars(sys)["_hearsay_lean"] = True
        library.mallopt(_MMAP_THRESHOLD, _LARGE)
        library.mallopt(_TRIM_THRESHOLD, _LARGE)
    library.malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    if not vars(sys).get("_hearsay_lean"):
        _give_back()
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def seeded(column: str, seed: int):
    """A repeatable pseudo-random order of the rows, as a 64-bit hash."""
    return F.xxhash64(F.lit(seed), F.col(column))
