"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwright.session import shared_folder

#: The white space that separates words: ``[\\x20\\x09-\\x0D]``. ``bytes.split()`` cuts at exactly these.
SPACE = b" \t\n\x0b\x0c\r"


#: What a Python worker keeps from task to task: that of the operator that ran last, and no other's.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps under a key, made when first asked for. Spark gives a worker to one stage after another, so what it kept
    for another key goes first, and its memory goes back to the system."""
    if key not in _KEPT:
        _KEPT.clear()
        trimmed()
        _KEPT[key] = make()
    return _KEPT[key]


def trimmed() -> None:
    """Give what is free between blocks in use back to the system: a tokenizer or many short-lived lists leave far more of that than is
    in use, and it never goes by itself."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the C libraries, glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the session names."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what is no longer referred to, such as the way to a checkpoint: it does so only when
    the driver collects garbage, which a driver with little to do may not do for half an hour."""
    spark._jvm.System.gc()


def named(column: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def packed_rows(docs: DataFrame, *more: Column) -> tuple[DataFrame, T.StructField]:
    """(own, *more), own holding a row's columns whatever their names are; and own as a field of a schema."""
    shape = docs.select(F.struct(*(F.col(named(c)) for c in docs.columns)).alias("own"), *more)
    return shape, T.StructField("own", shape.schema["own"].dataType)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo m: the stated split into learning and held-out rows."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(m))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Of a string array (null: empty): start and end of each value, and the bytes they point into. Nothing is copied."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), memoryview(b"")
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    start, end = at[:-1], at[1:].copy()
    if array.null_count:
        gone = array.is_null().to_numpy(zero_copy_only=False)
        end[gone] = start[gone]
    return start, end, memoryview(data) if data is not None else memoryview(b"")


def ids(array) -> tuple[np.ndarray, np.ndarray]:
    """Long values and where they are null."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    null = array.is_null().to_numpy(zero_copy_only=False)
    return array.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
