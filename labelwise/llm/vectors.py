"""Vectors of whole numbers as bytes, and exact whole-number roots; what the two vector operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common

#: A model that goes to every task is at most this large.
MODEL_BYTES = common.BROADCAST_BYTES


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or a value that is not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def widest(dims: int) -> int:
    """Largest whole number a component may be, so that every squared distance fits a long."""
    return math.isqrt((1 << 60) // max(1, dims))


def _scaling(scale: int, dims: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            place = batch.schema.get_field_index("vector")
            flat = batch.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(flat * scale)
            if len(whole) and np.abs(whole).max() > widest(dims):
                raise ValueError(f"a component of {np.abs(flat).max()} is too large: distances would not fit a long")
            data = pa.py_buffer(whole.astype("<i4").tobytes())
            width = 4 * dims
            offsets = pa.py_buffer(np.arange(0, width * (len(batch) + 1), max(1, width), dtype="<i4")[: len(batch) + 1].tobytes())
            ints = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, offsets, data])
            columns = [ints if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return batches


def whole(vectors: DataFrame, scale: int, dims: int, name: str) -> DataFrame:
    """The rows of ``vectors (..., vector)``, all of ``dims`` usable components, written with ``vector`` as the bytes of
    the 32-bit numbers ``floor(scale * x)``."""
    kept = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    schema = ", ".join(
        f"`{f.name}` {'binary' if f.name == 'vector' else f.dataType.simpleString()}" for f in vectors.schema
    )
    return common.keep_table(kept.mapInArrow(_scaling(scale, dims), schema), name)


def matrix(column: pa.Array, dims: int, kind: str = "<i4") -> np.ndarray:
    """A binary column as one row of numbers for each value; no value is null."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), dims)


def bytes_column(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def nearest(distances: np.ndarray) -> np.ndarray:
    """Place of the least value in each row, the first of equal ones."""
    return distances.argmin(axis=1)


def floor_root(squares: np.ndarray) -> np.ndarray:
    """Exact whole part of the square root, for numbers below 2**52."""
    root = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares)
