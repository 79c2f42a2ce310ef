"""Vectors as rows of whole numbers, and blocks of them for numpy.

A row takes part only if its vector is there and all of its components are finite numbers. Components become
floor(scale * x), x as double. Vectors shorter than others of their block count as filled up with zeros."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    known = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(known, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """The components as floor(scale * x). One beyond 2^52 would not be exact: such a vector is an error."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    fits = F.forall(scaled, lambda x: F.abs(x) < 2.0**52)
    return F.when(fits, F.transform(scaled, lambda x: F.floor(x))).otherwise(F.raise_error(F.lit("a component is too large for exact sums")).cast("array<bigint>"))


def rows_of(table: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows with finite vectors; other columns are left behind."""
    kept = table.where(finite(F.col(vector)))
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), integers(F.col(vector), scale).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, short lists filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths := np.array(column.value_lengths(), dtype=np.int64))
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches of a task joined and cut again, so that each has `rows` rows, the last one fewer."""
    held, size = [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, rows - size)
            held.append(part)
            size, start = size + part.num_rows, start + part.num_rows
            if size == rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix in the narrowest whole-number type that holds it: the type's name, and the bytes."""
    most = int(np.abs(x).max(initial=0))
    kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, rows: int) -> np.ndarray:
    flat = np.frombuffer(data, dtype=kind).astype(np.int64)
    return flat.reshape(rows, len(flat) // rows if rows else 0)
