"""Whole-number vectors, and shards of them that tasks search with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselight.session import new_path

SCALE = 256
# A shard's vectors take about this much memory, whatever their number of dimensions.
SHARD_BYTES = 1 << 20
NOWHERE = np.iinfo(np.int64).max


def whole(vector: str) -> Column:
    """``floor(256 * x)`` of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.coalesce(~odd, F.lit(False))


@dataclass(frozen=True)
class Shape:
    """What tasks need to know of all vectors: their number, length and range."""

    rows: int
    dims: int
    stored: str  # the type that holds every component
    exact: str  # the type in which every inner product is exact
    norm: float  # the greatest length
    shard_rows: int

    @property
    def partitions(self) -> int:
        return max(1, -(-self.rows // self.shard_rows))

    def matrix(self, column) -> np.ndarray:
        """An Arrow column of lists as rows of equal length; missing components are zero."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(column), self.dims), self.stored)
        values = column.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        return out

    def read(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.stored).reshape(-1, self.dims).astype(self.exact)


def shape(rows: DataFrame, vector: str = "vec") -> Shape:
    """One pass over whole-number vectors."""
    x = F.col(vector)
    # A sum of products is at most the product of the lengths.
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    largest = F.greatest(F.abs(F.array_max(x)), F.abs(F.array_min(x)))
    got = rows.agg(
        F.count("*").alias("n"), F.max(F.size(x)).alias("dims"),
        F.max(largest).alias("most"), F.max(square).alias("square"),
    ).first()
    most, square = got["most"] or 0, got["square"] or 0.0
    stored = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    exact = "f8" if square < 2**52 else "i8"
    dims = max(1, got["dims"] or 1)
    shard_rows = max(64, SHARD_BYTES // (dims * np.dtype(stored).itemsize))
    return Shape(got["n"], dims, stored, exact, float(np.sqrt(square)), shard_rows)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: a lost executor costs a re-read."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def met(pairs: DataFrame, chunks: DataFrame, shards: DataFrame, tasks: int) -> DataFrame:
    """Chunks of queries beside the shards that they are to be held against.

    ``pairs`` names them by ``chunk`` and ``shard``. A shard is sent once, to the
    task of all its pairs; what is sent once a pair is the smaller chunk.
    """
    left = pairs.join(chunks, "chunk").repartition(tasks, "shard")
    return left.join(shards.repartition(tasks, "shard"), "shard")
