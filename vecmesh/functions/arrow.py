"""Vectors between Arrow and numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as (rows, dim) doubles; other lengths and nulls are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * dim or any(n != dim for n in set(column.value_lengths().to_pylist())):
        raise ValueError(f"every vector must have {dim} components, none of them null")
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dim)


def vectors(rows: np.ndarray) -> pa.Array:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(rows, float).ravel()))


def group_sums(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Sums (k, dim) of the rows of each group 0 to k - 1."""
    order = group.argsort(kind="stable")
    used, first = np.unique(group[order], return_index=True)
    out = np.zeros((k, x.shape[1]))
    if len(x):
        out[used] = np.add.reduceat(x[order], first, axis=0)
    return out


@dataclass
class Queries:
    """Few queries, gathered: their ids and vectors."""

    ids: np.ndarray
    x: np.ndarray

    @classmethod
    def few(cls, queries: DataFrame, dim: int, most: int) -> Queries | None:
        """Gather queries (query_id, embedding); None if there are more than `most`."""
        table = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").limit(most + 1).toArrow()
        return cls.of(table, dim) if table.num_rows <= most else None

    @classmethod
    def of(cls, table: pa.Table, dim: int) -> Queries:
        return cls(table.column("query_id").to_numpy(), matrix(table.column("embedding"), dim) if table.num_rows else np.zeros((0, dim)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table({"query_id": pa.array(self.ids, pa.int64()), "embedding": vectors(self.x)}))
