"""Schemas and checks of a collection's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])
OPS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tx_id", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
BASE = T.StructType([*ROWS.fields, T.StructField("bucket_id", T.IntegerType())])
CENTROIDS = T.StructType([T.StructField("bucket_id", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

CODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("codes", T.ArrayType(T.ShortType())), T.StructField("bucket_id", T.IntegerType())])
QUANTIZERS = T.StructType([T.StructField("bucket_id", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("low", "high", "step"))])


TOTALS = T.StructType([T.StructField("bucket_id", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])


class Conflict(RuntimeError):
    """Another writer was first."""


class NotFound(LookupError):
    """No such collection."""


class InvalidInput(ValueError):
    """An argument that contradicts a collection or makes no sense."""


def bad(dim: int) -> Column:
    """Whether a row (id, embedding) lacks an id or `dim` numbers."""
    wrong = F.col("id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.coalesce(wrong, F.lit(True))


def checked(rows: DataFrame, dim: int, seen: Observation) -> DataFrame:
    """rows (id, embedding) as the engine stores them; `seen` tells their number n and how many of them are bad."""
    wrong = bad(dim)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.observe(seen, F.count("*").alias("n"), F.sum(wrong.cast("int")).alias("bad"))
