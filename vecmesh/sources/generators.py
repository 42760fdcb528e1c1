"""Seeded vectors for recall tests and benches, made on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(*key) -> Column:
    """A number in (0, 1) from a hash, the same wherever and however often it is made."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 24)) + 0.5) / float(1 << 24)


def _vector(dim: int, part) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: part(i).cast("float"))


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 42, high: float = 100.0, first: int = 0) -> DataFrame:
    return spark.range(first, first + n).select("id", _vector(dim, lambda i: _unit("id", i, F.lit(seed)) * high).alias("embedding"))


def clusters(spark: SparkSession, n: int, dim: int, centres: int = 5, sigma: float = 15.0, step: int = 0, seed: int = 999, first: int = 0) -> DataFrame:
    """Gaussian clusters whose centres, a hash of (cluster, dimension), move with `step`."""
    rows = spark.range(first, first + n).withColumn("c", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(centres)))

    def part(i: Column) -> Column:
        centre = _unit("c", i, F.lit(seed)) * 100 + (_unit("c", i, F.lit(seed + 1)) - 0.5) * 5 * step
        gauss = F.sqrt(-2 * F.log(_unit("id", i, F.lit(seed + 2)))) * F.cos(2 * math.pi * _unit("id", i, F.lit(seed + 3)))
        return centre + gauss * sigma

    return rows.select("id", _vector(dim, part).alias("embedding"))


def needles(spark: SparkSession, queries: DataFrame, each: int, reach: float = 0.005, seed: int = 42, first: int = 10_000_000) -> DataFrame:
    """`each` rows around every query (query_id, embedding), within `reach` of it in all dimensions."""
    many = queries.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    near = F.transform("embedding", lambda x, i: (x + (F.pmod(F.xxhash64("query_id", "k", i, F.lit(seed)), F.lit(2001)) / 1000.0 - 1.0) * reach).cast("float"))
    return many.select((F.lit(first) + F.col("query_id") * each + F.col("k")).alias("id"), "query_id", near.alias("embedding"))
