"""Scalar quantisation to a byte per dimension, with exact rank-clipped ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import matrix, vectors
from .metrics import doubles

#: Ranges below this count as constant and get a step of 1.
CONSTANT = 1e-6
#: Rows of a bucket that one task takes whole.
WHOLE = 100_000
#: Bits of a digit in larger ones, and counts that a task holds.
DIGIT, HELD = 8, 1 << 23


def ranges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, most, step) of each dimension; from 100 rows on, a hundredth of them is left out at either end."""
    n = len(rows)
    if not n:
        raise ValueError("a quantiser needs at least one row")
    drop = n // 100 if n >= 100 else 0
    part = np.partition(rows, [drop, n - 1 - drop], axis=0)
    low, high = part[drop], part[n - 1 - drop]
    return low, high, np.where(np.abs(high - low) < CONSTANT, 1.0, (high - low) / 255.0)


def train(rows: DataFrame, dim: int) -> DataFrame:
    """(bucket_id, low, high, step) for each bucket of rows (bucket_id, embedding).

    A bucket of up to WHOLE rows is one task's work; of larger ones rows are counted where they are, by digits.
    """

    def one(table: pa.Table) -> pa.Table:
        low, high, step = ranges(matrix(table.column("embedding"), dim))
        return pa.table({"bucket_id": table.column("bucket_id").slice(0, 1), **{k: vectors(v[None, :]) for k, v in (("low", low), ("high", high), ("step", step))}})

    rows = rows.select("bucket_id", "embedding")
    kind = f"bucket_id {rows.schema['bucket_id'].dataType.simpleString()}, low array<double>, high array<double>, step array<double>"
    large = rows.where("bucket_id is not null").groupBy("bucket_id").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).toArrow()  # a row a bucket
    if not large.num_rows:
        return rows.groupBy("bucket_id").applyInArrow(one, kind)
    inside = F.col("bucket_id").isin(large.column("bucket_id").to_pylist())
    few = rows.where(~inside | F.col("bucket_id").isNull()).groupBy("bucket_id").applyInArrow(one, kind)
    return few.unionByName(_by_digits(rows.where(inside), large, dim))


def _keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Doubles, or floats of 32 bits held as doubles, as unsigned numbers in the same order; NaN comes last."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)  # one zero, one NaN
    raw = x.astype(np.float32).view(np.uint32).astype(np.uint64) if bits == 32 else x.view(np.uint64)
    sign = np.uint64(1 << (bits - 1))
    return np.where(raw & sign, raw ^ np.uint64((1 << bits) - 1), raw | sign)


def _values(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of _keys()."""
    sign = np.uint64(1 << (bits - 1))
    raw = np.where(keys & sign, keys ^ sign, keys ^ np.uint64((1 << bits) - 1))
    return raw.astype(np.uint32).view(np.float32).astype(float) if bits == 32 else raw.view(float)


def _by_digits(rows: DataFrame, large: pa.Table, dim: int) -> DataFrame:
    """train() of rows (bucket_id, embedding) of the buckets in large (bucket_id, n), whatever their size.

    The value of a rank is found digit by digit from the top: a pass over the rows counts, for each bucket, end and
    dimension, the next digits of the values that begin as the value sought does. What is exchanged is a task's counts,
    what is kept between passes 4 x dim numbers a bucket.
    """
    spark, bits = rows.sparkSession, 32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else 64
    kind, ends, digits = rows.schema["bucket_id"].dataType.simpleString(), 2 * dim, 1 << DIGIT
    ids, n = large.column("bucket_id"), large.column("n").to_numpy()
    drop = np.where(n >= 100, n // 100, 0)
    begin, rank = np.zeros((len(n), ends), np.uint64), np.repeat(np.stack([drop, n - 1 - drop], axis=1), dim, axis=1)
    for shift in range(bits - DIGIT, -1, -DIGIT):
        send = spark.sparkContext.broadcast({b: (begin[i], rank[i]) for i, b in enumerate(ids.to_pylist())})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = _keys(matrix(batch.column("embedding"), dim), bits)
                buckets, own = np.unique(batch.column("bucket_id").to_numpy(zero_copy_only=False), return_inverse=True)
                for i, bucket in enumerate(buckets.tolist()):
                    mine, (begin, _) = keys[own == i] if len(buckets) > 1 else keys, send.value[bucket]
                    cells = held.setdefault(bucket, np.zeros(ends * digits, np.int64))
                    top = mine >> np.uint64(shift)
                    for end in range(2):
                        at = slice(end * dim, (end + 1) * dim)
                        _, pos = found = np.nonzero(top >> np.uint64(DIGIT) == begin[at])
                        cells += np.bincount((pos + end * dim) * digits + (top[found] & np.uint64(digits - 1)).astype(np.int64), minlength=len(cells))
                    if len(held) * len(cells) >= HELD:
                        yield from counted(held, batch.schema.field("bucket_id").type)
                        held = {}
            if held:
                yield from counted(held, batch.schema.field("bucket_id").type)

        def counted(held: dict, of: pa.DataType) -> Iterator[pa.RecordBatch]:
            for bucket, cells in held.items():
                used = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(used), of), pa.array(used.astype(np.int32)), pa.array(cells[used])], ["bucket_id", "cell", "n"])

        def pick(table: pa.Table) -> pa.Table:
            begin, rank = send.value[table.column("bucket_id")[0].as_py()]
            cells = np.zeros(ends * digits, np.int64)
            cells[table.column("cell").to_numpy()] = table.column("n").to_numpy()
            cells = cells.reshape(ends, digits)
            upto = cells.cumsum(axis=1)
            digit = (upto <= rank[:, None]).sum(axis=1)
            rank = rank - (upto - cells)[np.arange(ends), digit]
            begin = (begin << np.uint64(DIGIT)) | digit.astype(np.uint64)
            lists = [pa.array([list(map(int, x))], pa.list_(pa.int64())) for x in (begin.view(np.int64), rank)]
            return pa.table([table.column("bucket_id").slice(0, 1), *lists], ["bucket_id", "begin", "rank"])

        counts = rows.mapInArrow(count, f"bucket_id {kind}, cell int, n long").groupBy("bucket_id", "cell").agg(F.sum("n").alias("n"))
        found = counts.groupBy("bucket_id").applyInArrow(pick, f"bucket_id {kind}, begin array<long>, rank array<long>").toArrow()
        ids = found.column("bucket_id")
        begin, rank = (found.column(c).combine_chunks().flatten().to_numpy().reshape(-1, ends) for c in ("begin", "rank"))
        begin = begin.view(np.uint64)
    low, high = _values(begin[:, :dim], bits), _values(begin[:, dim:], bits)
    step = np.where(np.abs(high - low) < CONSTANT, 1.0, (high - low) / 255.0)
    return spark.createDataFrame(pa.table({"bucket_id": ids, "low": vectors(low), "high": vectors(high), "step": vectors(step)}))


def encode(embedding: Column | str, low: Column | str, step: Column | str) -> Column:
    """Codes 0 to 255 as array<smallint>; halves round away from zero."""
    scaled = F.zip_with(F.zip_with(doubles(embedding), doubles(low), lambda x, m: x - m), doubles(step), lambda x, s: F.round(x / s))
    return F.transform(scaled, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("smallint"))


def reconstruct(codes: Column | str, low: Column | str, step: Column | str) -> Column:
    return F.zip_with(doubles(low), F.zip_with(doubles(codes), doubles(step), lambda c, s: c * s), lambda m, x: m + x)


def lookup_table(query: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(dim, 256) squared differences between a query's components and every code's value."""
    return (query[:, None] - (low[:, None] + np.arange(256) * step[:, None])) ** 2


def lookup_distances(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of a query's table to codes (rows, dim)."""
    return table[np.arange(table.shape[0])[None, :], codes].sum(axis=1)


def lookup_scores(queries: np.ndarray, low: np.ndarray, step: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances (queries, rows) between queries and the values of a bucket's codes, by one table a query."""
    return np.stack([lookup_distances(lookup_table(q, low, step), codes) for q in queries])
