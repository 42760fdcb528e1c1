"""Bucket statistics and the decisions of maintenance: which bucket to split, which to dissolve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import group_sums, matrix, vectors

CAPACITY = 1000
SPLIT_AT, SHIFT_AT, URGENT_AT = 0.8, 0.15, 1.5
ZOMBIE_WEIGHT, TEMPERATURE_FLOOR = 3.0, 0.001
START, TOUCH, COOL = 0.5, 0.05, 0.98
#: A bucket with more rows than this isn't scattered.
SCATTER_ROWS = 100
#: Rows of a row group, and numbers that a task holds as sums.
ROW_GROUP, HELD = 1000, 1 << 23


def sums(rows: DataFrame) -> DataFrame:
    """(bucket_id, pos, total, n) of the rows (bucket_id, embedding), combined within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"), len(batch.column("embedding")[0]))
            buckets, own = np.unique(batch.column("bucket_id").to_numpy(), return_inverse=True)
            for bucket, total, n in zip(buckets.tolist(), group_sums(x, own, len(buckets)), np.bincount(own).tolist()):
                if bucket in held:
                    held[bucket][0] += total
                    held[bucket][1] += n
                else:
                    held[bucket] = [total, n]
            if len(held) * x.shape[1] >= HELD:
                yield part(held)
                held = {}
        if held:
            yield part(held)

    def part(held: dict[int, list]) -> pa.RecordBatch:
        total, n = zip(*held.values())
        return pa.RecordBatch.from_arrays([pa.array(list(held)).cast(kind), vectors(np.array(total)), pa.array(n, pa.int64())], ["bucket_id", "sums", "n"])

    kind = pa.int32() if rows.schema["bucket_id"].dataType.simpleString() == "int" else pa.int64()
    parts = rows.select("bucket_id", "embedding").mapInArrow(run, f"bucket_id {'int' if kind == pa.int32() else 'long'}, sums array<double>, n long")
    return parts.select("bucket_id", "n", F.posexplode("sums").alias("pos", "x")).groupBy("bucket_id", "pos").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def centroids(rows: DataFrame) -> DataFrame:
    """(bucket_id, centroid, n) as means of the rows (bucket_id, embedding) themselves."""
    return means(sums(rows))


def means(totals: DataFrame) -> DataFrame:
    """(bucket_id, centroid, n) of totals (bucket_id, pos, total, n); buckets without rows have none."""
    at = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("centroid")
    return totals.where("n > 0").withColumn("m", F.col("total") / F.col("n")).groupBy("bucket_id").agg(at, F.max("n").alias("n"))


def position_stats(rows: DataFrame) -> DataFrame:
    """(bucket_id, pos, n, total, mean) of each dimension."""
    return sums(rows).select("bucket_id", "pos", "n", "total", (F.col("total") / F.col("n")).alias("mean"))


def shift(rows: DataFrame, stored_centroids: DataFrame) -> DataFrame:
    """(bucket_id, shift): the distance between a bucket's mean and its stored centroid; 0 without one."""
    stored = stored_centroids.select("bucket_id", F.posexplode(F.col("centroid").cast("array<double>")).alias("pos", "c"))
    gap = position_stats(rows).join(stored, ["bucket_id", "pos"], "left").withColumn("g", F.coalesce(F.col("mean") - F.col("c"), F.lit(0.0)))
    return gap.groupBy("bucket_id").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("shift"))


def counts(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """(bucket_id, total, dead) of rows (id, bucket_id), given deleted ids."""
    gone = deletes.select("id").distinct().withColumn("__gone", F.lit(1))
    return rows.select("id", "bucket_id").join(gone, "id", "left").groupBy("bucket_id").agg(F.count("*").alias("total"), F.count("__gone").alias("dead"))


def urgency(total: Column, dead: Column, temperature: Column, capacity: float = CAPACITY) -> Column:
    """How much a bucket should be dissolved: its emptiness over its temperature, plus its share of dead rows."""
    alive = F.greatest(total - dead, F.lit(0))
    empty = F.when(alive < capacity, (F.lit(float(capacity)) - alive) / F.lit(float(capacity))).otherwise(F.lit(0.0))
    return empty / (temperature + TEMPERATURE_FLOOR) + ZOMBIE_WEIGHT * F.when(total > 0, dead / total).otherwise(F.lit(0.0))


def decide(stats: DataFrame, capacity: float = CAPACITY, shift_at: float = SHIFT_AT) -> DataFrame:
    """stats (bucket_id, total, dead, temperature[, shift]) with urgency and action: split, merge or none."""
    moved = F.col("shift") if "shift" in stats.columns else F.lit(0.0)
    full = F.col("total") / F.lit(float(capacity))
    need = urgency(F.col("total"), F.col("dead"), F.col("temperature"), capacity)
    action = F.when((full > 1.0) | ((full > SPLIT_AT) & (moved > shift_at)), "split").when(need > URGENT_AT, "merge").otherwise("none")
    return stats.withColumn("urgency", need).withColumn("action", action)


def temperature(touches: Column, cools: Column, start: float = START) -> Column:
    """After so many touches and then so many ticks of cooling, in closed form."""
    warm = 1.0 - (1.0 - start) * F.pow(F.lit(1.0 - TOUCH), touches)
    return warm * F.pow(F.lit(COOL), cools)


def promote(base: DataFrame, delta: DataFrame, deletes: DataFrame) -> DataFrame:
    """Compaction of both tiers (id, bucket_id, embedding): all rows that aren't deleted."""
    return base.unionByName(delta).join(deletes.select("id").distinct(), "id", "left_anti")


def prune(deletes: DataFrame, processed: DataFrame) -> DataFrame:
    """Deletes (id) that compaction hasn't applied."""
    return deletes.select("id").distinct().join(processed.select("id").distinct(), "id", "left_anti")


def validate_buckets(mapping: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, said, found) where a map (id, bucket_id) and the rows disagree; null where one lacks the id."""
    a, b = mapping.select("id", F.col("bucket_id").alias("said")), rows.select("id", F.col("bucket_id").alias("found"))
    return a.join(b, "id", "full_outer").where(~F.col("said").eqNullSafe(F.col("found")))


def columns(rows: DataFrame, most: int = ROW_GROUP) -> DataFrame:
    """Rows to columns: (bucket_id, part, pos, values array in order of id, ids) of rows (id, embedding[, bucket_id]).

    A bucket's rows are dealt into row groups of about `most`; each dimension of a group is one row.
    """
    if "bucket_id" not in rows.columns:
        rows = rows.withColumn("bucket_id", F.lit(0))
    sizes = rows.groupBy("bucket_id").agg(F.ceil(F.count("*") / F.lit(most)).alias("__groups"))
    dealt = rows.join(sizes, "bucket_id").select("bucket_id", F.pmod(F.xxhash64("id"), "__groups").cast("int").alias("part"), "id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    packed = dealt.groupBy("bucket_id", "part", "pos").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("p"))
    return packed.select("bucket_id", "part", "pos", F.transform("p", lambda p: p["x"]).alias("values"), F.transform("p", lambda p: p["id"]).alias("ids"))


def rows_of(cols: DataFrame) -> DataFrame:
    """The inverse of columns(): (id, embedding), ids being unique."""
    flat = cols.select("pos", F.explode(F.arrays_zip("ids", "values")).alias("z")).select("pos", "z.ids", "z.values")
    return flat.groupBy(F.col("ids").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "values"))), lambda p: p["values"]).alias("embedding"))
