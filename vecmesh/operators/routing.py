"""Bucket routing: the nearest bucket of a vector, and the buckets a query should look into.

Centroids are one row a bucket; they are broadcast as a matrix, and each batch of vectors is scored against it, so
routing has no exchange. More of them than fit BROADCAST_BYTES go out in blocks, one pass over the vectors each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import Queries, matrix
from ..functions.metrics import Metric, block_scores

#: Defaults of a search.
TARGET, DECAY, DENSITY = 0.9, 25.0, 100.0
GUARDRAIL = 3
FLOOR = 1e-9
BOOTSTRAP_BUCKET = 0
BROADCAST_BYTES = 512 << 20
#: Scores that a step holds at once.
CELLS = 1 << 21


class Centroids:
    """bucket ids (ascending), their centroids and row counts on the driver."""

    def __init__(self, centroids: DataFrame, dim: int):
        table = centroids.select("bucket_id", "centroid", "n").orderBy("bucket_id").toArrow()
        self.ids, self.n = table.column("bucket_id").to_numpy(), table.column("n").to_numpy().astype(float)
        self.points = matrix(table.column("centroid"), dim) if len(self.ids) else np.zeros((0, dim))
        self.dim = dim

    def send(self, rows: DataFrame):
        return rows.sparkSession.sparkContext.broadcast((self.ids, self.points, self.n))


def blocks(centroids: DataFrame | Centroids, dim: int) -> Iterator[Centroids]:
    """All centroids in parts of about BROADCAST_BYTES, gathered one after the other; at least one part."""
    if isinstance(centroids, Centroids):
        yield centroids
        return
    n = centroids.count()
    parts = max(1, math.ceil(n * dim * 8 / BROADCAST_BYTES))
    for part in range(parts):
        yield Centroids(centroids if parts == 1 else centroids.where(F.pmod(F.xxhash64("bucket_id"), F.lit(parts)) == part), dim)


def place(rows: DataFrame, centroids: DataFrame | Centroids, dim: int, metric: str | Metric = Metric.L2, apart: int | None = None) -> DataFrame:
    """rows (embedding, ...) with bucket_id and distance: each row's nearest bucket, the smaller id on ties, never `apart`.

    A bucket_id that rows have is replaced. Without centroids every row goes to BOOTSTRAP_BUCKET.
    """
    metric = Metric.parse(metric)
    out = rows.drop("bucket_id", "distance")
    names = [*out.columns, "bucket_id", "distance"]
    schema = T.StructType([*out.schema.fields, T.StructField("bucket_id", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    for known in blocks(centroids, dim):
        send, first = known.send(rows), "bucket_id" not in out.columns

        def run(batches: Iterator[pa.RecordBatch], send=send, first=first) -> Iterator[pa.RecordBatch]:
            ids, points, _ = send.value
            keep = ids != apart if apart is not None else np.ones(len(ids), bool)
            ids, points = ids[keep], points[keep]
            for batch in batches:
                n = batch.num_rows
                to, away = np.full(n, BOOTSTRAP_BUCKET), np.full(n, np.inf)
                if not first:  # what the blocks before have found
                    to, away = batch.column("bucket_id").to_numpy().copy(), batch.column("distance").to_numpy().copy()
                step = max(1, CELLS // max(len(ids), 1))
                x = matrix(batch.column("embedding"), dim) if len(ids) else None
                for a in range(0, n if len(ids) else 0, step):
                    scores = block_scores(metric, x[a : a + step], points)
                    at = scores.argmin(axis=1)
                    best, bucket = scores[np.arange(len(at)), at], ids[at]
                    nearer = (best < away[a : a + step]) | ((best == away[a : a + step]) & (bucket < to[a : a + step]))
                    to[a : a + step] = np.where(nearer, bucket, to[a : a + step])
                    away[a : a + step] = np.where(nearer, best, away[a : a + step])
                columns = batch.columns if first else batch.columns[:-2]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(to.astype(np.int32)), pa.array(away)], names)

        out = out.mapInArrow(run, schema)
    # Nothing was compared where there are no centroids (or only the one apart).
    return out.withColumn("distance", F.when(F.col("distance") == F.lit(float("inf")), F.lit(0.0)).otherwise(F.col("distance")))


def assign(rows: DataFrame, centroids: DataFrame | Centroids, dim: int, metric: str | Metric = Metric.L2, apart: int | None = None) -> DataFrame:
    """(id, bucket_id, distance) of place()."""
    return place(rows.select("id", "embedding"), centroids, dim, metric, apart).select("id", "bucket_id", "distance")


def select_buckets(queries: DataFrame | Queries, centroids: DataFrame | Centroids, dim: int, metric: str | Metric = Metric.L2, target: float = TARGET, decay: float = DECAY, density: float = DENSITY) -> DataFrame | tuple[np.ndarray, np.ndarray]:
    """(query_id, bucket_id, place, near, share): the buckets a query should look into.

    A bucket scores exp(-decay * distance) * (1 - exp(-n / density)). In order of score, buckets are taken until
    their share of all scores reaches `target`; the GUARDRAIL nearest are taken in any case; if all scores together
    are FLOOR or less, all buckets are. place and near rank by score and by distance, from 1.

    For gathered queries and few scores the answer is arrays (query ids, bucket ids), without a job.
    """
    if density <= 0 or not 0 < target <= 1 or decay < 0:
        raise ValueError("density must be positive, target in (0, 1], decay not negative")
    metric, parts = Metric.parse(metric), blocks(centroids, dim)
    known, more = next(parts), next(parts, None)
    if isinstance(queries, Queries):
        if more is None and len(queries.ids) * len(known.ids) <= CELLS:
            q, b, *_ = _taken(queries.x, known.ids, known.points, known.n, metric, target, decay, density)
            return queries.ids[q], known.ids[b]
        queries = queries.frame(centroids.sparkSession if isinstance(centroids, DataFrame) else SparkSession.active())
    if more is not None:
        return _select_in_parts(queries, chain([known, more], parts), dim, metric, target, decay, density)
    send = known.send(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = send.value
        step = max(1, CELLS // max(len(ids), 1))
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            q, b, place, near, share = _taken(matrix(batch.column("embedding"), dim), ids, points, n, metric, target, decay, density)
            arrays = [batch.column("query_id").take(pa.array(q)), pa.array(ids[b].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(share)]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "bucket_id", "place", "near", "share"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "embedding").mapInArrow(run, f"query_id {kind}, bucket_id int, place int, near int, share double")


def _taken(x: np.ndarray, ids: np.ndarray, points: np.ndarray, n: np.ndarray, metric: Metric, target: float, decay: float, density: float) -> tuple[np.ndarray, ...]:
    """(query, bucket, place, near, share) of what is taken, queries and buckets by their places."""
    distance, score = _scored(metric, x, points, n, decay, density)
    tie = np.broadcast_to(ids, score.shape)
    by_score, by_distance = np.lexsort((tie, -score), axis=1), np.lexsort((tie, distance), axis=1)
    place, near = (np.empty_like(by_score) for _ in range(2))
    steps = np.broadcast_to(np.arange(1, len(ids) + 1), score.shape)
    np.put_along_axis(place, by_score, steps, axis=1)
    np.put_along_axis(near, by_distance, steps, axis=1)
    total = score.sum(axis=1, keepdims=True)
    share = np.where(total > FLOOR, score / np.maximum(total, FLOOR), 0.0)
    ordered = np.take_along_axis(share, by_score, axis=1)
    before = np.empty_like(share)
    np.put_along_axis(before, by_score, ordered.cumsum(axis=1) - ordered, axis=1)
    q, b = np.nonzero((before < target) | (place == 1) | (near <= GUARDRAIL) | (total <= FLOOR))
    return q, b, place[q, b], near[q, b], share[q, b]


def _scored(metric: Metric, queries: np.ndarray, points: np.ndarray, n: np.ndarray, decay: float, density: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances and scores (queries, buckets)."""
    distance = block_scores(metric, queries, points)
    if metric is Metric.L2:
        distance = np.round(np.sqrt(distance), 9)
    return distance, np.exp(-decay * distance) * (1 - np.exp(-n / density))[None, :]


def _select_in_parts(queries: DataFrame, parts: Iterable[Centroids], dim: int, metric: Metric, target: float, decay: float, density: float) -> DataFrame:
    """select_buckets() where centroids come in parts: all scores as rows, ranked by windows over a query's buckets."""
    kind = queries.schema["query_id"].dataType.simpleString()
    out = None
    for known in parts:
        send = known.send(queries)

        def run(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            ids, points, n = send.value
            step = max(1, CELLS // max(len(ids), 1))
            for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
                distance, score = _scored(metric, matrix(batch.column("embedding"), dim), points, n, decay, density)
                who = batch.column("query_id").take(pa.array(np.repeat(np.arange(batch.num_rows), len(ids))))
                yield pa.RecordBatch.from_arrays([who, pa.array(np.tile(ids, batch.num_rows).astype(np.int32)), pa.array(distance.ravel()), pa.array(score.ravel())], ["query_id", "bucket_id", "distance", "score"])

        one = queries.select("query_id", "embedding").mapInArrow(run, f"query_id {kind}, bucket_id int, distance double, score double")
        out = one if out is None else out.union(one)
    by_score, by_distance = (Window.partitionBy("query_id").orderBy(o, "bucket_id") for o in (F.desc("score"), F.asc("distance")))
    out = out.select("query_id", "bucket_id", "score", F.row_number().over(by_score).alias("place"), F.row_number().over(by_distance).alias("near"), F.sum("score").over(Window.partitionBy("query_id")).alias("total"), F.coalesce(F.sum("score").over(by_score.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    share = F.when(F.col("total") > FLOOR, F.col("score") / F.col("total")).otherwise(F.lit(0.0))
    taken = (F.col("before") < target * F.col("total")) | (F.col("place") == 1) | (F.col("near") <= GUARDRAIL) | (F.col("total") <= FLOOR)
    return out.where(taken).select("query_id", "bucket_id", "place", "near", share.alias("share"))
