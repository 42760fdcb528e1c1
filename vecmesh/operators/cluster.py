"""K-means as rounds of an assignment scan with per-task partial sums, in mini-batches, and splits of one bucket."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import group_sums, matrix, vectors
from ..functions.metrics import EPSILON, Metric, block_scores

ROUNDS = 15
TOLERANCE = 1e-4
SEED_POOL = 50_000
#: Split rules: least rows, least score between the halves, how much nearer a defector's other bucket must be.
SPLIT_ROWS, SINGULAR, HYSTERESIS = 50, 0.01, 0.90
#: The other way to split: least rows, and the share of them that may go to other buckets.
VARIANT_ROWS, LOOPBACK = 10, 0.2


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at unit length; zeros where the squared norm is within the float epsilon of 0."""
    norm = (rows**2).sum(axis=1, keepdims=True)
    return np.where(norm <= EPSILON, 0.0, rows / np.sqrt(np.maximum(norm, EPSILON)))


def seeds(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ from a sample; repeats a point where fewer than k differ."""
    chosen = [sample[rng.integers(len(sample))]]
    away = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        weight = away / away.sum() if away.sum() > 0 else np.full(len(sample), 1 / len(sample))
        chosen.append(sample[rng.choice(len(sample), p=weight)])
        away = np.minimum(away, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _streamed(centres: np.ndarray, seen: np.ndarray, total: np.ndarray, n: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Centres as means of all they have seen, after sums and counts of one more batch; and how many that is."""
    after = seen + n
    new = np.where(n[:, None] > 0, (centres * seen[:, None] + total) / np.maximum(after, 1)[:, None], centres)
    return unit(new) if metric is Metric.COSINE else new, after


def gathered(sums: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """step_sums() as arrays (k, dim) and (k,)."""
    table, total, n = sums.toArrow(), np.zeros((k, dim)), np.zeros(k)
    cluster = table.column("cluster").to_numpy()
    total[cluster, table.column("pos").to_numpy()] = table.column("total").to_numpy()
    n[cluster] = table.column("n").to_numpy()
    return total, n


def mini_batches(batches: Iterable[DataFrame], init: np.ndarray, metric: str | Metric = Metric.L2) -> np.ndarray:
    """Centres after one streaming-mean update for each batch of rows (embedding); a batch without rows changes nothing."""
    metric, centres = Metric.parse(metric), np.array(init, float)
    seen = np.zeros(len(centres))
    for batch in batches:
        total, n = gathered(step_sums(batch, centres, metric), *centres.shape)
        centres, seen = _streamed(centres, seen, total, n, metric)
    return centres


def step_sums(rows: DataFrame, centres: np.ndarray, metric: str | Metric = Metric.L2) -> DataFrame:
    """(cluster, pos, total, n): sums of the rows (embedding) nearest to each centre, combined within tasks."""
    metric, dim = Metric.parse(metric), centres.shape[1]
    send = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = send.value
        sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            x = unit(x) if metric is Metric.COSINE else x
            near = block_scores(metric, x, centres).argmin(axis=1)
            counts += np.bincount(near, minlength=len(centres))
            sums += group_sums(x, near, len(centres))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), vectors(sums[used]), pa.array(counts[used])], ["cluster", "sums", "n"])

    parts = rows.select("embedding").mapInArrow(run, "cluster int, sums array<double>, n long")
    return parts.select("cluster", "n", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def kmeans(rows: DataFrame, k: int, dim: int, metric: str | Metric = Metric.L2, rounds: int = ROUNDS, tolerance: float = TOLERANCE, init: np.ndarray | None = None, update: str = "lloyd", seed: int = 0, batch: int | None = None) -> np.ndarray:
    """k centres (k, dim). update: "lloyd" takes each round's means, "streaming_mean" the running means over rounds.

    A round gathers k x dim sums. An empty cluster keeps its centre. Without init, k-means++ over at most
    SEED_POOL sampled rows. With `batch`, each round looks at so many sampled rows alone and moves the running
    means; all rounds' rows are one sample of rounds x batch rows, so rows are read once.
    """
    metric = Metric.parse(metric)
    if k < 1 or update not in ("lloyd", "streaming_mean"):
        raise ValueError("k must be 1 or more, update lloyd or streaming_mean")
    if init is None:
        n = rows.count()
        if not n:
            raise ValueError("k-means needs at least one row")
        pool = rows.select("embedding").sample(min(1.0, SEED_POOL / n), seed).limit(SEED_POOL) if n > SEED_POOL else rows.select("embedding")
        sample = matrix(pool.toArrow().column("embedding"), dim)
        init = seeds(unit(sample) if metric is Metric.COSINE else sample, k, np.random.default_rng(seed))
    centres, seen = np.array(init, float), np.zeros(len(init))
    if batch:
        return _sampled_batches(rows, centres, dim, metric, rounds, tolerance, batch, seed)
    for _ in range(rounds):
        total, n = gathered(step_sums(rows, centres, metric), k, dim)
        if update == "streaming_mean":
            total, n = total + centres * seen[:, None], n + seen
            seen = n
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        new = unit(new) if metric is Metric.COSINE else new
        moved = ((new - centres) ** 2).sum(axis=1).max()
        centres = new
        if moved < tolerance:
            break
    return centres


def _sampled_batches(rows: DataFrame, centres: np.ndarray, dim: int, metric: Metric, rounds: int, tolerance: float, batch: int, seed: int) -> np.ndarray:
    n, rng = rows.count(), np.random.default_rng(seed)
    wanted = rounds * batch
    some = rows.select("embedding").sample(min(1.0, 1.2 * wanted / max(n, 1)), seed).limit(wanted) if n > wanted else rows.select("embedding")
    pool, seen = matrix(some.toArrow().column("embedding"), dim), np.zeros(len(centres))
    pool = unit(pool) if metric is Metric.COSINE else pool
    for _ in range(rounds if len(pool) else 0):
        x = pool[rng.integers(len(pool), size=batch)] if len(pool) > batch else pool
        near = block_scores(metric, x, centres).argmin(axis=1)
        new, seen = _streamed(centres, seen, group_sums(x, near, len(centres)), np.bincount(near, minlength=len(centres)), metric)
        moved, centres = ((new - centres) ** 2).sum(axis=1).max(), new
        if moved < tolerance:
            break
    return centres


def split_rows(x: np.ndarray, halves: np.ndarray, others: np.ndarray, metric: str | Metric = Metric.L2) -> tuple[np.ndarray, np.ndarray]:
    """(half, defects) of each row: its nearer half, and whether another bucket's centroid is much nearer."""
    local = block_scores(metric, x, halves)
    half = local.argmin(axis=1)
    own = local[np.arange(len(x)), half]
    best = block_scores(metric, x, others).min(axis=1) if len(others) else np.full(len(x), np.inf)
    return half, best < own * HYSTERESIS


def two_means(x: np.ndarray, metric: str | Metric = Metric.L2, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Two centres of one bucket's rows, which its capacity bounds."""
    metric = Metric.parse(metric)
    x = unit(x) if metric is Metric.COSINE else x
    centres = seeds(x, 2, np.random.default_rng(seed))
    for _ in range(rounds):
        near = block_scores(metric, x, centres).argmin(axis=1)
        new = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(2)])
        new = unit(new) if metric is Metric.COSINE else new
        if ((new - centres) ** 2).sum(axis=1).max() < TOLERANCE:
            return new
        centres = new
    return centres


def divided(rows: DataFrame, halves: np.ndarray, others: np.ndarray, metric: str | Metric = Metric.L2) -> DataFrame:
    """rows (embedding, ...) of a bucket under split with half and defects, in place of columns of these names."""
    send, rows = rows.sparkSession.sparkContext.broadcast((halves, others)), rows.drop("half", "defects")
    names = [*rows.columns, "half", "defects"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, others = send.value
        for batch in batches:
            half, out = split_rows(matrix(batch.column("embedding"), halves.shape[1]), halves, others, metric)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(half.astype(np.int32)), pa.array(out)], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("half", T.IntegerType()), T.StructField("defects", T.BooleanType())]))


def defectors(rows: DataFrame, halves: np.ndarray, others: np.ndarray, metric: str | Metric = Metric.L2) -> DataFrame:
    """(id, half, defects) for rows (id, embedding) of a bucket under split."""
    return divided(rows.select("id", "embedding"), halves, others, metric).select("id", "half", "defects")


def capped(moved: DataFrame, share: float = LOOPBACK) -> DataFrame:
    """moved (id, half, defects) with at most that share of all rows as defectors, the smallest ids first; the others stay.

    One bucket's rows, which its capacity bounds.
    """
    order = Window.partitionBy("defects").orderBy("id")
    most = F.floor(F.count("*").over(Window.partitionBy()) * F.lit(share) + 1e-9)
    return moved.withColumn("defects", F.col("defects") & (F.row_number().over(order) <= most)).select("id", "half", "defects")


def half_means(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """(half, pos, n, mean) of what stays of rows (id, embedding) after moved (id, half, defects)."""
    flat = rows.join(moved.where("not defects"), "id").select("half", F.posexplode("embedding").alias("pos", "x"))
    return flat.groupBy("half", "pos").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("mean"))
