"""k-nearest-neighbour search: exact, over selected buckets, and in two stages over codes.

Queries go to the rows in broadcast blocks of at most QUERY_BLOCK. A task keeps each query's best k over all it
reads, so what is exchanged is tasks x queries x k small rows, whatever the number of vectors. Routes are kept as
(query, bucket) pairs: a bucket's rows are scored for the queries that ask for it alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sq8
from ..functions.arrow import Queries, matrix
from ..functions.metrics import Metric, block_scores, score

QUERY_BLOCK = 4096
#: Scores that a step holds at once, and (query, bucket) pairs that are broadcast at once.
SCAN_CELLS, ROUTE_PAIRS = 1 << 21, 1 << 22
#: Bytes of quantisers that are broadcast; beyond that they are joined to the codes.
BROADCAST_BYTES = 256 << 20
#: Candidates for each result of a two-stage search, and how many of them are gathered to find their files.
OVERSAMPLE, GATHERED = 3, 1 << 20

Asking = DataFrame | Queries
Routes = DataFrame | Callable[[Asking], DataFrame | tuple[np.ndarray, np.ndarray]] | None


class Best:
    """The k best (query, score, id) seen so far, ties to the smaller id; each with the bucket it came from."""

    def __init__(self, k: int):
        self.k = k
        self.q, self.s, self.i, self.b = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None, bucket: int = 0) -> None:
        """scores: (queries, rows); queries are the places of those that ask, all of them by default."""
        if not scores.size:
            return
        last = np.partition(scores, min(self.k, scores.shape[1]) - 1, axis=1)[:, min(self.k, scores.shape[1]) - 1]
        q, j = np.nonzero((scores <= last[:, None]) & np.isfinite(scores))
        s = scores[q, j]
        q = q if queries is None else queries[q]
        q, s, i, b = np.append(self.q, q), np.append(self.s, s), np.append(self.i, ids[j]), np.append(self.b, np.full(len(j), bucket))
        order = np.lexsort((i, s, q))
        q, s, i, b = q[order], s[order], i[order], b[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.s, self.i, self.b = q[keep], s[keep], i[keep], b[keep]


def gathered(queries: Asking, dim: int) -> Asking:
    """The queries on the driver if they are one block."""
    return queries if isinstance(queries, Queries) else Queries.few(queries, dim, QUERY_BLOCK) or queries


def _blocks(queries: Asking, dim: int) -> Iterator[tuple[Queries, Asking, Column | None]]:
    """Blocks of about QUERY_BLOCK queries, each gathered on its own; each as a table as well, and which query_id it has."""
    queries = gathered(queries, dim)
    if isinstance(queries, Queries):
        yield queries, queries, None
        return
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    parts = math.ceil(queries.count() / QUERY_BLOCK)
    for part in range(parts):
        mine = F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(parts)) == part
        yield Queries.of(queries.where(mine).toArrow(), dim), queries.where(mine), mine


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of several results' rows (query_id, rank, id, score)."""
    return _ranked(found.drop("rank"), k).select(*_COLUMNS)


class Asked:
    """Which queries of a block ask for which bucket."""

    def __init__(self, queries: np.ndarray, buckets: np.ndarray):
        order = np.lexsort((queries, buckets))
        self.queries = queries[order]
        self.buckets, self.first = np.unique(buckets[order], return_index=True)

    def of(self, bucket: int) -> np.ndarray:
        at = int(np.searchsorted(self.buckets, bucket))
        if at == len(self.buckets) or self.buckets[at] != bucket:
            return self.queries[:0]
        return self.queries[self.first[at] : self.first[at + 1] if at + 1 < len(self.first) else None]


def _routed(routes: Routes, asking: Asking, ids: np.ndarray, mine: Column | None) -> list[tuple[np.ndarray, Asked | None]]:
    """A block's queries, cut so that none of its parts has many more than ROUTE_PAIRS pairs, and what they ask for."""
    if routes is None:
        return [(np.arange(len(ids)), None)]
    found = routes(asking) if callable(routes) else routes if mine is None else routes.where(mine)
    if isinstance(found, DataFrame):
        pairs = found.select(F.col("query_id").cast("long").alias("query_id"), F.col("bucket_id").cast("long").alias("bucket_id")).toArrow()
        found = pairs.column("query_id").to_numpy(), pairs.column("bucket_id").to_numpy()
    q, b = found
    if hasattr(routes, "seen"):
        routes.seen(np.unique(b).tolist())
    order = ids.argsort(kind="stable")
    at = np.searchsorted(ids[order], q)
    known = at < len(ids)
    known[known] = ids[order][at[known]] == q[known]
    q, b = order[at[known]], b[known]
    out = []
    for part in np.array_split(np.arange(len(ids)), max(1, min(len(ids), math.ceil(len(q) / ROUTE_PAIRS)))):
        inside = (q >= part[0]) & (q <= part[-1]) if len(part) else np.zeros(len(q), bool)
        out.append((part, Asked(q[inside] - (part[0] if len(part) else 0), b[inside])))
    return out


def _scan(rows: DataFrame, queries: Asking, k: int, dim: int, routes: Routes, scorer: Callable[[pa.RecordBatch, np.ndarray, int], np.ndarray]) -> DataFrame:
    """Top k of `rows` for each query; with routes (query_id, bucket_id), of a query's own buckets only.

    routes may be a function that gives them for some of the queries. Rows with a bucket_id are scored bucket by
    bucket, and the results say which one they came from.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark, out, apart = rows.sparkSession, None, "bucket_id" in rows.columns
    for whole, asking, mine in _blocks(queries, dim):
        for part, asked in _routed(routes, asking, whole.ids, mine):
            source = rows
            if asked is not None:
                source = rows.where(F.col("bucket_id").isin([int(b) for b in asked.buckets]))  # prunes the partitions no query asks for
            send = spark.sparkContext.broadcast((whole.ids[part], whole.x[part], asked))

            def run(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
                ids, block, asked = send.value
                best, everyone = Best(k), np.arange(len(ids))
                for batch in batches:
                    order, cuts, buckets = None, [0, batch.num_rows], [0]
                    if apart:
                        own = batch.column("bucket_id").to_numpy(zero_copy_only=False)
                        order = own.argsort(kind="stable")
                        buckets, cuts = np.unique(own[order], return_index=True)
                        cuts = [*cuts.tolist(), batch.num_rows]
                    for n, bucket in enumerate(buckets):
                        who = everyone if asked is None else asked.of(int(bucket))
                        if not len(who):
                            continue
                        step = max(1, SCAN_CELLS // len(who))
                        for a in range(cuts[n], cuts[n + 1], step):
                            b = min(a + step, cuts[n + 1])
                            part = batch.slice(a, b - a) if order is None or len(buckets) == 1 else batch.take(pa.array(order[a:b]))
                            best.add(scorer(part, block[who], int(bucket)), part.column("id").to_numpy(), who, int(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.i), pa.array(best.s), pa.array(best.b)], ["query_id", "id", "score", "bucket_id"])

            one = source.mapInArrow(run, "query_id long, id long, score double, bucket_id long")
            out = one if out is None else out.union(one)
    return _ranked(out, k)


_COLUMNS = ("query_id", "rank", "id", "score")


def knn(rows: DataFrame, queries: Asking, k: int, dim: int, metric: str | Metric = Metric.L2, routes: Routes = None) -> DataFrame:
    """(query_id, rank, id, score): exact k nearest of rows (id, embedding[, bucket_id]) to queries (query_id, embedding)."""
    columns = ["id", "embedding"] + ["bucket_id"] * (routes is not None)
    return _scan(rows.select(*columns), queries, k, dim, routes, lambda part, block, _: block_scores(metric, block, matrix(part.column("embedding"), dim))).select(*_COLUMNS)


def within(rows: DataFrame, queries: Asking, radius: float, dim: int, metric: str | Metric = Metric.L2) -> DataFrame:
    """(query_id, rank, id, score): all rows (id, embedding) whose score is `radius` or less."""
    spark, out = rows.sparkSession, None
    for block, *_ in _blocks(queries, dim):
        send = spark.sparkContext.broadcast((block.ids, block.x))

        def run(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            ids, block = send.value
            step = max(1, SCAN_CELLS // max(len(ids), 1))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    scores = block_scores(metric, block, matrix(part.column("embedding"), dim))
                    q, i = np.nonzero(scores <= radius)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), part.column("id").take(pa.array(i)).cast(pa.int64()), pa.array(scores[q, i])], ["query_id", "id", "score"])

        one = rows.select("id", "embedding").mapInArrow(run, "query_id long, id long, score double")
        out = one if out is None else out.union(one)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).select(*_COLUMNS)


def _by_codes(coded: DataFrame, quantizers: DataFrame, queries: Asking, k: int, dim: int, metric: str | Metric, routes: Routes, tables: bool) -> DataFrame:
    """knn_codes() with the bucket of each result."""
    spark, metric = coded.sparkSession, Metric.parse(metric)
    rows, send = coded.select("id", "bucket_id", "codes"), None
    if quantizers.count() * dim * 16 <= BROADCAST_BYTES:
        table = quantizers.select("bucket_id", "low", "step").toArrow()
        send = spark.sparkContext.broadcast({b: (low, step) for b, low, step in zip(table.column("bucket_id").to_pylist(), matrix(table.column("low"), dim), matrix(table.column("step"), dim))})
    else:
        rows = rows.join(quantizers.select("bucket_id", "low", "step"), "bucket_id").select("id", "bucket_id", "codes", "low", "step")

    def scorer(part: pa.RecordBatch, block: np.ndarray, bucket: int) -> np.ndarray:
        codes = matrix(part.column("codes"), dim)
        low, step = send.value[bucket] if send is not None else (matrix(part.column(c).slice(0, 1), dim)[0] for c in ("low", "step"))
        if tables and metric is Metric.L2:
            return np.round(sq8.lookup_scores(block, low, step, codes.astype(np.int64)), 9)
        return block_scores(metric, block, low + codes * step)

    return _scan(rows, queries, k, dim, routes, scorer)


def knn_codes(coded: DataFrame, quantizers: DataFrame, queries: Asking, k: int, dim: int, metric: str | Metric = Metric.L2, routes: Routes = None, tables: bool = False) -> DataFrame:
    """The same by codes: coded (id, bucket_id, codes), quantizers (bucket_id, low, step), one row a bucket.

    Codes are decoded and compared as a block; with `tables`, each query looks its distances up in a table of the
    bucket's code values, which pays for a handful of queries.
    """
    return _by_codes(coded, quantizers, queries, k, dim, metric, routes, tables).select(*_COLUMNS)


def two_stage(coded: DataFrame, quantizers: DataFrame, rows: DataFrame, queries: Asking, k: int, dim: int, metric: str | Metric = Metric.L2, routes: Routes = None) -> DataFrame:
    """Candidates by codes, OVERSAMPLE * k a query, then exact scores of those rows alone.

    Up to GATHERED candidates are gathered and sent to the rows, of which only the candidates' buckets are read.
    """
    queries = gathered(queries, dim)
    near = _by_codes(coded, quantizers, queries, OVERSAMPLE * k, dim, metric, routes, False).select("query_id", "id", "bucket_id")
    return refine(near, rows, queries, k, metric, gather=(len(queries.ids) if isinstance(queries, Queries) else queries.count()) * OVERSAMPLE * k <= GATHERED)


def refine(candidates: DataFrame, rows: DataFrame, queries: Asking, k: int, metric: str | Metric = Metric.L2, gather: bool = False) -> DataFrame:
    """Exact top k of candidates (query_id, id[, bucket_id]); with bucket_id, of rows in these buckets.

    gather: there are few candidates; they are gathered, so that rows outside their buckets aren't read, and
    broadcast, so that vectors aren't exchanged.
    """
    asked = queries.frame(rows.sparkSession) if isinstance(queries, Queries) else queries
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("__q"))
    by = ["bucket_id", "id"] if "bucket_id" in candidates.columns else ["id"]
    rows = rows.select(*by, "embedding")
    if gather:
        found = candidates.toArrow()
        if "bucket_id" in by:
            rows = rows.where(F.col("bucket_id").isin(sorted(set(found.column("bucket_id").to_pylist()))))
        candidates = F.broadcast(rows.sparkSession.createDataFrame(found))
    joined = rows.join(candidates, by).join(asked, "query_id")
    return _ranked(joined.select("query_id", "id", F.round(score(metric, "__q", "embedding"), 9).alias("score")), k).select(*_COLUMNS)


def live(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """rows without deleted ids; Catalyst broadcasts the deletes where their size allows it."""
    return rows.join(deletes.select("id").distinct(), "id", "left_anti")


def newest(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each id, that of the highest seq: an aggregation that combines before the exchange."""
    others = [c for c in rows.columns if c not in ("id", seq)]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), seq).alias("__top"), F.max(seq).alias(seq)).select("id", seq, *(F.col(f"__top.{c}").alias(c) for c in others))


def unified(base: DataFrame, delta: DataFrame, deletes: DataFrame, queries: Asking, k: int, dim: int, metric: str | Metric = Metric.L2) -> DataFrame:
    """Search over both tiers as one table: the delta tier hides the base rows of its ids, deletes hide both.

    base and delta: (id, embedding); deletes (id, seq) hide rows with a smaller seq where rows have one, else all.
    """
    both = base.select("id", "embedding", F.lit(0).alias("seq")).unionByName(delta.select("id", "embedding", F.lit(1).alias("seq")))
    return knn(live(newest(both), deletes), queries, k, dim, metric)
