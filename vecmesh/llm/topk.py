"""Exact top-k inner-product search with paged M-trees, best first.

Integer vectors are lifted by one coordinate so that all of a tree have one norm; then the largest inner product is
the least Euclidean distance, a metric. Each block of rows gets a tree of pages: an inner page has routing objects
with covering radii and distances to the parent's routing object, a leaf page has vectors with theirs. A search
takes the page with the least possible distance first and leaves out every distance that the stored ones rule out
by the triangle inequality. Scores themselves are exact integers.

Both sides are stored tables: trees with their pages, radii and distances to parents, and blocks of queries. Trees
are dealt into groups; every query block goes to every group, where a task holds one group's trees and reads the
blocks one after the other. A query's k-th best score over a bounded sample is a lower bound that each group starts
from, so groups return few candidates that can't be in the result.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, sampled, stored

TREE_ROWS = 8192
PAGE = 128
FANOUT = 32
#: Queries about as many as a block has, and bytes of trees that a task holds at once.
QUERY_BLOCK, GROUP_BYTES = 4096, 64 << 20
SAMPLE_ROWS = 8192
SCALE = 1024
#: Above this the sums of products may not fit a double exactly; exact Python integers take over.
EXACT = 2.0**52


def padded(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, shorter ones padded with zeros, and which hold finite numbers only."""
    sizes = np.array([-1 if s is None else s for s in pc.list_value_length(column).to_pylist()], np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    if len(values) and (sizes == dim).all():
        rows = values.reshape(len(column), dim)
    else:
        rows, starts = np.zeros((len(column), dim)), np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        for i, n in enumerate(sizes):
            if n > 0:
                rows[i, :n] = values[starts[i] : starts[i] + n]
    return rows, np.isfinite(rows).all(axis=1) & (sizes >= 0)


def scaled(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of each vector as doubles, and which rows take part."""
    rows, keep = padded(column, dim)
    with np.errstate(all="ignore"):
        return np.floor(np.where(keep[:, None], rows, 0.0) * SCALE), keep


class MTree:
    """A tree over integer-valued rows `x` (n, dim) with ids, as arrays: page p has entries start[p] to start[p + 1].

    An entry's `object` is a row; in an inner page it is the routing object of the page `child`, whose rows all lie
    within `radius` of it. `parent` is an entry's distance to its own page's routing object; that of page 0 is `root`.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self._lift()
        pages: list[tuple | None] = []
        self.root = self._centre(np.arange(len(x))) if len(x) else 0
        self._page(pages, np.arange(len(x)), self.root)
        self.start = np.cumsum([0, *(len(p[0]) for p in pages)])
        self.object, self.child, self.radius, self.parent = (np.concatenate(c) for c in zip(*pages))

    def _lift(self) -> None:
        norms = (self.x * self.x).sum(axis=1)
        self.norm = float(norms.max(initial=0.0))
        self.lifted = np.column_stack([self.x, np.sqrt(np.maximum(self.norm - norms, 0.0))])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        rows = self.x.astype(np.int32) if np.abs(self.x).max(initial=0) < 2**31 else self.x
        np.savez(out, ids=self.ids, x=rows, root=self.root, **{c: getattr(self, c) for c in ("start", "object", "child", "radius", "parent")})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, stored_tree: bytes) -> MTree:
        tree = cls.__new__(cls)
        for name, value in np.load(io.BytesIO(stored_tree)).items():
            setattr(tree, name, value)
        tree.x, tree.root = tree.x.astype(float), int(tree.root)
        tree._lift()
        return tree

    def _to(self, rows: np.ndarray, point: int) -> np.ndarray:
        return np.sqrt(((self.lifted[rows] - self.lifted[point]) ** 2).sum(axis=1))

    def _centre(self, rows: np.ndarray) -> int:
        some = self.lifted[rows]
        return int(rows[((some - some.mean(axis=0)) ** 2).sum(axis=1).argmin()])

    def _page(self, pages: list, rows: np.ndarray, centre: int) -> int:
        me = len(pages)
        pages.append(None)
        if len(rows) <= PAGE:
            none = np.full(len(rows), -1)
            pages[me] = rows, none, none.astype(float), self._to(rows, centre) if len(rows) else np.zeros(0)
            return me
        k = min(FANOUT, math.ceil(len(rows) / PAGE * 2))
        seeds = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
        near = (-2 * self.lifted[rows] @ self.lifted[seeds].T + (self.lifted[seeds] ** 2).sum(axis=1)).argmin(axis=1)
        parts = [rows[near == j] for j in range(k)]
        if max(map(len, parts)) > 0.9 * len(rows):  # mostly copies: cut by position
            parts = np.array_split(rows, k)
        parts = [p for p in parts if len(p)]
        centres = np.array([self._centre(p) for p in parts])
        radii = np.array([self._to(p, c).max() for p, c in zip(parts, centres)])
        pages[me] = centres, np.array([self._page(pages, p, c) for p, c in zip(parts, centres)]), radii, self._to(centres, centre)
        return me

    def search(self, query: np.ndarray, own, k: int, floor: float, best: list[tuple[float, float]]) -> None:
        """Update `best`, a heap of (score, -id) with k entries at most, by rows that score `floor` or more."""
        point = np.append(query, 0.0)
        base = float(query @ query) + self.norm
        slack = 1e-9 * base + 1e-6

        def limit() -> float:  # a distance beyond which no row can enter
            worst = best[0][0] if len(best) == k else floor
            return math.inf if worst == -math.inf else math.sqrt(max(base - 2 * worst + slack, 0.0))

        queue = [(0.0, 0, float(np.sqrt(((self.lifted[self.root] - point) ** 2).sum())))]
        while queue:
            least, page, to_parent = heapq.heappop(queue)
            most = limit()
            if least > most:
                return
            own_part = slice(self.start[page], self.start[page + 1])
            rows, child, radius = self.object[own_part], self.child[own_part], self.radius[own_part]
            gap = np.abs(to_parent - self.parent[own_part])
            if len(rows) and child[0] >= 0:
                near = np.flatnonzero(gap - radius <= most)
                away = np.sqrt(((self.lifted[rows[near]] - point) ** 2).sum(axis=1))
                low = np.maximum(away - radius[near], 0.0)
                for j in np.flatnonzero(low <= most):
                    heapq.heappush(queue, (float(low[j]), int(child[near[j]]), float(away[j])))
                continue
            near = rows[gap <= most]
            scores = self.x[near] @ query
            worst = best[0][0] if len(best) == k else floor
            for j in np.flatnonzero(scores >= worst):
                if self.ids[near[j]] == own:
                    continue
                entry = (float(scores[j]), -int(self.ids[near[j]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _exact(query: np.ndarray, own, ids: np.ndarray, x: np.ndarray, k: int, best: list) -> None:
    """The same update by Python integers, for numbers too large for doubles; scores are cut off at a long's range."""
    q = [int(v) for v in query]
    for i, row in zip(ids, x):
        if i != own:
            score = max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(q, row))))
            if len(best) < k:
                heapq.heappush(best, (score, -int(i)))
            elif (score, -int(i)) > best[0]:
                heapq.heapreplace(best, (score, -int(i)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): each query's k best rows of vectors, ties to the smaller id.

    queries has rows of the same form. A row never answers the query of its own id. Vectors that are null or hold a
    null or non-finite component take no part, nor do null ids; shorter ones count as padded with zeros. Repeated
    rows answer as often as they stand, a repeated query counts once, by its least vector. An empty side gives an
    empty result.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    found = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    asking = asked.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim, n = max(found["dim"] or 0, asking["dim"] or 0, 1), found["n"]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(ids: list, xs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([MTree(np.concatenate(ids), np.concatenate(xs)).to_bytes()], pa.binary())], ["blob"])

        ids, xs, held = [], [], 0
        for batch in batches:
            x, keep = scaled(batch.column("v"), dim)
            own = batch.column("id").to_numpy(zero_copy_only=False)[keep]
            x = x[keep]
            while len(x):
                take = TREE_ROWS - held
                ids.append(own[:take]), xs.append(x[:take])
                held, own, x = held + len(ids[-1]), own[take:], x[take:]
                if held >= TREE_ROWS:
                    yield tree(ids, xs)
                    ids, xs, held = [], [], 0
        if held:
            yield tree(ids, xs)

    trees = stored(mapped(rows, grow, "blob binary").withColumn("tree", F.monotonically_increasing_id()), "trees")
    sample = rows.where(sampled(SAMPLE_ROWS / max(n, 1), "id")).limit(2 * SAMPLE_ROWS).toArrow()
    sx, keep = scaled(sample.column("v").combine_chunks(), dim) if sample.num_rows else (np.zeros((0, dim)), np.zeros(0, bool))
    send = spark.sparkContext.broadcast((sample.column("id").to_numpy()[keep] if sample.num_rows else np.zeros(0, np.int64), sx[keep]))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(math.ceil(asking["n"] / QUERY_BLOCK) or 1).cast("long")))
    blocks = stored(mapped(blocks.repartition("block").sortWithinPartitions("block"), _blocks(send, dim, k), "block long, blob binary"), "queries")
    # A group has few trees while there are few, so that all cores have some, and what fits a task later on.
    most = max(1, GROUP_BYTES // (TREE_ROWS * dim * 16))
    n_trees = trees.count()
    groups = math.ceil(n_trees / max(1, min(most, n_trees // (4 * spark.sparkContext.defaultParallelism)))) or 1
    own = trees.select(F.pmod(F.xxhash64("tree"), F.lit(groups).cast("long")).alias("g"), F.lit(-1).cast("long").alias("block"), "blob")
    sent = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "block", "blob")
    both = own.union(sent).repartition("g").sortWithinPartitions("g", "block")
    out = mapped(both, _searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(send, dim: int, k: int):
    """Over queries (id, v, block) sorted by block: blocks of ids, scaled vectors and lower bounds of the k-th best score."""

    def made(block: int, ids: list, xs: list) -> tuple[int, bytes]:
        sample_ids, sx = send.value
        qid, qx = np.concatenate(ids), np.concatenate(xs)
        floors = np.full(len(qx), -np.inf)
        if len(sx) > k and max(np.abs(sx).max(initial=0), np.abs(qx).max(initial=0)) ** 2 * dim < EXACT:
            for at in range(0, len(qx), 256):
                scores = qx[at : at + 256] @ sx.T
                scores[qid[at : at + 256, None] == sample_ids[None, :]] = -np.inf
                floors[at : at + 256] = np.partition(scores, -k, axis=1)[:, -k]
        out = io.BytesIO()
        np.savez(out, ids=qid, x=qx, floors=floors)
        return block, out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs = None, [], []
        for batch in batches:
            x, keep = scaled(batch.column("v"), dim)
            names, blocks = batch.column("id").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != key and ids:
                    yield batch_of(made(key, ids, xs))
                    ids, xs = [], []
                key = int(blocks[a])
                ids.append(names[a:b][keep[a:b]]), xs.append(x[a:b][keep[a:b]])
        if ids:
            yield batch_of(made(key, ids, xs))

    def batch_of(row: tuple[int, bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.binary())], ["block", "blob"])

    return run


def _searcher(k: int):
    """Over rows (g, block, blob) sorted so that a group's trees come before the query blocks: each query's best of the group."""

    def asked(trees: list[MTree], queries) -> Iterator[pa.RecordBatch]:
        qid, qx, floors = (queries[c] for c in ("ids", "x", "floors"))
        best: list[list] = [[] for _ in qid]
        for tree in trees:
            large = max(np.abs(tree.x).max(initial=0), np.abs(qx).max(initial=0)) ** 2 * max(tree.x.shape[1], 1) >= EXACT
            for i, query in enumerate(qx):
                if large:
                    _exact(query, qid[i], tree.ids, tree.x, k, best[i])
                else:
                    tree.search(query, qid[i], k, floors[i], best[i])
        rows = [(int(qid[i]), -e[1], int(e[0])) for i, heap in enumerate(best) for e in heap]
        for at in range(0, len(rows), 10_000):
            q, v, s = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees = None, []
        for batch in batches:
            for g, block, blob in zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), batch.column("blob")):
                if g != group:
                    group, trees = g, []
                if block < 0:
                    trees.append(MTree.from_bytes(blob.as_py()))
                elif trees:
                    yield from asked(trees, np.load(io.BytesIO(blob.as_py())))

    return run
