"""Embedding near-duplicates by product quantisation.

Equal vectors are one class from the start. Class representatives fall into coarse inverted lists and keep a code of
their residual in each subspace. Each one probes the lists whose border a similar vector may lie behind: a table of
distances between its residual and the codewords gives its distance to every code in a list by lookups; what the
code's own error can't rule out is compared exactly by cosine. Lists are cut into blocks of bounded size, so that a
hot list is many tasks.

How far a list's border is from a vector follows from its distances to both centres. A vector within `radius` lies
behind it surely not if that is more than the radius; in d dimensions a step of that length goes towards the border
by radius / sqrt(d) in the mean square, so lists within SPREAD times that are probed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, mapped, sampled, scratch, stored
from .topk import padded

THRESHOLD = 0.95
#: Lists and codewords are fitted on SAMPLE_ROWS rows, or ROWS_A_LIST for each list if that is more; every row is indexed.
SAMPLE_ROWS, ROWS_A_LIST = 8192, 8
LIST_ROWS = 400
MOST_LISTS = 8192
SPREAD = 2.0
#: Distances that a step holds at once.
CELLS = 1 << 20
WORDS = 128
SUBSPACE = 4
BLOCK = 2048
PAIRS = 100_000


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k distinct rows of x (fewer if it has fewer)."""
    start = np.unique(x, axis=0)
    centres = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    size, step = (centres**2).sum(axis=1), max(1, CELLS // max(len(centres), 1))
    return np.concatenate([(size - 2 * x[a : a + step] @ centres.T).argmin(axis=1) for a in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def probed(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's nearest centre, and all centres whose border with that one is within `reach`, itself included."""
    size, step = (centres**2).sum(axis=1), max(1, CELLS // max(len(centres), 1))
    homes, lists = [], []
    for a in range(0, len(x), step):
        d = size - 2 * x[a : a + step] @ centres.T
        home = d.argmin(axis=1)
        apart = np.sqrt(np.maximum(size + size[home][:, None] - 2 * centres[home] @ centres.T, 0.0))
        near = d - d[np.arange(len(d)), home][:, None] <= 2 * reach * apart
        near[np.arange(len(d)), home] = True
        homes.append(home)
        lists += [np.flatnonzero(row) for row in near]
    return np.concatenate(homes or [np.zeros(0, np.int64)]), lists


class Quantiser:
    """Coarse centres (lists) and codewords (subspaces, WORDS, SUBSPACE) of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres = kmeans(sample, max(1, min(lists, len(sample))), 6, rng)
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.words = [kmeans(residual[:, s : s + SUBSPACE], WORDS, 5, rng) for s in range(0, sample.shape[1], SUBSPACE)]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, subspaces) of the residuals to the home lists, and the distance of each row to its code."""
        residual = x - self.centres[home]
        codes = np.stack([nearest(residual[:, s * SUBSPACE : (s + 1) * SUBSPACE], w) for s, w in enumerate(self.words)], axis=1)
        back = np.concatenate([w[codes[:, s]] for s, w in enumerate(self.words)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(axis=1))

    def distances(self, x: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of rows x to codes of list `where`, by table lookup."""
        residual, out = x - self.centres[where], np.zeros((len(x), len(codes)))
        for s, w in enumerate(self.words):
            part = residual[:, s * SUBSPACE : (s + 1) * SUBSPACE]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ w.T + (w**2).sum(axis=1)
            out += table[:, codes[:, s]]
        return out


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows, keep = padded(column, dim)
    with np.errstate(all="ignore"):
        most = np.abs(rows).max(axis=1, initial=0)
        keep &= most > 0
        rows = np.where(keep[:, None], rows, 0.0) / np.where(keep, most, 1.0)[:, None]
        norm = np.sqrt((rows**2).sum(axis=1))
    return rows / np.where(keep, norm, 1.0)[:, None], keep


def links(vectors: DataFrame, threshold: float = THRESHOLD, spread: float = SPREAD, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row (vec_id, n_links, component_id, kept) for each row of vectors, whatever its other columns.

    n_links counts other rows whose cosine is `threshold` or more among those the probes meet; component_id is the
    least id linked directly or through others, kept says that it is the row's own. Vectors that are null, zero or
    hold a null or non-finite component link with nothing, nor do rows without an id; shorter ones count as padded
    with zeros. Repeated rows are rows of their own and link with each other. An empty table gives no rows. With a
    `spread` of sqrt(d) or more, no link is lost.
    """
    kept: list[DataFrame] = []
    with scratch(kept):
        marked, per_class = _labelled(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), threshold, spread)
        kept += [marked, per_class]
    component = F.coalesce("c", "id")
    out = marked.select("id", "mark").join(per_class, "mark", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _labelled(rows: DataFrame, threshold: float, spread: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, v), as stored tables: their classes (id, mark, ...) and what these link with (mark, n, c)."""
    spark = rows.sparkSession
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dim = -(-max(dim, 1) // SUBSPACE) * SUBSPACE

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw, _ = padded(part.column("v"), dim)
                unit, keep = _unit(part.column("v"), dim)
                marks = [hashlib.blake2b((r + 0.0).tobytes(), digest_size=16).digest() if k else None for r, k in zip(raw, keep)]
                blobs = [u.tobytes() if k else None for u, k in zip(unit, keep)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(marks, pa.binary()), pa.array(blobs, pa.binary())], ["id", "mark", "unit"])

    marked = stored(mapped(rows, units, "id long, mark binary, unit binary").withColumn("mark", F.expr("if(id is null, null, mark)")), "units")
    full = marked.where("mark is not null")
    classes = full.groupBy("mark").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # The representative's row brings its vector; ids may repeat, so one row per class is kept by aggregation.
    reps = full.groupBy("mark").agg(F.min(F.struct("id", "unit")).alias("one"), F.count("*").alias("copies")).select(F.col("one.id").alias("rep"), "copies", F.col("one.unit").alias("unit"))
    reps = stored(reps, "classes")
    n = reps.count()
    if not n:
        return marked, stored(marked.limit(0).select("mark", F.lit(0).cast("long").alias("n"), F.col("id").alias("c")), "labels", small=True)
    lists = min(MOST_LISTS, max(1, n // LIST_ROWS))
    most = max(SAMPLE_ROWS, ROWS_A_LIST * lists)
    sample = reps.where(sampled(most / n, "rep")).orderBy("rep").limit(2 * most).select("unit").toArrow()
    x = np.frombuffer(b"".join(sample.column("unit").to_pylist())).reshape(-1, dim)
    send = spark.sparkContext.broadcast(Quantiser(x, lists))
    radius = math.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-9
    reach = radius * min(1.0, spread / math.sqrt(dim))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = send.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(-1, dim)
                home, lists = probed(x, q.centres, reach)
                codes, errors = q.encode(x, home)
                asked = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "copies", "unit")), pa.array(home, pa.int32()), asked, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], ["rep", "copies", "unit", "home", "lists", "codes", "error"])

    indexed = stored(mapped(reps, index, "rep long, copies long, unit binary, home int, lists array<int>, codes binary, error double"), "index")
    # At most MOST_LISTS rows each.
    size = {r["l"]: math.ceil(r["count"] / BLOCK) for r in indexed.groupBy(F.col("home").alias("l")).count().collect()}
    asked = {r["l"]: math.ceil(r["count"] / BLOCK) for r in indexed.select(F.explode("lists").alias("l")).groupBy("l").count().collect()}
    known = sorted(size)
    blocks = spark.createDataFrame([(l, size[l], asked.get(l, 1)) for l in known], "l int, nm int, nq int")
    place = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    members = indexed.withColumn("l", F.col("home")).join(F.broadcast(blocks), "l").withColumn("m", place(F.col("nm"), "m")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    probing = indexed.select("rep", "copies", "unit", "home", F.explode("lists").alias("l")).join(F.broadcast(blocks), "l").withColumn("q", place(F.col("nq"), "q")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
    members = members.select("l", "m", "q", *(F.col(c).alias(f"y_{c}") for c in ("rep", "copies", "unit", "lists", "codes", "error")))
    probing = probing.select("l", "m", "q", *(F.col(c).alias(f"x_{c}") for c in ("rep", "copies", "unit", "home")))

    def compare(key, asking: pa.Table, listed: pa.Table) -> pa.Table:
        ids, counts, edges = [], [], []
        if asking.num_rows and listed.num_rows:
            xs, ys = (np.frombuffer(b"".join(t.column(c).to_pylist())).reshape(-1, dim) for t, c in ((asking, "x_unit"), (listed, "y_unit")))
            xi, yi, xc, yc = (t.column(c).to_numpy() for t, c in ((asking, "x_rep"), (listed, "y_rep"), (asking, "x_copies"), (listed, "y_copies")))
            codes = np.frombuffer(b"".join(listed.column("y_codes").to_pylist()), np.uint8).reshape(len(ys), -1)
            y_lists = listed.column("y_lists").combine_chunks()
            asks = np.zeros((len(ys), len(send.value.centres)), bool)  # which lists each of the block's rows probes
            asks[np.repeat(np.arange(len(ys)), y_lists.value_lengths().to_numpy()), y_lists.flatten().to_numpy()] = True
            home, within = asking.column("x_home").to_numpy(), radius + listed.column("y_error").to_numpy()
            for at in range(0, len(xs), 256):
                d = send.value.distances(xs[at : at + 256], key[0].as_py(), codes)
                i, j = np.nonzero(d <= within**2 + 1e-9)
                i += at
                apart = xi[i] != yi[j]
                i, j = i[apart], j[apart]
                for p in range(0, len(i), PAIRS):
                    a, b = i[p : p + PAIRS], j[p : p + PAIRS]
                    near = np.einsum("nd,nd->n", xs[a], ys[b]) >= threshold
                    a, b = a[near], b[near]
                    edges.append(forest(xi[a], yi[b]))
                    # The other direction is met in the home list of x if y probes it; else it counts here.
                    back = ~asks[b, home[a]]
                    ids += [xi[a], yi[b][back]]
                    counts += [yc[b], xc[a][back]]
        a = np.concatenate([*ids, np.zeros(0, np.int64)])
        who, at = np.unique(a, return_inverse=True)
        total = np.bincount(at, np.concatenate([*counts, np.zeros(0)]), len(who)).astype(np.int64)
        hi, lo = forest(np.concatenate([*(e[0] for e in edges), np.zeros(0, np.int64)]), np.concatenate([*(e[1] for e in edges), np.zeros(0, np.int64)]))
        return pa.table({"hi": pa.array([*who, *hi], pa.int64()), "lo": pa.array([None] * len(who) + list(lo), pa.int64()), "n": pa.array([*total] + [None] * len(hi), pa.int64())})

    keys = ["l", "m", "q"]
    found = probing.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(compare, "hi long, lo long, n long")
    found = stored(found, "links", small=True)
    counts = found.where("lo is null").groupBy(F.col("hi").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("lo is not null").select("hi", "lo")).withColumnRenamed("node", "rep")
    per_class = classes.join(counts, "rep", "left").join(joined, "rep", "left").select("mark", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    return marked, stored(per_class, "labels", small=True)
