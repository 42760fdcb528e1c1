"""Helpers shared by the operators: stored intermediate tables, row numbers, Arrow batches, byte-level words and components."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
#: While a table is written: small Arrow batches, and the shuffle files of its plan go when it is done.
WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Size of a sieve; a power of two.
SIEVE_BITS = 1 << 26
#: Bits of a row number that count within a file.
IN_FILE = 36
_lock = threading.RLock()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, and afterwards as it was."""
    with _lock:
        before = {k: spark.conf.get(k, None) for k in values}
        try:
            for k, v in values.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(kept: list[DataFrame]):
    """Tables stored inside are deleted at the end, but those that are in `kept` by then."""
    token = _scratch.set([])
    try:
        yield
        names = {f for df in kept for f in df.inputFiles()}
        drop(*(df for df in _scratch.get() if not names.intersection(df.inputFiles())))
    finally:
        _scratch.reset(token)


def _few_files(df: DataFrame) -> DataFrame:
    """df in as many partitions as the cluster works on at once, where adaptive execution wouldn't see to that."""
    spark = df.sparkSession
    on = lambda name: spark.conf.get(f"spark.sql.adaptive.{name}") == "true"
    most = 2 * spark.sparkContext.defaultParallelism
    if on("enabled") and on("coalescePartitions.enabled") or int(spark.conf.get("spark.sql.shuffle.partitions")) <= most:
        return df
    return df.repartition(most)


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors don't matter.

    The table goes at the end of scratch(), or else when the driver's JVM ends. small: it has a few bytes for each
    text or vector, so it shouldn't be a file for each partition of an exchange.
    """
    spark = df.sparkSession
    df = _few_files(df) if small else df
    path = f"{shared_dir(spark)}/vecmesh/{name}-{uuid.uuid4().hex}"
    own = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    smaller = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(own)} if 0 < own < BATCH_ROWS else {}
    with settings(spark, WRITING | smaller):
        df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    if _scratch.get() is not None:
        _scratch.get().append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sampled(share: float, *key: str) -> Column:
    """Whether a row is in a sample of about that share of all keys, chosen by a hash; from a share of 1 on, each is."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*key, F.lit("sample")) < -(1 << 63) + max(1, int(share * (1 << 64)))


class Sieve:
    """Whether keys (64-bit hashes) may be in a table: SIEVE_BITS bits by their low bits, set for the table's keys.

    It has one size whatever the table's, so it may be broadcast; the more keys, the less it keeps back. A join with
    the table itself must follow.
    """

    def __init__(self, table: DataFrame, key: str):
        bit = table.select(F.col(key).bitwiseAND(F.lit(SIEVE_BITS - 1).cast("long")).alias("bit"))
        words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()
        own = np.zeros(SIEVE_BITS >> 6, np.uint64)
        own[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
        self.send = table.sparkSession.sparkContext.broadcast(own)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """For an unsigned array of keys: False where a key is surely not in the table."""
        bit = keys & np.uint64(SIEVE_BITS - 1)
        return (self.send.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken, out = {c.lower() for c in docs.columns}, f"__vecmesh_{name}"
    while out in taken:
        out += "_"
    return out


def _plain_scan(docs: DataFrame) -> bool:
    """Whether docs are the rows of Parquet files, at most with columns chosen and rows filtered by fixed rules."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def numbered(docs: DataFrame, row: str = "__vecmesh_row") -> DataFrame:
    """docs with a long column `row` that names each row, the same one however often and wherever the plan runs.

    A row of Parquet files has the place of its file among all of them and its own place there: neither depends on
    how the files are split into tasks, which executors that come and go may change. Other tables have no such
    places, so they are stored once together with their numbers.
    """
    if not _plain_scan(docs):
        return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    at, file, first = docs.metadataColumn("_metadata"), fresh(docs, "file"), fresh(docs, "first")
    own = docs.select("*", at["file_path"].alias(file), at["row_index"].alias(row))
    # As many rows as the driver lists files for the scan itself.
    files = sorted(r[0] for r in own.select(file).distinct().collect()) if len(docs.inputFiles()) > 1 else []
    if len(files) < 2:
        return own.drop(file)
    places = docs.sparkSession.createDataFrame([(f, k << IN_FILE) for k, f in enumerate(files)], f"`{file}` string, `{first}` long")
    return own.join(F.broadcast(places), file).withColumn(row, F.col(first) + F.col(row)).drop(file, first)


_libc: list = []


def trim() -> None:
    """Give free memory back to the system: a worker lives on for tasks that may need none of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # not glibc
            _libc.append(lambda _: 0)
    _libc[0](0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), with trim() when a task ends that has read more than a slice."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for batch in batches:
                seen += batch.nbytes
                yield batch

        try:
            yield from run(counted())
        finally:
            if seen > SLICE_BYTES:
                trim()

    return df.mapInArrow(lean, schema)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `limit` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, null as empty, and the n + 1 offsets of its rows."""
    full = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(full, pa.ChunkedArray):
        full = full.combine_chunks()
    offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
    data = full.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Table(dict):
    """A table filled by make(key) on demand, in two generations of `most` rows: beyond that the older one is dropped.

    Keys over `longest` characters are made where they stand and not kept, so memory is bounded whatever the input.
    """

    most, longest = 150_000, 64

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def make(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > self.longest:
                return out
        self.keep(key, out)
        return out

    def keep(self, key: str, out) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges (a, b): every node that isn't the least of its component, and that least node."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo = forest(batch.column("hi").to_numpy(zero_copy_only=False), batch.column("lo").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (hi, lo): a row (node, component) for each node but the least of its component.

    Each batch first shrinks to a spanning forest, then large-star and small-star rounds run until only stars
    towards the least node are left. Nothing is gathered: a round is two aggregations and two joins. The aggregated
    sides are stored first, so that adaptive execution may split a hub's rows.
    """
    e = edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
    e = stored(mapped(e, _contract, "hi long, lo long").distinct(), "edges", small=True)
    while True:
        roots = e.groupBy("hi").agg(F.count("*").alias("n"))
        inner = e.select(F.col("lo").alias("hi")).distinct().join(e, "hi", "left_semi")
        if roots.where("n > 1").isEmpty() and inner.isEmpty():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", small=True)
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large", small=True)
        low = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "low", small=True)
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = stored(mapped(small.union(low.select("hi", "m")), _contract, "hi long, lo long").distinct(), "edges", small=True)
        drop(e, least, large, low)
        e = after
