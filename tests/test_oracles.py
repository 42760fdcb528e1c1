"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vecmesh.functions import sq8
from vecmesh.functions.arrow import vectors
from vecmesh.operators import oplog
from vecmesh.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        return None if isinstance(x, float) and math.isnan(x) else 0.0 if isinstance(x, float) and x == 0 else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(expected.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["collection_after_maintenance", "collection_as_of", "collection_log_sizes", "collection_reopened", "streaming_ingest", "collection_search", "collection_trained"])
def test_oracle_with_large_buckets(spark, duck, monkeypatch, name):
    """The same where a bucket's ranges aren't one task's work."""
    monkeypatch.setattr(sq8, "WHOLE", 100)
    found, expected = QUERIES[name](spark, DATA), duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(expected.fetchall(), columns)


def most_read(spark, job):
    """The most rows that a task of job() read from exchanges."""
    sc, none = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()) for s in map(found.apply, range(found.size()))}

    before = stages()
    job()
    read = [t.taskMetrics() for s in stages() - before for found in [sc.statusStore().taskList(*s, 10_000)] for t in map(found.apply, range(found.size()))]
    return max(m.get().shuffleReadMetrics().recordsRead() for m in read if m.isDefined())


@pytest.mark.parametrize("name", ["collection_as_of", "collection_log_sizes", "collection_reopened", "streaming_ingest", "collection_search", "collection_trained"])
def test_no_task_takes_a_large_bucket(spark, monkeypatch, tmp_path, name):
    """A flush's one bucket is dealt over tasks all the way, so that a task's memory doesn't follow its size."""
    monkeypatch.setattr(sq8, "WHOLE", 100)
    x = np.random.default_rng(13).normal(size=(8000, 2))
    made = pa.table({"vec_id": np.arange(len(x)), "embedding": vectors(x).cast(pa.list_(pa.float32())), "label": (np.arange(len(x)) % 10).astype(np.int32)})
    os.makedirs(f"{tmp_path}/embeddings.parquet")
    pq.write_table(made, f"{tmp_path}/embeddings.parquet/part.parquet")
    few = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    once = {k: spark.conf.get(k, None) for k in few}
    for k, v in few.items():
        spark.conf.set(k, v)
    try:
        assert most_read(spark, lambda: QUERIES[name](spark, str(tmp_path)).collect()) < len(x) / 2
    finally:
        for k, v in once.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_queue_cache_counts(spark):
    found = QUERIES["queue_cache_trace"](spark, DATA).collect()
    assert sum(r["requests"] for r in found) == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert all(r["hits"] + r["misses"] == r["requests"] for r in found)


def test_entry(spark):
    import __spark_entry__ as entry

    asking = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert entry.entry(spark).count() == 10 * asking
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_checksums_of_frames(spark):
    import zlib

    rows = spark.createDataFrame([(1, "INSERT", None, 7, [0.5, 2.0]), (2, "BEGIN", 3, None, None)], "seq long, kind string, tx_id long, id long, embedding array<double>")
    found = [r["crc"] for r in oplog.with_checksum(rows).orderBy("seq").collect()]
    assert found == [zlib.crc32(b"1|INSERT||7|0.5,2.0"), zlib.crc32(b"2|BEGIN|3||")]
