"""Collections: writes, search over both tiers, flush, split, merge, restart, streams and the command line."""

import json
from threading import Thread

import numpy as np
import pytest

from vecmesh import cli
from vecmesh.operators import evaluate, search
from vecmesh.schema import Conflict, InvalidInput, NotFound
from vecmesh.sources import generators
from vecmesh.sources.collection import Engine
from vecmesh.streaming.ingest import ingest

VEC, ASK = "id long, embedding array<float>", "query_id long, embedding array<float>"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def frame(spark, rows, schema=VEC):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], schema)


def found(c, vector, k=10, **options):
    asked = frame(c.spark, [(0, vector)], ASK)
    return [(r["id"], r["score"]) for r in c.search(asked, k, **options).orderBy("rank").collect()]


def ids_frame(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_create_and_open(engine):
    engine.create("a", 2, "cosine")
    assert engine.open("a").metric.value == "COSINE"
    with pytest.raises(InvalidInput):
        engine.create("a", 3, "cosine")
    with pytest.raises(InvalidInput):
        engine.open("a", metric="L2")
    with pytest.raises(NotFound):
        engine.open("b")
    for name, dim in (("", 2), ("x", 0)):
        with pytest.raises(InvalidInput):
            engine.create(name, dim)
    assert engine.names() == ["a"] and engine.health()["ready"]


def test_upsert_delete_and_tiers(spark, engine):
    c = engine.create("a", 2)
    c.insert(frame(spark, [(1, [0, 0]), (2, [1, 1])]))
    c.insert(frame(spark, [(1, [5, 5])]))
    assert found(c, [0, 0]) == [(2, 2.0), (1, 50.0)]
    assert c.flush() and not c.flush()
    assert found(c, [0, 0]) == [(2, 2.0), (1, 50.0)]
    c.insert(frame(spark, [(2, [0, 1]), (3, [9, 9])]))
    c.delete(ids_frame(spark, 1))
    assert found(c, [0, 0]) == [(2, 1.0), (3, 162.0)]
    c.flush()
    assert found(c, [0, 0]) == [(2, 1.0), (3, 162.0)]
    c.insert(frame(spark, [(1, [0, 0])]))
    assert found(c, [0, 0], 1) == [(1, 0.0)]
    c.flush()
    again = Engine(spark, c.files.root).open("a")
    assert found(again, [0, 0], 1) == [(1, 0.0)] and again.base().count() == 3
    again.compact()
    assert again.base().count() == 3 and again.verify() == [] and again.state().deletes == ()
    assert again.vacuum() and found(again, [0, 0], 1) == [(1, 0.0)]
    means = {r["bucket_id"]: r["centroid"] for r in again.centroids().collect()}
    assert np.allclose(means[0], np.mean([[0, 1], [9, 9], [0, 0]], axis=0))


def test_bad_batches_are_refused_whole(spark, engine):
    c = engine.create("a", 2)
    for rows in ([(1, [0, 0]), (2, [0, 0, 0])], [(1, [0, float("nan")])]):
        with pytest.raises(InvalidInput):
            c.insert(frame(spark, rows))
    assert c.live().count() == 0 and found(c, [0, 0]) == []
    with pytest.raises(InvalidInput):
        found(c, [0, 0], 0)
    with pytest.raises(InvalidInput):
        found(c, [0, 0, 0])
    assert c.insert(frame(spark, [(1, [0, 0]), (1, [3, 3])])) == 2 and c.live().count() == 1
    assert c.insert(frame(spark, [])) == 0


def test_many_log_segments_replay_in_order(spark, engine):
    c = engine.create("a", 1)
    for n in range(11):
        c.insert(frame(spark, [(1, [n])]))
    assert found(c, [0]) == [(1, 100.0)]


def test_split_keeps_all_rows_and_deletes(spark, engine):
    c = engine.create("a", 2, capacity=60)
    c.insert(frame(spark, [(i, [i % 6, (i // 6) % 6]) for i in range(50)] + [(100 + i, [15 + i % 6, 15 + (i // 6) % 6]) for i in range(50)]))
    c.flush()
    c.delete(ids_frame(spark, 7))
    assert c.maintain() == "split 0"
    sizes = {r["bucket_id"]: r["count"] for r in c.base().groupBy("bucket_id").count().collect()}
    assert sorted(sizes.values()) == [49, 50] and 0 not in sizes
    assert 7 not in {r["id"] for r in c.live().collect()}


def test_split_is_skipped(spark, engine):
    c = engine.create("a", 2)
    c.insert(frame(spark, [(i, [10, 10]) for i in range(100)]))
    c.flush()
    assert c.split(0) == "skipped: singular"
    d = engine.create("b", 2)
    d.insert(frame(spark, [(1, [0, 0])]))
    d.flush()
    assert d.split(0) == "skipped: too small" and d.merge(0) == "skipped: no other bucket"


def test_merge_moves_rows(spark, engine):
    c = engine.create("a", 2, capacity=100)
    c.train(frame(spark, [(i, [0, i / 10]) for i in range(5)] + [(100 + i, [10, 10 + i / 100]) for i in range(50)]), buckets=2)
    small = min(c.stats().collect(), key=lambda r: r["total"])
    assert small["total"] == 5 and small["action"] == "merge"
    assert c.merge(small["bucket_id"]).startswith("merge")
    assert [r["count"] for r in c.base().groupBy("bucket_id").count().collect()] == [55]


def test_large_bucket_is_not_scattered(spark, engine):
    c = engine.create("a", 1)
    c.train(frame(spark, [(i, [i % 2 * 100 + i / 1000]) for i in range(220)]), buckets=2)
    assert c.merge(1) == "skipped: too large"


def test_recall_through_growth(spark, engine):
    c = engine.create("a", 16, capacity=150)
    for step in range(3):
        c.insert(generators.clusters(spark, 200, 16, step=step, first=1000 * step))
        c.flush()
        c.maintain()
    asked = c.live().where("id % 40 = 0").selectExpr("id as query_id", "embedding")
    got, truth = c.search(asked, 10, target=0.99, decay=0.05, density=20.0), search.knn(c.live(), asked, 10, 16)
    assert evaluate.recall(got, truth, 10).groupBy().avg("recall").first()[0] >= 0.9


def test_needles(spark, engine):
    c = engine.create("a", 8)
    asked = generators.uniform(spark, 3, 8, seed=1).withColumnRenamed("id", "query_id")
    planted = generators.needles(spark, asked, 5)
    c.insert(generators.uniform(spark, 500, 8))
    c.insert(planted.select("id", "embedding"))
    c.flush()
    got = {(r["query_id"], r["id"]) for r in c.search(asked, 5, target=0.99, decay=0.05, density=20.0).collect()}
    assert got == {(r["query_id"], r["id"]) for r in planted.collect()}


def test_stream(spark, engine, tmp_path):
    c = engine.create("s", 2)
    frame(spark, [(1, [0, 0]), (2, [1, 1])]).selectExpr("*", "false as deleted").write.parquet(str(tmp_path / "in"))
    schema = f"{VEC}, deleted boolean"
    run = lambda: ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "ck")).awaitTermination()
    run()
    frame(spark, [(2, [3, 3])]).selectExpr("*", "false as deleted").union(frame(spark, [(1, [0, 0])]).selectExpr("*", "true as deleted")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert found(c, [0, 0]) == [(2, 18.0)] and c.metrics()["base_rows"] == 1


def test_command_line(spark, tmp_path, capsys):
    call = lambda *a: cli.main(["--root", str(tmp_path), *a], spark)
    call("create", "a", "--dim", "2")
    assert call("insert", "a", "--vectors", json.dumps({"1": [0, 0], "2": [1, 1]})) == 2
    assert call("flush", "a") is True
    assert call("search", "a", "--vector", "[0, 0]", "--k", "1") == [(1, 0.0)]
    call("delete", "a", "--ids", "1")
    assert call("search", "a", "--vector", "[0, 0]") == [(2, 2.0)]
    assert call("list") == ["a"]


def test_two_stage_search_and_location(spark, engine):
    c = engine.create("a", 8, capacity=150)
    c.insert(generators.clusters(spark, 300, 8))
    c.flush()
    c.maintain()
    c.insert(generators.uniform(spark, 5, 8, first=9000))
    c.delete(ids_frame(spark, 0))
    asked = generators.clusters(spark, 300, 8).where("id % 60 = 0").withColumnRenamed("id", "query_id")
    exact, coded = c.search(asked, 5, exact=True), c.search(asked, 5, exact=True, two_stage=True)
    assert evaluate.recall(coded, exact, 5).groupBy().avg("recall").first()[0] >= 0.9
    assert 0 not in {r["id"] for r in coded.collect()}
    places = {r["id"]: (r["tier"], r["bucket_id"]) for r in c.locate(ids_frame(spark, 0, 1, 9001, 77777)).collect()}
    assert set(places) == {1, 9001} and places[9001] == ("delta", None) and places[1][0] == "base"


def test_verify(spark, engine, tmp_path):
    c = engine.create("a", 2)
    assert c.verify() == []
    c.insert(frame(spark, [(1, [0, 0])]))
    c.flush()
    assert c.verify() == []
    lost = next((tmp_path / "a/rows/part=1").rglob("*.parquet"))
    lost.write_bytes(b"short")
    assert len(c.verify("warn")) == 1 and c.verify(most=1)
    with pytest.raises(OSError):
        c.verify()


def test_verify_sees_changed_bytes_of_one_size(spark, engine, tmp_path):
    c = engine.create("a", 2)
    c.insert(frame(spark, [(1, [0, 0])]))
    c.flush()
    one = next((tmp_path / "a/codes/part=1").rglob("*.parquet"))
    data = bytearray(one.read_bytes())
    data[10] ^= 1
    one.write_bytes(bytes(data))
    (one.parent / f".{one.name}.crc").unlink(missing_ok=True)
    assert [w.split("/")[0] for w in c.verify("warn")] == ["codes"]


def test_writers_side_by_side(spark, engine):
    """Inserts, flushes and ticks at once lose no write."""
    c = engine.create("a", 2, capacity=40)
    c.insert(frame(spark, [(i, [i, i]) for i in range(60)]))
    c.flush()
    failed = []

    def write(n):
        try:
            own = Engine(spark, c.files.root).open("a")
            for k in range(3):
                own.insert(frame(spark, [(1000 * n + 10 * k + j, [n, k]) for j in range(4)]))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    def upkeep(act):
        try:
            for _ in range(3):
                act(Engine(spark, c.files.root).open("a"))
        except Conflict:
            pass
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [Thread(target=write, args=(n,)) for n in (1, 2, 3)] + [Thread(target=upkeep, args=(a,)) for a in (lambda o: o.flush(), lambda o: o.touch([0]), lambda o: o.maintain())]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    expected = {*range(60), *(1000 * n + 10 * k + j for n in (1, 2, 3) for k in range(3) for j in range(4))}
    assert {r["id"] for r in c.live().collect()} == expected
    c.flush()
    assert {r["id"] for r in c.base().collect()} == expected and c.verify() == []
    assert c.centroids().agg({"n": "sum"}).first()[0] == len(expected)


def test_a_flush_waits_for_open_claims(spark, engine):
    c = engine.create("a", 1)
    c.insert(frame(spark, [(1, [1])]))
    seq = c._claim()  # a writer that has begun
    c.insert(frame(spark, [(2, [2])]))
    assert c.flush() and c.state().flushed == 1 and c.log_sizes()["rows"] == 1
    assert not c.flush() and found(c, [0]) == [(1, 1.0), (2, 4.0)]
    c.vacuum(sweep_after=-1)  # it never came
    assert c.flush() and c.state().flushed == seq + 1 and found(c, [0]) == [(1, 1.0), (2, 4.0)]


def test_one_of_several_gets_a_name(engine):
    assert [engine.files.create("x/claim", "a"), engine.files.create("x/claim", "b")] == [True, False] and engine.files.read("x/claim") == "a"


def test_an_overtaken_publication_starts_anew(spark, engine):
    c = engine.create("a", 1)
    c.insert(frame(spark, [(1, [1])]))
    before = c.state()
    c.flush()
    with pytest.raises(Conflict):
        c._commit(before, before)


def test_centroids_follow_updates(spark, engine):
    """Sums of parts, less what later writes hide, are the means of the live rows."""
    rng = np.random.default_rng(4)
    c = engine.create("a", 3, capacity=30)
    for step in range(4):
        c.insert(frame(spark, [(int(i), rng.normal(size=3) + 8 * (i % 2)) for i in rng.integers(0, 90, 40)]))
        c.delete(ids_frame(spark, *map(int, rng.integers(0, 90, 5))))
        c.flush()
        c.maintain()
    base = c.base().collect()
    for r in c.centroids().collect():
        own = np.array([x["embedding"] for x in base if x["bucket_id"] == r["bucket_id"]])
        assert r["n"] == len(own) and np.allclose(r["centroid"], own.mean(axis=0))
    assert sum(r["n"] for r in c.centroids().collect()) == len(base) == c.live().count()


def test_first_flush_into_several_buckets(spark, engine):
    c = engine.create("a", 4, capacity=100)
    c.insert(generators.clusters(spark, 500, 4, sigma=2.0))
    c.flush(bootstrap=True)
    assert 3 <= c.centroids().count() <= 5 and c.base().count() == 500


def test_search_reads_routed_buckets_alone(spark, engine):
    c = engine.create("a", 4)
    rows = generators.clusters(spark, 300, 4, centres=6, sigma=1.0)
    c.adopt(rows.selectExpr("id", "embedding", "cast(id % 6 as int) as bucket_id"))
    asked = rows.where("id < 2").withColumnRenamed("id", "query_id")
    for options in ({}, {"two_stage": True}):
        found = c.search(asked, 3, target=0.1, decay=3.0, density=1.0, **options)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket_id" in plan and found.count() == 6
    assert c._touched and set(c._touched.values()) == {2}
    with pytest.raises(InvalidInput):
        c.adopt(rows.selectExpr("id", "slice(embedding, 1, 2) as embedding", "0 as bucket_id"))


def test_other_formats_are_refused(spark, engine, tmp_path):
    engine.create("a", 2)
    meta = json.loads((tmp_path / "a/meta.json").read_text())
    (tmp_path / "a/meta.json").write_text(json.dumps(meta | {"format": 99}))
    (tmp_path / "a/.meta.json.crc").unlink(missing_ok=True)
    with pytest.raises(InvalidInput):
        engine.open("a")


def test_split_with_a_cap(spark, engine):
    c = engine.create("a", 2)
    c.adopt(spark.createDataFrame([(i, [float(20 * (i % 2)), 0.0], 0) for i in range(30)] + [(100 + i, [9.5, 0.0], 0) for i in range(10)] + [(200, [9.5, 0.0], 1)], "id long, embedding array<float>, bucket_id int"))
    assert c.split(0) == "skipped: too small" and c.split(0, loopback=0.2) == "split 0"
    sizes = {r["bucket_id"]: r["n"] for r in c.centroids().collect()}
    assert sum(sizes.values()) == 41 and sizes[1] <= 9 and 0 not in sizes


def test_exposition(spark, engine):
    c = engine.create("a", 1)
    c.insert(frame(spark, [(1, [1])]))
    found(c, [0])
    assert 'vecmesh_inserts{collection="a"} 1\n' in c.exposition() and 'vecmesh_searches{collection="a"} 1\n' in c.exposition()


def test_entry_without_the_pipeline_operators(monkeypatch):
    import importlib
    import sys

    for name in [n for n in sys.modules if n.startswith("vecmesh.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "vecmesh.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "exact_knn_l2" in entry.queries() and not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert entry.oracle_sql()


def test_hot_buckets(spark, engine):
    c = engine.create("a", 2)
    rows = [(i, [float(10 * (i % 5)), float(i % 7)]) for i in range(200)]
    c.adopt(spark.createDataFrame([(i, v, i % 5) for i, v in rows], "id long, embedding array<float>, bucket_id int"))
    plain = found(c, [0, 0], target=0.1, decay=1.0, density=1.0)
    c.keep_hot(buckets=3, rows=90)
    for _ in range(3):
        assert found(c, [0, 0], target=0.1, decay=1.0, density=1.0) == plain
    assert set(c.hot.held) <= {0, 1, 2} and len(c.hot.held) == 2 and c.hot.loads == 2  # 40 rows each: two fit
    c.insert(frame(spark, [(0, [500, 500]), (1000, [0.5, 0])]))
    assert found(c, [0.5, 0], 1, target=0.1, decay=1.0, density=1.0) == [(1000, 0.0)]
    c.flush()
    assert found(c, [0.5, 0], 1, target=0.1, decay=1.0, density=1.0) == [(1000, 0.0)]
    c.keep_hot(0, 0)
    assert c.hot is None
