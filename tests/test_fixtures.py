"""Small literal cases of the engine's operators, with the outcomes they must have."""

import numpy as np
import pyarrow as pa
import pytest

from vecmesh.functions import metrics, sq8
from vecmesh.functions.arrow import vectors
from vecmesh.operators import cluster, evaluate, maintain, oplog, routing, search
from vecmesh.operators.caches import QueueCache

VEC, CEN, ASK = "id long, embedding array<float>", "bucket_id int, centroid array<float>, n long", "query_id long, embedding array<float>"


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, [float(x) for x in v], *rest) for i, v, *rest in rows], schema)


def ids(found, query=0):
    return [r["id"] for r in found.where(f"query_id = {query}").orderBy("rank").collect()]


def buckets(spark, rows, cents, metric="L2"):
    found = routing.assign(frame(spark, rows, VEC), frame(spark, cents, CEN), 2, metric)
    return {r["id"]: r["bucket_id"] for r in found.collect()}


def test_routes_to_nearest(spark):
    assert buckets(spark, [(1, [1, 1]), (2, [9, 9])], [(1, [0, 0], 1), (2, [10, 10], 1)]) == {1: 1, 2: 2}
    assert buckets(spark, [(1, [0.9, 0.1]), (2, [0.1, 0.9])], [(1, [1, 0], 1), (2, [0, 1], 1)], "cosine") == {1: 1, 2: 2}
    assert buckets(spark, [(100, [0.1, 0.1]), (101, [9.9, 9.9]), (102, [0.2, 0.2])], [(1, [0, 0], 1), (2, [10, 10], 1)]) == {100: 1, 101: 2, 102: 1}
    assert buckets(spark, [(1, [5, 5])], []) == {1: 0}


def test_wrong_centroid_dimension(spark):
    with pytest.raises(ValueError):
        routing.assign(frame(spark, [(1, [0, 0])], VEC), frame(spark, [(1, [0], 1)], CEN), 2)


def test_far_full_bucket_is_not_selected(spark):
    cents = frame(spark, [(1, [0, 0], 10), (2, [10, 10], 1000), (3, [2, 2], 100), (4, [3, 3], 100)], CEN)
    found = routing.select_buckets(frame(spark, [(0, [0, 0])], ASK), cents, 2, target=0.8, decay=1.0, density=5.0).collect()
    assert {r["bucket_id"]: round(r["share"], 4) for r in found} == {1: 0.9217, 3: 0.0630, 4: 0.0153}


@pytest.mark.parametrize("options", [{"density": 0}, {"target": 0}, {"target": 1.5}, {"decay": -1}])
def test_routing_parameters(spark, options):
    with pytest.raises(ValueError):
        routing.select_buckets(frame(spark, [(0, [0, 0])], ASK), frame(spark, [(1, [0, 0], 1)], CEN), 2, **options)


def test_knn(spark):
    rows, ask = frame(spark, [(1, [0, 0]), (2, [1, 1]), (3, [2, 2])], VEC), frame(spark, [(0, [0, 0])], ASK)
    found = search.knn(rows, ask, 3, 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in found] == [(1, 0.0), (2, 2.0), (3, 8.0)]
    assert ids(search.knn(rows, ask, 10, 2)) == [1, 2, 3]
    assert ids(search.knn(search.live(rows, rows.where("id = 2")), ask, 3, 2)) == [1, 3]
    with pytest.raises(ValueError):
        search.knn(rows, ask, 0, 2)


def test_knn_cosine_and_zero_vectors(spark):
    rows = frame(spark, [(1, [2, 0, 0, 0]), (2, [0.8, 0.6, 0, 0]), (3, [0, 2, 0, 0]), (4, [0, 0, 0, 0])], VEC)
    found = search.knn(rows, frame(spark, [(0, [1, 0, 0, 0])], ASK), 4, 4, "cosine").orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in found] == [(1, 0.0), (2, 0.2), (3, 1.0), (4, 1.0)]


def test_knn_ties_and_copies(spark):
    rows = frame(spark, [(i, [1, 1]) for i in range(50)], VEC).repartition(7)
    assert ids(search.knn(rows, frame(spark, [(0, [0, 0])], ASK), 5, 2)) == [0, 1, 2, 3, 4]


def test_delta_hides_base(spark):
    base, delta = frame(spark, [(1, [0, 0]), (2, [1, 1])], VEC), frame(spark, [(1, [5, 5])], VEC)
    found = search.unified(base, delta, base.where("id < 0"), frame(spark, [(0, [0, 0])], ASK), 5, 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in found] == [(2, 2.0), (1, 50.0)]


def test_metric_names():
    assert metrics.Metric.parse(" cosine ") is metrics.Metric.COSINE and metrics.Metric.parse("") is metrics.Metric.L2
    with pytest.raises(ValueError):
        metrics.Metric.parse("dot")


def test_quantiser_ranges():
    line = np.arange(100.0)[:, None]
    low, high, step = sq8.ranges(line)
    assert abs(low[0] + np.round((50 - low[0]) / step[0]) * step[0] - 50) < 0.5
    low, high, step = sq8.ranges(np.arange(101.0)[:, None])
    assert (low[0], high[0]) == (1.0, 99.0)
    assert sq8.ranges(np.array([[1, 5], [2, 5], [3, 5.0]]))[2][1] == 1.0


def test_lookup_table_is_the_distance():
    rng = np.random.default_rng(3)
    rows, q = rng.normal(size=(300, 8)), rng.normal(size=8)
    low, _, step = sq8.ranges(rows)
    codes = np.clip(np.round((rows - low) / step), 0, 255).astype(int)
    assert np.allclose(sq8.lookup_distances(sq8.lookup_table(q, low, step), codes), ((low + codes * step - q) ** 2).sum(axis=1))


def test_kmeans(spark):
    assert np.allclose(cluster.kmeans(frame(spark, [(1, [1, 2, 3]), (2, [4, 5, 6])], VEC), 1, 3), [[2.5, 3.5, 4.5]])
    two = frame(spark, [(i, [10, 10] if i < 100 else [-10, -10]) for i in range(200)], VEC)
    for update in ("lloyd", "streaming_mean"):
        centres = cluster.kmeans(two, 2, 2, update=update)
        assert centres[0][0] * centres[1][0] < 0
    assert np.isfinite(cluster.kmeans(frame(spark, [(i, [1, 1, 1, 1]) for i in range(100)], VEC), 5, 4)).all()
    axes = frame(spark, [(i, v) for i, v in enumerate([[10, 0], [9, 0], [8, 0], [0, 10], [0, 9], [0, 8]])], VEC)
    assert (np.sort(cluster.kmeans(axes, 2, 2, "cosine").max(axis=1)) > 0.8).all()
    with pytest.raises(ValueError):
        cluster.kmeans(two.limit(0), 2, 2)
    with pytest.raises(ValueError):
        cluster.kmeans(two, 2, 3)


def test_defectors():
    x = np.array([[0, 0]] * 40 + [[100, 100]] * 40 + [[130, 130]] * 10, float)
    half, out = cluster.split_rows(x, np.array([[0, 0], [106.0, 106.0]]), np.array([[140, 140.0]]))
    assert out.sum() == 10 and out[80:].all() and (np.bincount(half[~out]) == 40).all()


def test_capped_split(spark):
    x = [[0, 0]] * 5 + [[20, 20]] * 5 + [[9, 9]] * 15
    own = frame(spark, [(i, v) for i, v in enumerate(x)], VEC)
    moved = cluster.defectors(own, np.array([[0, 0], [20, 20.0]]), np.array([[9, 9.0]]))
    assert moved.where("defects").count() == 15
    moved = cluster.capped(moved)
    assert sorted(r["id"] for r in moved.where("defects").collect()) == [10, 11, 12, 13, 14] and moved.count() == 25
    means = {(r["half"], r["pos"]): (r["n"], r["mean"]) for r in cluster.half_means(own, moved).collect()}
    assert means[0, 0] == (15, 6.0) and means[1, 1] == (5, 20.0)


def test_mini_batches(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [50, 0], [0, 50.0]])
    rows = frame(spark, [(i, centres[i % 3] + rng.normal(size=2)) for i in range(3000)], VEC)
    for metric in ("L2",):
        found = cluster.kmeans(rows, 3, 2, metric, batch=200, seed=3)
        assert np.abs(found[:, None] - centres[None]).sum(axis=2).min(axis=1).max() < 1.5
    whole = cluster.mini_batches([rows], centres)
    assert np.allclose(whole, cluster.kmeans(rows, 3, 2, init=centres, rounds=1))
    assert np.allclose(cluster.mini_batches([rows, rows.limit(0)], centres), whole)


def test_centroids_in_parts(spark, monkeypatch):
    """More centroids than one broadcast holds give the same buckets and routes."""
    rng = np.random.default_rng(3)
    cents = frame(spark, [(i, rng.normal(size=4), int(rng.integers(1, 50))) for i in range(40)], CEN)
    rows = frame(spark, [(i, rng.normal(size=4)) for i in range(100)], VEC).selectExpr("*", "id * 2 as other")
    ask = frame(spark, [(i, rng.normal(size=4)) for i in range(9)], ASK)

    def results(metric):
        placed = sorted(map(tuple, routing.place(rows, cents, 4, metric, apart=7).select("id", "other", "bucket_id", "distance").collect()))
        routes = sorted((r["query_id"], r["bucket_id"], r["place"], r["near"], round(r["share"], 9)) for r in routing.select_buckets(ask, cents, 4, metric, 0.7, 1.0, 10.0).collect())
        return placed, routes

    once = [results(m) for m in ("L2", "COSINE")]
    monkeypatch.setattr(routing, "BROADCAST_BYTES", 4 * 8 * 9)
    assert [results(m) for m in ("L2", "COSINE")] == once
    assert all(b != 7 and other == 2 * i for i, other, b, _ in once[0][0])


def test_quantisers_of_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i % 4, [float(x) for x in rng.normal(size=3).round(1)]) for i in range(1500)] + [(9, [1.0, 2.0, 3.0])], "bucket_id int, embedding array<float>")
    rounded = lambda: sorted((r["bucket_id"], *(tuple(np.round(r[c], 9)) for c in ("low", "high", "step"))) for r in sq8.train(rows, 3).collect())
    once = rounded()
    monkeypatch.setattr(sq8, "WHOLE", 100)
    assert rounded() == once and len(once) == 5


def exchanged(spark, job):
    """What job() gives, and the rows that its stages wrote for exchanges."""
    sc, none = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = written()
    found = job()
    return found, sum(n for stage, n in written().items() if stage not in before)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_buckets_exchange_counts_alone(spark, monkeypatch, tmp_path, kind):
    """The rows of a large bucket stay where they are, whatever their number: task memory doesn't follow the bucket's size."""
    monkeypatch.setattr(sq8, "WHOLE", 1000)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60_000, 3)) * 10.0 ** rng.integers(-30, 30, size=(60_000, 1))
    x[:40_000, 1], x[::2, 2] = -0.0, 5.0
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    made = spark.createDataFrame(pa.table({"bucket_id": pa.array((np.arange(len(x)) % 2).astype(np.int32)), "embedding": vectors(x)}))
    made.selectExpr("bucket_id", f"cast(embedding as array<{kind}>) as embedding").repartition(4).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    found, n = exchanged(spark, lambda: sq8.train(rows, 3).collect())
    for r in found:
        assert all((np.array(r[c]) == w).all() for c, w in zip(("low", "high", "step"), sq8.ranges(x[r["bucket_id"] :: 2])))
    assert sorted(r["bucket_id"] for r in found) == [0, 1] and n < len(x)


def test_quantisers_joined_to_the_codes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, i % 5, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "id long, bucket_id int, embedding array<float>")
    quantizers = sq8.train(rows, 4)
    coded = rows.join(quantizers, "bucket_id").select("id", "bucket_id", sq8.encode("embedding", "low", "step").alias("codes"))
    ask = rows.where("id < 5").selectExpr("id as query_id", "embedding")
    found = lambda **o: [sorted(map(tuple, search.knn_codes(coded, quantizers, ask, 7, 4, m, **o).collect())) for m in ("L2", "COSINE")]
    once = found()
    assert found(tables=True) == once
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert found() == once


def test_routes_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = spark.createDataFrame([(i, i % 6, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "id long, bucket_id int, embedding array<float>")
    ask = rows.where("id < 20").selectExpr("id as query_id", "embedding")
    routes = spark.createDataFrame([(q, b) for q in range(20) for b in range(6) if (q + b) % 3], "query_id long, bucket_id int")
    found = lambda: sorted(map(tuple, search.knn(rows, ask, 5, 4, routes=routes).collect()))
    once = found()
    x = {r["id"]: np.array(r["embedding"]) for r in rows.collect()}
    for q in (0, 7):
        near = sorted((round(float(((x[q] - x[i]) ** 2).sum()), 9), i) for i in x if (q + i % 6) % 3)[:5]
        assert [(i, round(s, 6)) for a, _, i, s in once if a == q] == [(i, round(s, 6)) for s, i in near]
    monkeypatch.setattr(search, "ROUTE_PAIRS", 10)
    assert found() == once
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert found() == once


def test_percentiles_of_ranges(spark):
    rng = np.random.default_rng(11)
    values = [("a", float(v)) for v in rng.normal(size=500).round(2)] + [("b", 3.0)] * 7 + [("c", -1.0), ("c", None)]
    found = {r["g"]: (r["n"], r["value"]) for p in [0.95] for r in evaluate.percentile_floor(spark.createDataFrame(values, "g string, v double"), "g", "v", p).collect()}
    a = sorted(v for g, v in values if g == "a")
    assert found == {"a": (500, a[475]), "b": (7, 3.0), "c": (1, -1.0)}
    for p in (0.0, 0.5, 1.0):
        row = evaluate.percentile_floor(spark.createDataFrame(values, "g string, v double"), "g", "v", p).where("g = 'a'").first()
        assert row["value"] == a[min(int(500 * p), 499)]


def test_columns_of_row_groups(spark):
    rows = spark.createDataFrame([(i, i % 3, [float(i), -float(i)]) for i in range(100)], "id long, bucket_id int, embedding array<double>")
    cols = maintain.columns(rows, most=10)
    assert cols.count() >= 2 * 3 * 3 and cols.agg({"values": "max"}).count() == 1
    assert max(len(r["values"]) for r in cols.collect()) < 34
    assert {r["id"]: list(r["embedding"]) for r in maintain.rows_of(cols).collect()} == {i: [float(i), -float(i)] for i in range(100)}


def test_log(spark):
    schema = "log_id int, seq long, kind string, tx_id long, id long"

    def done(*ops):
        rows = [(0, n, kind, tx, i) for n, (kind, tx, i) in enumerate(ops)]
        return [r["id"] for r in oplog.committed(spark.createDataFrame(rows, schema)).orderBy("seq").collect()]

    assert done(("BEGIN", 1, None), ("INSERT", None, 1), ("DELETE", None, 2), ("COMMIT", 1, None)) == [1, 2]
    assert done(("BEGIN", 1, None), ("INSERT", None, 1)) == []
    assert done(("BEGIN", 1, None), ("INSERT", None, 100), ("COMMIT", 1, None), ("BEGIN", 2, None), ("INSERT", None, 200), ("BEGIN", 1, None), ("INSERT", None, 300), ("COMMIT", 1, None)) == [100, 300]
    assert done(("BEGIN", 1, None), ("INSERT", None, 1), ("BEGIN", 2, None), ("INSERT", None, 2), ("COMMIT", 2, None)) == [2]
    assert done(("INSERT", None, 10), ("DELETE", None, 20)) == [10, 20]
    assert done(("BEGIN", 1, None), ("INSERT", None, 1), ("COMMIT", 9, None), ("INSERT", None, 2), ("COMMIT", 1, None)) == [1, 2]


def test_log_ends_at_bad_checksum(spark):
    rows = [(0, 1, "INSERT", None, 1, True), (0, 2, "INSERT", None, 2, False), (0, 3, "INSERT", None, 3, True), (1, 1, "INSERT", None, 4, True)]
    found = oplog.committed(spark.createDataFrame(rows, "log_id int, seq long, kind string, tx_id long, id long, crc_ok boolean"))
    assert sorted(r["id"] for r in found.collect()) == [1, 4]


def test_committed_against_state_machine(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], []
    for log in range(200):
        active, pending = None, []
        for seq in range(12):
            kind = ["BEGIN", "COMMIT", "INSERT", "DELETE"][rng.integers(4)]
            tx = int(rng.integers(2)) if kind in ("BEGIN", "COMMIT") else None
            rows.append((log, seq, kind, tx, seq))
            if kind == "BEGIN":
                active, pending = tx, []
            elif kind == "COMMIT":
                if active is not None and tx == active:
                    expected += pending
                    active, pending = None, []
            else:
                (expected if active is None else pending).append((log, seq))
    found = oplog.committed(spark.createDataFrame(rows, "log_id int, seq long, kind string, tx_id long, id long"))
    assert sorted((r["log_id"], r["seq"]) for r in found.collect()) == sorted(expected)


def test_replay_by_seq(spark):
    rows = [(1, "DELETE", 1, None), (2, "INSERT", 1, [1.0]), (3, "INSERT", 2, [1.0]), (4, "DELETE", 2, None), (10, "INSERT", 3, [3.0]), (9, "INSERT", 3, [2.0])]
    found = oplog.replay(spark.createDataFrame(rows, "seq long, kind string, id long, embedding array<float>"))
    assert {r["id"]: r["embedding"] for r in found.collect()} == {1: [1.0], 3: [3.0]}


def test_bucket_summary(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 50), (3, 500)], "bucket_id int, n long")
    assert tuple(evaluate.bucket_summary(sizes, 100).first()) == (3, 5, 50, 500, 2)


def test_decisions(spark):
    stats = spark.createDataFrame([(1, 101, 0, 0.5, 0.0), (2, 90, 0, 0.5, 0.2), (3, 90, 0, 0.5, 0.1), (4, 5, 0, 0.5, 0.0), (5, 0, 0, 0.5, 0.0)], "bucket_id int, total long, dead long, temperature double, shift double")
    assert {r["bucket_id"]: r["action"] for r in maintain.decide(stats, 100).collect()} == {1: "split", 2: "split", 3: "none", 4: "merge", 5: "merge"}


def test_queue_cache():
    cache = QueueCache(10)
    for i in range(10):
        cache.put(i)
    assert all(cache.get(i) for i in range(10))
    cache.put("once")
    assert cache.rejected == 1 and not cache.get("once")
    cache.put("once")
    assert cache.get("once") and len(cache) == 10


def twice(cache, keys):
    for k in keys:
        cache.put(k)
        cache.put(k)


def test_a_ghost_returns_to_the_main_queue():
    cache = QueueCache(10)
    cache.put(999)
    twice(cache, range(15))
    assert 999 in cache.ghost and not cache.get(999)
    cache.put(999)
    assert 999 in cache.main and cache.get(999) and cache.ghost_hits == 1


def test_used_keys_outlive_others():
    cache = QueueCache(10)
    cache.put("hot"), cache.get("hot"), cache.get("hot")
    for i in range(1, 11):
        cache.put(i) if len(cache) < 10 else twice(cache, [i])
    assert cache.get("hot") and "hot" in cache.main


def test_the_small_queue_grows_with_a_ghost():
    cache = QueueCache(100)
    cache.put(1)
    for i in range(2, 102):
        cache.put(i), cache.put(i)
    assert not cache.get(1)
    cache.put(1)
    assert cache.target == 11


def test_evictions_one_by_one():
    """Where eviction starts is decided once; used keys move on within it and lower no target."""
    cache = QueueCache(4)  # target 1
    for k in "abcd":
        cache.put(k)
    for k in "abc":
        cache.get(k)
    cache.put("e"), cache.put("e")  # a, b and c are used and move on; d is the first that isn't
    assert list(cache.main) == ["a", "b", "c"] and list(cache.small) == ["e"] and list(cache.ghost) == ["d"] and cache.target == 1
    cache.put("d")  # a ghost: the small queue has its share, so the main queue gives up its oldest
    assert cache.target == 1 and list(cache.main) == ["b", "c", "d"] and list(cache.small) == ["e"]
    one = QueueCache(1)
    twice(one, "xyz")
    assert len(one) == 1
    with pytest.raises(ValueError):
        QueueCache(0)
