"""Embedding operators against brute force."""

import numpy as np
import pytest

from vecmesh.llm import embed_dedup, entries, topk
from vecmesh.llm.common import components, forest

from . import helpers


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    d = tmp_path_factory.mktemp("vectors")
    rows = helpers.awkward_vectors()
    helpers.embeddings(d / "embeddings.parquet", rows)
    return str(d), rows


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    helpers.embeddings(d / "embeddings.parquet", [])
    return str(d)


@pytest.mark.parametrize("name", ["op3_embedding_dedup", "op7_exact_topk"])
def test_empty_table(spark, empty, name):
    assert entries.queries()[name](spark, empty).count() == 0


def test_all_null_vectors(spark, tmp_path):
    helpers.embeddings(tmp_path / "embeddings.parquet", [None, [], [float("nan")]])
    assert [tuple(r) for r in entries.op3_embedding_dedup(spark, str(tmp_path)).orderBy("vec_id").collect()] == [(i, 0, i, True) for i in range(3)]
    assert entries.op7_exact_topk(spark, str(tmp_path)).count() == 0


def check_links(found, ids, x, ok):
    norm = np.linalg.norm(x, axis=1)
    ok = ok & (norm > 0)
    unit = x / np.where(ok, norm, 1)[:, None]
    cosine = unit @ unit.T
    near = (cosine >= 0.95 - 1e-12) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    group = helpers.components([(i, j) for i, j in zip(*np.nonzero(near))], range(len(ids)))
    rows = {r["vec_id"]: r for r in found.collect()}
    assert len(rows) == len(ids)
    for i, v in enumerate(ids):
        r = rows[v]
        assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum(), ids[group[i]], group[i] == i)


def test_dedup(spark, awkward):
    d, rows = awkward
    check_links(entries.op3_embedding_dedup(spark, d), list(range(len(rows))), *helpers.padded(rows, 8))


def test_dedup_blocks_and_lists(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(300, 16)), 4, axis=0)
    x += rng.normal(size=x.shape) * 0.1 / 4
    x[:200] = x[0] + rng.normal(size=(200, 16)) * 0.05
    x[500:520] = x[500]
    for name, value in (("LIST_ROWS", 40), ("BLOCK", 64), ("PAIRS", 500), ("SAMPLE_ROWS", 600)):
        monkeypatch.setattr(embed_dedup, name, value)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embed_dedup.links(docs)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum() - len(x)
    got = {r["vec_id"]: r for r in found.collect()}
    links = sum(r["n_links"] for r in got.values())
    assert 0.97 * true <= links <= true
    assert {got[i]["component_id"] for i in range(500, 520)} == {got[500]["component_id"]} and all(got[i]["n_links"] >= 19 for i in range(500, 520))


def test_copies_and_repeated_ids(spark):
    v = [1.0, 2.0, 3.0]
    docs = spark.createDataFrame([(5, v), (3, v), (3, v), (9, [-1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in embed_dedup.links(docs).collect()) == [(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (9, 0, 9, True)]


def test_lookup_distances_are_of_the_codes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    q = embed_dedup.Quantiser(x, 5)
    home = embed_dedup.nearest(x, q.centres)
    codes, error = q.encode(x, home)
    for l in range(len(q.centres)):
        back = q.centres[l] + np.concatenate([w[codes[home == l][:, s]] for s, w in enumerate(q.words)], axis=1)
        assert np.allclose(np.sqrt(((back - x[home == l]) ** 2).sum(axis=1)), error[home == l])
        assert np.allclose(q.distances(x[:20], l, codes[home == l]), ((x[:20, None] - back[None]) ** 2).sum(axis=2))


def plain_topk(ids, x, ok, k=10):
    v = np.floor(x * 1024).astype(np.int64)
    out = []
    for i in range(len(ids)):
        if ids[i] % 100 == 0 and ok[i]:
            scores = v @ v[i]
            order = [j for j in np.lexsort((ids, -scores)) if ok[j] and ids[j] != ids[i]][:k]
            out += [(ids[i], n + 1, ids[j], int(scores[j])) for n, j in enumerate(order)]
    return sorted(out)


def test_topk(spark, awkward):
    d, rows = awkward
    assert sorted(tuple(r) for r in entries.op7_exact_topk(spark, d).collect()) == plain_topk(np.arange(len(rows)), *helpers.padded(rows, 8))


def test_topk_trees_blocks_and_ties(spark, tmp_path, monkeypatch):
    for name, value in (("TREE_ROWS", 300), ("PAGE", 16), ("FANOUT", 4), ("QUERY_BLOCK", 5), ("SAMPLE_ROWS", 200)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6)).round(1)
    x[300:700] = x[300]
    ids = rng.permutation(5000)[:1500]
    helpers.embeddings(tmp_path / "embeddings.parquet", x.tolist(), ids.tolist())
    assert sorted(tuple(r) for r in entries.op7_exact_topk(spark, str(tmp_path)).collect()) == plain_topk(ids, x.astype(np.float32).astype(float), np.ones(1500, bool))


def test_topk_few_rows_and_large_numbers(spark):
    rows = spark.createDataFrame([(0, [1e12, 1.0]), (100, [1e12, 3.0]), (7, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.search(rows, rows.where("vec_id % 100 = 0"), 10).collect())
    top = 2**63 - 1
    assert found == [(0, 1, 100, top), (0, 2, 7, -1024 * 10**12 * 1024 + 512 * 1024), (100, 1, 0, top), (100, 2, 7, -1024 * 10**12 * 1024 + 512 * 3072)]
    with pytest.raises(ValueError):
        topk.search(rows, rows, 0)


def test_tree_leaves_out_distances():
    rng = np.random.default_rng(1)
    x = np.floor(np.repeat(rng.normal(size=(40, 5)) * 5000, 50, axis=0) + rng.normal(size=(2000, 5)) * 30)
    tree = topk.MTree(np.arange(2000), x)
    tree = topk.MTree.from_bytes(tree.to_bytes())
    query, best = x[0], []
    tree.search(query, 0, 5, -np.inf, best)
    scores = x @ query
    order = [i for i in np.lexsort((np.arange(2000), -scores)) if i != 0][:5]
    assert sorted(best, reverse=True) == [(scores[i], -i) for i in order]
    for page in range(len(tree.start) - 1):
        own = slice(tree.start[page], tree.start[page + 1])
        assert (tree.child[own] >= 0).all() or ((tree.child[own] < 0).all() and own.stop - own.start <= topk.PAGE)


def test_tree_bounds_hold():
    """Whatever lies below an entry is within its radius of the routing object, at the stored distance from the parent."""
    rng = np.random.default_rng(4)
    tree = topk.MTree(np.arange(3000), np.floor(rng.normal(size=(3000, 6)) * 100))

    def below(page, centre):
        rows = []
        for e in range(tree.start[page], tree.start[page + 1]):
            assert abs(np.linalg.norm(tree.lifted[tree.object[e]] - tree.lifted[centre]) - tree.parent[e]) < 1e-6
            if tree.child[e] < 0:
                rows.append(tree.object[e])
                continue
            own = below(tree.child[e], tree.object[e])
            assert np.linalg.norm(tree.lifted[own] - tree.lifted[tree.object[e]], axis=1).max() <= tree.radius[e] + 1e-6
            rows += own
        return rows

    assert sorted(below(0, tree.root)) == list(range(3000))


def test_searching_leaves_out_pages(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.floor(np.repeat(rng.normal(size=(40, 5)) * 5000, 50, axis=0) + rng.normal(size=(2000, 5)) * 30)
    tree, seen = topk.MTree(np.arange(2000), x), []
    monkeypatch.setattr(topk.heapq, "heappop", lambda queue, pop=topk.heapq.heappop: seen.append(1) or pop(queue))
    tree.search(x[0], 0, 5, -np.inf, [])
    assert len(seen) < (len(tree.start) - 1) / 2


@pytest.mark.parametrize("lists", [256, 1024])
def test_recall_of_the_probes(lists):
    """Of true links, at least 0.9 lie in a probed list, for spread-out and for clustered vectors; all do at the full spread."""
    rng = np.random.default_rng(lists)
    for centres in (1, 2000):
        x = rng.normal(size=(40_000, 32)) + (rng.normal(size=(centres, 32))[rng.integers(0, centres, 40_000)] if centres > 1 else 0)
        x[:5000] = x[5000:10_000] * (1 + 0 * x[:5000]) + rng.normal(size=(5000, 32)) * rng.uniform(0.05, 0.3, size=(5000, 1)) * np.linalg.norm(x[5000:10_000], axis=1)[:, None] / np.sqrt(32)
        x /= np.linalg.norm(x, axis=1)[:, None]
        words = embed_dedup.kmeans(x[rng.permutation(len(x))[: 8 * lists]], lists, 3, rng)
        similar = np.flatnonzero((x[:5000] * x[5000:10_000]).sum(axis=1) >= 0.95)
        home = embed_dedup.nearest(x[5000 + similar], words)
        radius = np.sqrt(0.1)
        for spread, least in ((embed_dedup.SPREAD, 0.97), (np.sqrt(32), 1.0)):
            _, probes = embed_dedup.probed(x[similar], words, radius * min(1, spread / np.sqrt(32)))
            met = np.mean([h in p for h, p in zip(home, probes)])
            assert len(similar) > 1000 and met >= least


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4200)]
    group = helpers.components([e for e in edges], {n for e in edges for n in e})
    found = components(spark.createDataFrame(edges, "hi long, lo long").repartition(9))
    assert sorted(tuple(r) for r in found.collect()) == sorted((n, g) for n, g in group.items() if n != g)
    hi, lo = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert dict(zip(hi.tolist(), lo.tolist())) == {n: g for n, g in group.items() if n != g}
