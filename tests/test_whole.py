"""Searches asked by all rows whose id is divisible by 100, against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vecmesh.functions.metrics import block_scores
from vecmesh.operators import search
from vecmesh.plans.catalog import K, QUERIES

N, DIM = 2600, 8


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    rng = np.random.default_rng(3)
    labels = np.arange(N) * 7 // 11 % 10
    x = (rng.normal(size=(10, DIM))[labels] + rng.normal(size=(N, DIM)) * 0.4).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(N), pa.int64()), "embedding": pa.array(list(map(list, x)), pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), d / "embeddings.parquet")
    return str(d), x.astype(float)


def upserted(x):
    out = x.copy()
    out[:-1:10] = x[1::10]
    return out


def expected(x, rows, keep, metric="L2", k=K):
    ids = np.flatnonzero(keep)
    found = set()
    for q, scores in zip(range(0, N, 100), block_scores(metric, x[::100], rows[ids])):
        order = np.lexsort((ids, scores))[:k]
        found |= {(q, r + 1, int(ids[i])) for r, i in enumerate(order)}
    return found


ALIVE, SEVENTH = np.ones(N, bool), np.arange(N) % 7 == 0


@pytest.mark.parametrize("name,rows,keep,metric", [
    ("exact_knn_l2", None, ALIVE, "L2"), ("exact_knn_cosine", None, ALIVE, "COSINE"), ("knn_with_tombstones", None, ~SEVENTH, "L2"), ("unified_l0_l1_search", None, ~SEVENTH, "L2"),
    ("knn_after_upserts", upserted, ALIVE, "L2"), ("collection_search", upserted, ~SEVENTH, "L2"),
])
def test_all_ask(spark, table, name, rows, keep, metric):
    d, x = table
    found = {(r["query_id"], r["rank"], r["id"]) for r in QUERIES[name](spark, d).collect()}
    assert found == expected(x, rows(x) if rows else x, keep, metric)


def test_range_in_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    d, x = table
    scores = block_scores("L2", x[::100], x)
    found = {(r["query_id"], r["id"]) for r in QUERIES["range_search"](spark, d).collect()}
    assert found == {(int(q) * 100, int(i)) for q, i in zip(*np.nonzero(scores <= 1.5))}


@pytest.mark.parametrize("name", ["select_buckets", "guardrail_nearest3", "pruned_knn", "adc_topk_l2", "adc_topk_cosine", "two_stage_search", "recall_at_k", "collection_routed_search", "collection_two_stage"])
def test_every_query_is_answered(spark, table, name, monkeypatch):
    """More than one block gives what one block does, for every asking row."""
    d, _ = table
    rows = lambda: sorted(map(tuple, QUERIES[name](spark, d).collect()))
    once = rows()
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    assert rows() == once and {r[0] for r in once} == set(range(0, N, 100))


def test_deleted_hits(spark, table):
    d, x = table
    (row,) = QUERIES["deleted_hit_rate"](spark, d).collect()
    truth = expected(x, x, ALIVE)
    assert (row["results"], row["deleted"]) == (len(truth), sum(i % 7 == 0 for _, _, i in truth))
