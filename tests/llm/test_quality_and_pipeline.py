"""The classifier's held-out accuracy, and the pipeline stage by stage on small tables."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tokenizers

import corpus_pipeline
from vecmesh.llm import entries, quality, secrets

from . import helpers
from .test_text_operators import check_packing, plain_drops

DATA = "/root/testdata/sf0.01"


def test_accuracy_on_held_out_rows(spark):
    found = entries.op10_quality(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    rows = found.join(truth, "doc_id").collect()
    assert found.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.93
    good = [r for r in held if r["quality"] == 1]
    assert np.mean([r["predicted"] for r in good]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def labels(path, rows):
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32()), "toxic": pa.array([0] * len(rows), pa.int32()), "__y": pa.array(["x"] * len(rows))}), path)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, 1)], [(3, 1), (4, 1), (4, 1), (6, 1)], [(i, i % 2) for i in range(20)]])
def test_awkward_labels_and_texts(spark, tmp_path, rows):
    texts = helpers.awkward_texts()
    helpers.documents(tmp_path / "documents.parquet", texts)
    labels(tmp_path / "labels.parquet", rows)
    found = entries.op10_quality(spark, str(tmp_path)).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)


def test_only_statistics_decide(spark, tmp_path):
    texts = [helpers.prose(i, 50) if i % 2 else helpers.prose(i, 50).upper() + "!!!" for i in range(200)]
    helpers.documents(tmp_path / "documents.parquet", texts)
    labels(tmp_path / "labels.parquet", [(i, i % 2) for i in range(200)])
    docs, known = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    trees = quality.train(docs, known)
    assert [r["doc_id"] % 2 for r in quality.keep_good(docs, trees).select("doc_id").collect()] == [1] * 100
    assert quality.keep_good(docs, trees).columns == docs.columns
    again = quality.train(docs, known)
    assert np.array_equal(trees.value, again.value) and np.array_equal(trees.threshold, again.threshold)


def test_flat_traversal_is_the_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, quality.N_FEATURES))
    y = (x[:, 3] + x[:, 5] ** 2 > 0.5).astype(float)
    trees = quality.fit(x, y, rounds=20)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert np.mean((trees.score(x) > 0.5) == y) > 0.95
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_a_split_is_the_best_of_all():
    """One tree of depth 1 against the gain of every edge between distinct values."""
    rng = np.random.default_rng(7)
    for _ in range(10):
        x = rng.integers(0, 12, (200, quality.N_FEATURES)).astype(float)
        y = (x[:, rng.integers(quality.N_FEATURES)] + rng.normal(size=200) * 3 > 6).astype(float)
        tree = quality.fit(x, y, rounds=1, depth=1, bins=64, penalty=2.0, least=10)
        p = np.full(200, 1 / (1 + np.exp(-tree.base)))
        g, h = p - y, p * (1 - p)

        def gain(right):
            if min(right.sum(), (~right).sum()) < 10:
                return 0.0
            return sum(g[m].sum() ** 2 / (h[m].sum() + 2.0) for m in (right, ~right)) - g.sum() ** 2 / (h.sum() + 2.0)

        best = max(gain(x[:, f] > t) for f in range(quality.N_FEATURES) for t in np.unique(x[:, f]))
        right = x[:, tree.feature[0, 0]] > tree.threshold[0, 0]
        assert np.isclose(gain(right), best)
        assert np.allclose(tree.value[0], [-0.1 * g[m].sum() / (h[m].sum() + 2.0) for m in (~right, right)])


def test_statistics_of_sliced_columns():
    column = pa.array(["AB c", None, "", "x\ny y"])
    whole = quality.statistics(column)
    assert np.allclose(whole[2:], quality.statistics(column.slice(2))) and not whole[1].any()
    assert whole[0, 0] == 0.5 and whole[3, quality.N_CLASSES + 2] == 2 / 3


def test_pipeline(spark, tmp_path):
    clean = [helpers.prose(100 + i, 60) for i in range(60)]
    junk = [helpers.prose(300 + i, 60).upper().replace(" ", "!! ") for i in range(40)]
    copies = [clean[0], clean[1] + " tail", None, ""]
    secret = [helpers.prose(500, 40) + ' token = "0123456789abcdef0123"']
    shared = [helpers.prose(600 + i, 40) + "\nAll rights reserved by the house.\n" + helpers.prose(700 + i, 20) for i in range(15)]
    texts = clean + junk + copies + secret + shared
    helpers.documents(tmp_path / "documents.parquet", texts)
    labels(tmp_path / "labels.parquet", [(i, int(i < 60)) for i in range(100)])
    d, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "secrets", "packing"]
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{d}/{name}")
            docs = spark.read.parquet(f"{d}/{name}")
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, lines, unique, safe = kept
    trees = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    scores = trees.score(quality.statistics(pa.array(texts, pa.string())))
    assert good == {i: t for i, t in enumerate(texts) if scores[i] >= 0.3}
    drops = plain_drops([good[i] for i in good])
    for n, i in enumerate(good):
        mine = (good[i] or "").split("\n") if good[i] else []
        left = (lines[i] or "").split("\n") if lines[i] else []
        may = [k for k in range(len(mine)) if (n, k) in drops]
        assert len(mine) - len(left) <= len(may) and [x for k, x in enumerate(mine) if k not in may] == [x for x in left if x not in [mine[k] for k in may]]
    sets = {i: helpers.shingles(t) for i, t in lines.items()}
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = helpers.components(near, sets)
    assert unique == {i: t for i, t in lines.items() if group[i] == i}
    assert safe == {i: secrets.redact(t) for i, t in unique.items()}
    assert set(range(60)) <= set(good) and not set(range(60, 100)) & set(good)
    assert set(lines) == set(good) and sum("All rights reserved" in (t or "") for t in lines.values()) == 1
    gone = set(lines) - set(unique)
    assert {100, 101} & set(good) == gone
    assert all(not [s for s in secrets.find(t) if s[0] != "guess"] for t in safe.values()) and any("[secret]" in (t or "") for t in safe.values())
    packed = corpus_pipeline.run(spark, d)
    words = tokenizers.Tokenizer.from_file(entries.tokenizer("word_bpe_49k.json"))
    rows = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in packed.collect()]
    check_packing(rows, [(i, np.array([*words.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in safe.items()])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    helpers.documents(tmp_path / "documents.parquet", [])
    labels(tmp_path / "labels.parquet", [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
