"""Small tables with every awkward case, and the plain versions that the operators are held against."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "the of and river stone cloud gentle morning figure Élan naïve straße lamp copper signal token letter window garden harbour quiet 12 7th x=1".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def awkward_texts():
    base, long = prose(1, 120), prose(2, 6000)
    edited = base.split(" ")
    edited[60] = "changed"
    passage = prose(3, 60)
    texts = [None, "", " ", "\n\n", "one", "One", "two words", "a b c d", "A B C D", base, base, base.upper(), " ".join(edited), long, long + " tail", prose(4, 80) + passage + prose(5, 90), passage + prose(6, 70), prose(7, 40) + passage]
    texts += ["x" * 500, "x" * 450, "ab" * 300, "▁mark ▁▁", "tab\there\r\nand  two   spaces ", "don't they'll <|endoftext|> 'S", "é composed ẛ̣ İ ΣΣ \U0001f600", "\x00\x01 control \x85 \xa0 nbsp"]
    texts += [f"Report {i} printed on 2024-01-{i:02d} by system\n" + prose(20 + i, 30) for i in range(1, 13)]
    return texts


def documents(path, texts, ids=None, extra=True):
    """A parquet table of documents; extra adds columns whose names the operators might use themselves."""
    n = len(texts)
    columns = {"doc_id": pa.array(ids or list(range(n)), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n, pa.string()), "source": pa.array(["s"] * n, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
    if extra:
        columns |= {c: pa.array([f"{c}{i}" for i in range(n)], pa.string()) for c in ("id", "row", "node", "n", "score", "spans", "lines", "token", "packed", "shard", "__row")}
    pq.write_table(pa.table(columns), path)
    return str(path)


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def embeddings(path, rows, ids=None):
    pq.write_table(pa.table({"vec_id": pa.array(ids or list(range(len(rows))), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32()), "id": pa.array(["x"] * len(rows))}), path)
    return str(path)


def awkward_vectors(n=300, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[200:240] = x[100] + rng.normal(size=(40, dim)) * 0.08
    rows = [list(map(float, v)) for v in x.astype(np.float32)]
    rows[10], rows[20], rows[30], rows[40] = None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim
    rows[50], rows[60], rows[70], rows[80] = [None] + [1.0] * (dim - 1), [1.0, 2.0], [], list(rows[81])
    rows[90] = [2 * v for v in rows[91]]
    return rows


def padded(rows, dim):
    ok = [r is not None and all(v is not None and np.isfinite(v) for v in r) for r in rows]
    return np.array([(list(r) + [0.0] * (dim - len(r))) if k else [0.0] * dim for r, k in zip(rows, ok)], float), np.array(ok)
