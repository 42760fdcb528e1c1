"""N-gram Jaccard join: which documents' shingle sets are similar, by prefix filters under several token orders.

Two sets of Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of each under any one order
of all tokens. The first order puts rare tokens first; pairs that share a prefix token there are candidates. With a
token's places in both prefixes, a candidate's intersection has an upper bound, valid at the first token that it
shares; too small a one drops the candidate. The further orders are hash orders. Candidates meet in their prefixes
under these before texts are sent to pairs; where many unlike sets share a token of the first order, they are joined
by tokens of the first order and the next together, so the filters intersect in the join's key. Equal sets are one
node from the start.

Nothing is done pair by pair within a group of copies. Of the documents that share a prefix token, the one that
shares most is compared with each of the others; then only pairs that still lie in different components are left,
and all of those are compared, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, components, drop, fresh, mapped, mix64, numbered, scratch, stored, text_slices
from .shingles import SLICE_BYTES, shingle_sets

#: Similarity as an exact fraction: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Frequent tokens that the first order knows by count; all others come before them. Only speed depends on it.
FREQUENT = 1 << 18
CHUNK_TOKENS = 2_000_000
#: Seeds of the hash orders after the first.
ORDERS = (11, 12)
BLOCK = 256
#: Sets that are paired by one key at most while there is a further order to tell them apart. Combined keys meet once
#: for each pair of shared tokens, so they pay where a key has many more sets than these have tokens.
PAIRED = 4096


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """n - ceil(n * percent / 100) + 1, or 0 for an empty set."""
    return n - -(-n * percent // 100) + 1 if n else 0


def node_of(tokens: np.ndarray) -> int:
    """A set's 64-bit name (signed)."""
    return int(mix64(np.array([tokens.sum(), np.bitwise_xor.reduce(mix64(tokens)), len(tokens)], np.uint64)).sum().view(np.int64))


def first_prefix(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The prefix under the first order: tokens not in `frequent` (sorted) by value, then the others by `place`."""
    p = prefix_length(len(tokens), percent)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        known = frequent[at] == tokens
        rare = tokens[~known]
        if len(rare) < p:
            return np.concatenate([rare, tokens[known][place[at[known]].argsort()][: p - len(rare)]])
        tokens = rare
    return tokens[:p]


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sets x and y are similar."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def hash_prefixes(tokens: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """The prefixes under each hash order of ORDERS."""
    p, out = prefix_length(len(tokens), percent), []
    for seed in ORDERS:
        keys = mix64(tokens ^ mix64(np.array([seed], np.uint64))[0])
        out.append(tokens[np.argpartition(keys, p - 1)[:p]] if 0 < p < len(tokens) else tokens)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in text_slices(batches, "text", SLICE_BYTES):
        tokens, bounds = shingle_sets(part.column("text"))
        yield part, [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, row, node, n) for each text; and rows (tokens, times): tokens that come twice or more within a chunk of sets."""
    columns = ["id", "row", "node", "n", "tokens", "times"]
    lists = pa.list_(pa.int64())

    def count(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        own = [pa.array([x[counts > 1].tolist()], lists) for x in (tokens.view(np.int64), counts)]
        return pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in range(3)), *own], columns)

    held, size, seen, kind = [], 0, set(), None
    for part, sets in _sets(batches):
        names, kind = [node_of(s) if len(s) else None for s in sets], part.schema.field("id").type
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), lists), pa.nulls(len(sets), lists)], columns)
        for name, s in zip(names, sets):
            if name is not None and name not in seen:
                seen.add(name)
                held.append(s)
                size += len(s)
        if size >= CHUNK_TOKENS:
            yield count(held, kind)
            held, size, seen = [], 0, set()
    if held:
        yield count(held, kind)


def _prefixes(send, percent: int):
    """Rows (node, prefix): the sets' prefixes under the first order, as 64-bit tokens; a set that a task sees again is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, place = send.value
        seen: set[int] = set()
        for _, sets in _sets(batches):
            found: dict[int, bytes] = {}
            for s in sets:
                if len(s) and (name := node_of(s)) not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(name)
                    found[name] = first_prefix(s, frequent, place, percent).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "prefix"])

    return run


def _postings(sieve: Sieve | None = None):
    """Rows (token, node, place) of prefixes; with a sieve, of tokens that it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(iter([batch]), "prefix")):
            sizes = np.array([len(x) // 8 for x in part.column("prefix").to_pylist()], np.int64)
            tokens = np.frombuffer(b"".join(part.column("prefix").to_pylist()), np.uint64)
            nodes, places = np.repeat(part.column("node").to_numpy(), sizes), np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(sieve.passes(tokens)) if sieve else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(nodes[at]), pa.array(places[at], pa.int32())], ["token", "node", "place"])

    return run


def _passing(sieve: Sieve):
    """Rows (row, text) whose key the sieve passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(sieve.passes(batch.column("key").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([some.column("row"), some.column("text")], ["row", "text"])

    return run


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored (node, text) and (node, orders) of wanted nodes (node); of texts (row, text) hardly any others are exchanged."""
    rows = stored(nodes.join(wanted.distinct(), "node", "left_semi").select("row", "node", F.xxhash64("row").alias("key")), "wanted", small=True)
    some = mapped(texts.select("row", "text", F.xxhash64("row").alias("key")), _passing(Sieve(rows, "key")), "row long, text string")
    found = stored(some.join(rows.select("row", "node"), "row").select("node", "text"), "texts")
    return found, stored(mapped(found, _orders(percent), "node long, orders array<binary>"), "orders")


def _orders(percent: int):
    """Rows (node, orders): a set's prefixes under the hash orders, as 32-bit names, each sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            orders = [[np.unique((p >> np.uint64(32)).astype(np.uint32)).tobytes() for p in hash_prefixes(s, percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(orders, pa.list_(pa.binary()))], ["node", "orders"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (c, b, v, orders) sorted like those of _verify: the pairs (c, v) whose prefixes meet under all hash orders."""
    key, centre = None, None
    for batch in batches:
        kept = []
        for c, b, v, orders in zip(*(batch.column(x).to_pylist() for x in ("c", "b", "v", "orders"))):
            if (c, b) != key:
                key, centre = (c, b), None
            own = [np.frombuffer(o, np.uint32) for o in orders]
            if v == c:
                centre = own if centre is None else centre
            elif centre is not None and all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(centre, own)):
                kept.append((c, v))
        c, v = zip(*kept) if kept else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(v, pa.int64())], ["c", "v"])


def _verify(percent: int):
    """Over rows sorted by (centre, block), the centre's own row first: links (hi, lo) between it and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for part, sets in _sets(batches):
            hi, lo = [], []
            for c, b, v, s in zip(part.column("c").to_pylist(), part.column("b").to_pylist(), part.column("v").to_pylist(), sets):
                if (c, b) != key:
                    key, centre = (c, b), None
                if v == c:
                    centre = s if centre is None else centre
                elif centre is not None and similar(centre, s, percent):
                    hi.append(max(c, v)), lo.append(min(c, v))
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    return run


def _beside(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """Rows (c, b, v, column) of pairs (c, v), sorted so that a centre's own row comes before its partners'.

    A centre with many partners is cut into blocks of about BLOCK of them.
    """
    blocks = stored(pairs.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).alias("nb")), "blocks", small=True)
    pairs = pairs.join(blocks, "c").select("c", "v", F.pmod(F.xxhash64("v"), F.col("nb")).alias("b"))
    centres = pairs.select("c", "b").distinct().select("c", F.col("c").alias("v"), "b")
    rows = pairs.union(centres).hint("merge").join(held.withColumnRenamed("node", "v"), "v").select("c", "b", "v", column)
    return rows.repartition("c", "b").sortWithinPartitions("c", "b", F.col("v") != F.col("c"))


def _links(pairs: DataFrame, orders: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (hi, lo) among stored pairs (c, v): those that meet under all orders are compared."""
    met = stored(mapped(_beside(pairs, orders, "orders"), _meet, "c long, v long"), "met", small=True)
    return mapped(_beside(met, texts, "text"), _verify(percent), "hi long, lo long")


def _compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Stored links (hi, lo) among stored pairs (c, v)."""
    own, orders = _texts_of(pairs.select(F.explode(F.array("c", "v")).alias("node")), nodes, texts, percent)
    links = stored(_links(pairs, orders, own, percent), "links", small=True)
    drop(own, orders)
    return links


def _open_pairs(rows: DataFrame, orders_of: Callable[[DataFrame], DataFrame], fits: Column) -> DataFrame:
    """Pairs (c, v) in different components among rows (key, node, n, place, k) that share a key, and that fit.

    Keys of more than PAIRED rows are taken together with the tokens of the next order's prefix, as long as there is
    one: a pair that may be similar shares such a combined key too, and unlike sets hardly ever do.
    """
    found, orders = None, None
    for order in range(len(ORDERS) + 1):
        size = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("key", "m")
        rows = stored(rows.join(stored(size, "undecided", small=True), "key"), "open")
        last = order == len(ORDERS)
        here = rows if last else rows.where(F.col("m") <= PAIRED)
        other = here.select("key", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "place", "k")))
        pairs = here.join(other, "key").where((F.col("node") < F.col("o_node")) & (F.col("k") != F.col("o_k")) & fits).select(F.col("node").alias("c"), F.col("o_node").alias("v"))
        found = pairs if found is None else found.union(pairs)
        rows = rows.where(F.col("m") > PAIRED).drop("m")
        if last or rows.isEmpty():
            return found.distinct()
        orders = orders_of(rows.select("node")) if orders is None else orders
        names = mapped(orders, _names_of(order), "node long, name long")
        rows = stored(rows.join(names.hint("merge"), "node").select(F.xxhash64("key", "name").alias("key"), "node", "n", "place", "k"), "combined")


def _names_of(order: int):
    """Rows (node, name) for the names of one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [np.frombuffer(o[order], np.uint32) for o in part.column("orders").to_pylist()]
                nodes = np.repeat(part.column("node").to_numpy(), [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(own).astype(np.int64))], ["node", "name"])

    return run


def join(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (id, n_shingles, component_id, row, group) for each row of docs.

    n_shingles is the size of its set, component_id the least id that links reach, itself included. Texts that are
    null, empty or without words have an empty set and link with nothing. Repeated rows and equal sets are linked.
    `row` is that of numbered(); `group` names the component also where ids repeat or are null. An empty table gives
    no rows.
    """
    row = fresh(docs, "row")
    return _join(numbered(docs, row), row, percent, id_column, text)


def _join(docs: DataFrame, row: str, percent: int, id_column: str, text: str) -> DataFrame:
    """join() of docs whose rows the column `row` names."""
    kept: list[DataFrame] = []
    with scratch(kept):
        names, label = _labelled(docs.select(F.col(id_column).alias("id"), F.col(row).alias("row"), F.col(text).alias("text")), percent)
        kept += [names, label]
    out = names.where("row is not null").select("id", "row", "node", "n").join(label, "node", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "row", F.coalesce(F.col("k").cast("string"), F.concat(F.lit("row "), "row")).alias("group"))


def _labelled(texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, row, text), as stored tables: their sets' names (id, row, node, n, ...) and what lies where (node, component_id, k)."""
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    found = stored(mapped(texts, _names, f"id {kind}, row long, node long, n long, tokens array<long>, times array<long>"), "sets")
    names = found.where("row is not null").select("id", "row", "node", "n")
    nodes = stored(names.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.first("n").alias("n")), "nodes", small=True)
    counted = found.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "times")).alias("t")).groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.times").alias("n"))
    top = counted.where("n > 2").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    frequent, counts = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by_value = frequent.argsort()
    place = np.lexsort((frequent[by_value], counts[by_value])).argsort()
    send = spark.sparkContext.broadcast((frequent[by_value], place))
    prefixes = stored(mapped(texts.select("text"), _prefixes(send, percent), "node long, prefix binary"), "prefixes")
    posting = "token long, node long, place int"
    # Sides that are aggregations by the join's own key are stored first: adaptive execution then splits a hot key's rows.
    shared = stored(mapped(prefixes, _postings(), posting).groupBy("token").count().where("count > 1").select("token"), "tokens")
    raw = stored(mapped(prefixes, _postings(Sieve(shared, "token")), posting).join(shared, "token"), "postings")
    mixed = stored(raw.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token"), "mixed")
    held = stored(raw.join(mixed, "token").distinct(), "held")
    weight = held.groupBy("node").agg(F.count("*").alias("w"))  # as many rows as a set's prefix is long
    held, before = stored(held.join(weight, "node").join(nodes.select("node", "n"), "node"), "shared"), held
    drop(prefixes, shared, raw, mixed, before)

    def fits(p: str, q: str) -> Column:
        """Whether sets of sizes p+n and q+n can be similar if their first common token is at p+place and q+place."""
        left = F.least(F.col(f"{p}n") - F.col(f"{p}place"), F.col(f"{q}n") - F.col(f"{q}place"))
        return left * (100 + percent) >= (F.col(f"{p}n") + F.col(f"{q}n")) * percent

    centre = held.groupBy("token").agg(F.max(F.struct("w", "node", "n", "place")).alias("top")).select("token", *(F.col(f"top.{a}").alias(b) for a, b in (("node", "c"), ("n", "c_n"), ("place", "c_place"))))
    centre = stored(centre, "centres")
    pairs = held.join(centre, "token").where((F.col("c") != F.col("node")) & fits("", "c_")).select("c", F.col("node").alias("v")).distinct()
    pairs = stored(pairs, "pairs", small=True)
    drop(centre)
    joined = components(_compared(pairs, nodes, texts, percent))
    labelled = held.join(joined, "node", "left").select(F.col("token").alias("key"), "node", "n", "place", F.coalesce("component", "node").alias("k"))
    rest = _open_pairs(labelled, lambda wanted: _texts_of(wanted, nodes, texts, percent)[1], fits("", "o_"))
    done = pairs.select(F.least("c", "v").alias("c"), F.greatest("c", "v").alias("v"))
    rest = stored(rest.join(done, ["c", "v"], "left_anti"), "rest", small=True)
    if not rest.isEmpty():
        more = _compared(rest, nodes, texts, percent)
        joined = components(more.union(joined.select(F.col("node").alias("hi"), F.col("component").alias("lo"))))
    drop(held, pairs, rest)
    label = nodes.join(joined, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("k"))
    least = stored(label.groupBy("k").agg(F.min("rep").alias("component_id")), "least", small=True)
    return found, stored(label.join(least, "k").select("node", "component_id", "k"), "labels", small=True)


def keep_one(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, columns as they were, with one row of each component: that of the least id, the first of its equals.

    Rows with a null id and a similar text are one group like any other, and every row without words stays. An empty
    table stays empty.
    """
    row, kept = fresh(docs, "row"), fresh(docs, "kept")
    rows = numbered(docs, row)
    found = _join(rows, row, percent, id_column, text)
    first = found.groupBy("group").agg(F.min(F.struct(F.col(id_column).isNull(), id_column, "row")).alias("one")).select(F.col("one.row").alias(kept))
    return rows.join(stored(first, "kept", small=True).hint("merge"), F.col(row) == F.col(kept), "left_semi").drop(row)
