"""Exact substring dedup: remove the bytes covered by any string of `window` bytes that also starts elsewhere.

Every window has an anchor, its gram of least hash, so equal windows share the anchor's hash and only anchors whose
hash comes twice matter. The windows of an anchor form one context, their union. A context that comes twice is
removed whole. The other distinct contexts of an anchor hash are where repeats begin or end: what lies right of the
anchor, and reversed what lies left of it, is suffix-sorted by merging, where prefix polynomial hashes and a binary
search give the common extension of two suffixes in logarithmically many steps; neighbours' extensions are verified
byte by byte. Least extensions between two places in the sorted orders are those of any pair, and a pair that
agrees on `window` bytes around the anchor marks them as repeated.

An anchor hash with more than GROUP distinct contexts isn't gathered: hashes of blocks of its windows, and of single
windows where blocks differ, are counted instead, by aggregations that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sieve, fresh, mapped, mix64, numbered, scratch, stored, text_bytes, text_slices
from .shingles import SLICE_BYTES, powers
from .windows import anchors, prefix_hashes, substring_hashes

WINDOW = 200
GRAM = 64
GROUP = 256
BLOCK = 8
#: Contexts that a task sorts at once, whole groups together.
SORTED = 20_000
_CODEC = "zstd"


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The common extension of the suffixes at a and b, `most` at most, by binary search on prefix hashes."""
    _, down = powers(len(prefix))
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = (prefix[a + middle] - prefix[a]) * down[a] == (prefix[b + middle] - prefix[b]) * down[b]
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def suffix_sort(raw: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings raw[start:end] within each group, given by `bounds`: (order, common).

    A bottom-up mergesort over all groups at once: an element's place in a merged run is its own plus its rank in
    the sister run, found by binary search with hash-compared suffixes. common[i] is the extension that the i-th
    string in order shares with the one before it in its group, 0 at a group's first; it is verified by bytes.
    """
    prefix = prefix_hashes(raw)
    order = np.arange(len(start))
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    base, size = bounds[:-1][group], np.diff(bounds)[group]

    def less(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether string x comes before y; equal ones as `ties` says."""
        nx, ny = end[x] - start[x], end[y] - start[y]
        most = np.minimum(nx, ny)
        n = extension(prefix, start[x], start[y], most)
        inside = n < most
        cx, cy = raw[np.where(inside, start[x] + n, 0)], raw[np.where(inside, start[y] + n, 0)]
        return np.where(inside, cx < cy, np.where(nx == ny, ties, nx < ny))

    width = 1
    while width < size.max(initial=0):
        at = np.flatnonzero(size > width)
        inner = at - base[at]
        run = inner // width
        own = inner - run * width
        sister = (run ^ 1) * width
        low = np.minimum(sister, size[at])
        high = np.minimum(sister + width, size[at])
        begin, right = low.copy(), run % 2 == 1
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            other = order[base[at] + middle]
            before = less(other, order[at], right)
            low = np.where(open_ & before, middle + 1, low)
            high = np.where(open_ & ~before, middle, high)
        place = base[at] + (run // 2) * 2 * width + own + low - begin
        merged = order.copy()
        merged[place] = order[at]
        order, width = merged, width * 2
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        x, y = order[1:], order[:-1]
        inner = np.flatnonzero(group[1:] == group[:-1])
        x, y = x[inner], y[inner]
        n = extension(prefix, start[x], start[y], np.minimum(end[x] - start[x], end[y] - start[y]))
        for part in range(0, len(n), 4096):  # verify: bytes decide where hashes collided
            p = slice(part, part + 4096)
            span = np.arange(max(1, n[p].max(initial=0)))
            used = span < n[p][:, None]
            differ = (raw[np.where(used, start[x[p]][:, None] + span, 0)] != raw[np.where(used, start[y[p]][:, None] + span, 0)]) & used
            n[p] = np.where(differ.any(axis=1), differ.argmax(axis=1), n[p])
        common[inner + 1] = n
    return order, common


def _pairwise(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The extension between any two of one group's strings: the least between their places in order."""
    m = len(order)
    out = np.full((m, m), np.iinfo(np.int64).max)
    for i in range(m - 1):
        out[i, i + 1 :] = np.minimum.accumulate(common[i + 1 :])
    out = np.minimum(out, out.T)
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    return out[np.ix_(back, back)]


def _resolve(window: int):
    """Over contexts sorted by anchor hash: the repeated byte ranges (row, start, end) of those that come once."""

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        keys = [r[0] for r in rows]
        bounds = np.array([0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)])
        sides = []
        for texts in ([r[5] for r in rows], [r[4][::-1] for r in rows]):
            ends = np.cumsum([len(t) for t in texts])
            raw = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
            sides.append(suffix_sort(raw, ends - np.array([len(t) for t in texts]), ends, bounds))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            right, left = (_pairwise(order[a:b] - a, common[a:b]) for order, common in sides)
            met = left + right >= window
            np.fill_diagonal(met, False)
            for i in np.flatnonzero(met.any(axis=1)):
                if rows[a + i][1]:
                    _, _, row, anchor, *_ = rows[a + i]
                    spans = sorted({(anchor - int(left[i, j]), anchor + int(right[i, j])) for j in np.flatnonzero(met[i])})
                    out += [(row, s, e) for s, e in merge(spans)]
        row, start, end = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, start, end)], ["row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("gram", "once", "row", "anchor", "left", "right")))
            while len(held) >= SORTED:
                cut = len(held) - 1
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if not cut:
                    break
                yield ranges(held[:cut])
                held = held[cut:]
        if held:
            yield ranges(held)

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs; those that touch are one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _grams(window: int, gram: int, sieve: Sieve | None = None):
    """The hashes of all anchors' grams; with a sieve, the anchors and contexts of those that it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            raw, offsets = text_bytes(part.column("text"))
            prefix = prefix_hashes(raw)
            text, anchor, first, last = anchors(prefix, offsets, window, gram)
            names = substring_hashes(prefix, anchor, anchor + gram)
            if sieve is None:
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64))], ["gram"])
                continue
            some = np.flatnonzero(sieve.passes(names))
            text, anchor, first, last = (x[some] for x in (text, anchor, first, last))
            grams = pa.array(names[some].view(np.int64))
            context = mix64(substring_hashes(prefix, first, last + window) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rows = part.column("row").to_numpy()[text]
            base = offsets[text]
            arrays = [grams, pa.array(context.view(np.int64)), pa.array(rows), *(pa.array((x - base).astype(np.int32)) for x in (anchor, first, last))]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "context", "row", "anchor", "first", "last"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the exchange; null as empty."""
    codec = pa.Codec(_CODEC, 1)
    for part in text_slices(batches, "text"):
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([len(t) for t in texts], pa.int64()), packed], ["row", "n", "packed"])


def _unpacked(part: pa.RecordBatch) -> list[bytes]:
    codec = pa.Codec(_CODEC)
    return [codec.decompress(p, n, asbytes=True) if n else b"" for p, n in zip(part.column("packed").to_pylist(), part.column("n").to_pylist())]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from text_slices(batches, "packed", SLICE_BYTES)


def _contexts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out = []
            for row, text, found in zip(part.column("row").to_pylist(), _unpacked(part), part.column("found").to_pylist()):
                for f in found:
                    a, b, c = f["anchor"], f["first"], f["last"] + window
                    out.append((f["gram"], f["copies"] == 1, row, a, text[b:a], text[a:c], f["kinds"]))
            for at in range(0, len(out), 20_000):
                gram, once, row, anchor, left, right, kinds = zip(*out[at : at + 20_000])
                arrays = [pa.array(gram, pa.int64()), pa.array(once), pa.array(row, pa.int64()), pa.array(anchor, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(kinds, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "once", "row", "anchor", "left", "right", "kinds"])

    return run


def _window_blocks(window: int):
    """Over contexts: their windows in blocks of BLOCK by distance before the anchor, `low` to `low` + size - 1.

    hashes are those of the windows, core that of the bytes which any window of the block holds. row is null for
    contexts that come twice, as their windows are removed already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                left, right = part.column("left").to_pylist(), part.column("right").to_pylist()
                before, sizes = np.array([len(t) for t in left], np.int64), np.array([len(a) + len(b) for a, b in zip(left, right)], np.int64)
                starts = np.cumsum(sizes) - sizes
                prefix = prefix_hashes(np.frombuffer(b"".join([a + b for a, b in zip(left, right)]), np.uint8))
                least = before - (sizes - window)  # the distance of a context's last window
                first = least // BLOCK
                counts = before // BLOCK - first + 1
                which = np.repeat(np.arange(len(left)), counts)
                block = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]
                anchor = (starts + before)[which]
                core = substring_hashes(prefix, anchor - block * BLOCK, anchor - block * BLOCK - BLOCK + 1 + window)
                low, high = np.maximum(block * BLOCK, least[which]), np.minimum(block * BLOCK + BLOCK - 1, before[which])
                span = np.repeat(np.arange(len(block)), high - low + 1)
                bounds = np.concatenate([[0], np.cumsum(high - low + 1)])
                start = anchor[span] - (low[span] + np.arange(bounds[-1]) - bounds[:-1][span])
                hashes = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(substring_hashes(prefix, start, start + window).view(np.int64)))
                once = part.column("once").to_numpy(zero_copy_only=False)
                arrays = [pa.array(part.column("gram").to_numpy()[which]), pa.array(block.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(low.astype(np.int32)), hashes]
                arrays += [pa.array(part.column("row").to_numpy()[which], mask=~once[which]), pa.array(part.column("anchor").to_numpy()[which])]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "block", "core", "low", "hashes", "row", "anchor"])

    return run


def _by_counting(parts: DataFrame, window: int) -> DataFrame:
    """The repeated ranges (row, start, end) of contexts, by counts of blocks and of windows; nothing is gathered.

    A block whose core comes once has no repeated window. One whose windows all come twice together is repeated
    whole. Single windows are only counted where blocks of one core differ.
    """
    key = ["gram", "block", "core"]
    blocks = stored(mapped(parts, _window_blocks(window), "gram long, block int, core long, low int, hashes array<long>, row long, anchor int").withColumn("all", F.xxhash64("low", "hashes")), "blocks")
    kinds = blocks.groupBy(*key, "all").agg(F.count("*").alias("n"), F.min(F.struct("row", "anchor")).alias("one"), F.first("low").alias("low"), F.first("hashes").alias("hashes"))
    kinds = stored(kinds, "kinds", small=True)
    again = kinds.where("n > 1").select(*key, "all")
    at, size = F.col("anchor") - F.col("low"), F.size("hashes")
    whole = blocks.where("row is not null").join(again, [*key, "all"], "left_semi").select("row", (at - size + 1).cast("long").alias("start"), (at + window).cast("long").alias("end"))
    differ = kinds.groupBy(*key).count().where("count > 1").select(*key)
    single = kinds.join(differ, key).select("gram", "low", F.when(F.col("n") == 1, F.col("one")).alias("one"), F.posexplode("hashes").alias("step", "hash"))
    single = stored(single.select("gram", "hash", "one.row", (F.col("one.anchor") - F.col("low") - F.col("step")).cast("long").alias("start")), "windows")
    twice = single.groupBy("gram", "hash").count().where("count > 1").select("gram", "hash")
    return whole.union(single.where("row is not null").join(twice, ["gram", "hash"], "left_semi").select("row", "start", (F.col("start") + window).alias("end")))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """Rows (row, spans array<struct<start, end>>): for the rows of docs that hold repeats, byte ranges that cover them.

    `row` is that of numbered(). Null and empty texts hold none, rows that repeat hold each other's.
    """
    row = fresh(docs, "row")
    return _repeats(numbered(docs, row).select(F.col(row).alias("row"), F.col(text).alias("text")), window, gram)


def _repeats(source: DataFrame, window: int, gram: int) -> DataFrame:
    """repeats() of source (row, text)."""
    # Sides aggregated by a join's own key are stored first, so that adaptive execution may split a hot key's rows.
    shared = stored(mapped(source.select("text"), _grams(window, gram), "gram long").groupBy("gram").count().where("count > 1").select("gram"), "grams", small=True)
    kind = "gram long, context long, row long, anchor int, first int, last int"
    held = stored(mapped(source, _grams(window, gram, Sieve(shared, "gram")), kind).join(shared, "gram"), "anchors")
    contexts = stored(held.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("row", "anchor", "first", "last")).alias("one")), "contexts")
    whole = held.join(contexts.where("copies > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    whole = whole.select("row", F.col("first").cast("long").alias("start"), (F.col("last") + window).cast("long").alias("end"))
    kinds = stored(contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several", small=True)
    open_ = contexts.join(kinds, "gram").select("one.row", F.struct("gram", "copies", "kinds", "one.anchor", "one.first", "one.last").alias("f"))
    found = open_.groupBy("row").agg(F.collect_list("f").alias("found"))  # as many as the row's text has anchors
    packed = mapped(source, _packed, "row long, n long, packed binary")
    parts = mapped(packed.join(found, "row"), _contexts(window), "gram long, once boolean, row long, anchor int, left binary, right binary, kinds long")
    parts = stored(parts, "edges")
    few = parts.where(F.col("kinds") <= GROUP).drop("kinds").repartition("gram").sortWithinPartitions("gram")
    span = "row long, start long, end long"
    few = mapped(few, _resolve(window), span)
    many = _by_counting(parts.where(F.col("kinds") > GROUP).drop("kinds"), window)
    return whole.union(few).union(many).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept binary) for all rows of docs; kept are the bytes that remain.

    Null texts count as empty. Repeated rows repeat each other's bytes. Texts under `window` bytes stay whole. An
    empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    row = fresh(docs, "row")
    names = numbered(docs.select(id_column, text), row).select(F.col(id_column).alias("id"), F.col(row).alias("row"), F.col(text).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            (packed,) = _packed(iter([part]))
            yield pa.RecordBatch.from_arrays([part.column("id"), *packed.columns], ["id", *packed.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows = []
            for whole, found in zip(_unpacked(part), part.column("spans").to_pylist()):
                spans = merge(sorted((s["start"], s["end"]) for s in found or ()))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(whole[at:s])
                    at = e
                rows.append((len(whole), sum(e - s for s, e in spans), len(spans), b"".join([*kept, whole[at:]])))
            n, removed, spans, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary())], [id_column, "n_bytes", "n_removed", "n_spans", "kept"])

    kept: list[DataFrame] = []
    with scratch(kept):
        spans = stored(_repeats(names.select("row", "text"), window, gram), "spans")
        kept.append(spans)
    packed = mapped(names, pack, f"id {kind}, row long, n long, packed binary")
    return mapped(packed.join(spans, "row", "left").select("id", "n", "packed", "spans"), cut, f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
