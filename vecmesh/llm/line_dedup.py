"""Line dedup with a log-template tree.

A line's tokens with digits are variable fields. The tree has a fixed depth: the number of tokens, then the leading
tokens. Within a leaf, a token that stands at its place in enough documents' lines is fixed, any other generalises to
a variable field; a line's template is what is fixed in it, as long as that is most of it. Lines of a template that
recurs in many documents are dropped, all but its first. Where the values of a field are frequent themselves, a
template that recurs too rarely is generalised by one more field, together with those that differ there alone.
A long line is dropped from its second document on, if word for word the same; digits aren't variable there.

A template is the exclusive or of its fixed tokens' hashes, so one without some token follows from it. All steps are
aggregations and joins by key, whose aggregated sides are stored first: no leaf, template or token is gathered, and
what is dropped depends on the lines alone, neither on their order nor on how large a leaf is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Sieve, Table, fresh, mapped, numbered, scratch, stored, text_slices

DEPTH = 3
LEAST_TOKENS = 3
LEAST_DOCS = 10
#: Words from which a line that stands in LONG_DOCS documents is dropped.
LONG_TOKENS, LONG_DOCS = 50, 2
#: Share of a line's places that its template must have in common with it.
SIMILAR = 0.7
FIELD = "<*>"
_VARIABLE = re.compile(r"\S*\d\S*")
_DIGIT = re.compile(r"\d")


def tokens_of(line: str) -> list[str]:
    """A line's tokens, those with digits as variable fields."""
    return (_VARIABLE.sub(FIELD, line) if _DIGIT.search(line) else line).split()


def _hash(*tokens: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(tokens).encode()) - (1 << 63)


class TokenTable(Table):
    """Token -> its 64-bit hash."""

    most = 50_000

    def make(self, key: str) -> int:
        return _hash(key)


def _leaves(least: int):
    """Rows (leaf, long): for each text, once, the leaves of its lines of `least` tokens or more, and its long lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            leaves, long = [], []
            for text in part.column("text").to_pylist():
                own, same = set(), set()
                for line in text.split("\n") if text else ():
                    t = tokens_of(line)
                    if len(t) >= least:
                        own.add(_hash(str(len(t)), *t[:DEPTH]))
                    if len(t) >= LONG_TOKENS:
                        same.add(_hash("", *line.split()))
                leaves += own
                long += same
            yield pa.RecordBatch.from_arrays([pa.array(leaves + long, pa.int64()), pa.array([False] * len(leaves) + [True] * len(long), pa.bool_())], ["leaf", "long"])

    return run


def _lines(least: int, sieve: Sieve):
    """Rows (row, lines, leaf, long, masked, tokens): a text's distinct masked lines and, word for word, its long ones.
    Those of leaves that the sieve keeps back are left out.

    lines are the places at which it stands, masked names it, tokens are the hashes of those behind the leading ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable()
        for part in text_slices(batches, "text"):
            known: list[tuple] = []  # (row, place, leaf, tokens or, of a long line, None)
            for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist()):
                for k, line in enumerate(text.split("\n") if text else ()):
                    t = tokens_of(line)
                    if len(t) >= least:
                        known.append((row, k, _hash(str(len(t)), *t[:DEPTH]), t))
                    if len(t) >= LONG_TOKENS:
                        known.append((row, k, _hash("", *line.split()), None))
            found: dict[tuple, list[int]] = {}
            tokens: dict[tuple, list[int]] = {}
            for n in np.flatnonzero(sieve.passes(np.array([x[2] for x in known], np.int64).view(np.uint64))).tolist():
                row, k, leaf, t = known[n]
                key = (row, leaf, False, _hash(*t)) if t else (row, leaf, True, leaf)
                found.setdefault(key, []).append(k)
                if t and key not in tokens:
                    tokens[key] = [table[x] for x in t[DEPTH:]]
            rows, leaf, long, masked = zip(*found) if found else ((),) * 4
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, v)]), pa.int32()), pa.array(list(chain.from_iterable(v)), kind)) for v, kind in ((list(found.values()), pa.int32()), ([tokens.get(k, ()) for k in found], pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists[0], pa.array(leaf, pa.int64()), pa.array(long, pa.bool_()), pa.array(masked, pa.int64()), lists[1]], ["row", "lines", "leaf", "long", "masked", "tokens"])

    return run


def recurring(docs: DataFrame, least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS, similar: float = SIMILAR, keep_first: bool = True, text: str = "text") -> DataFrame:
    """Rows (row, lines array<int>): the lines to drop of those rows of docs that have any, by their places from 0.

    A line is dropped if its template stands in `least_docs` rows or more, or if it has LONG_TOKENS words or more and
    stands in LONG_DOCS rows; with keep_first the first of them, in the order of rows, stays. A token of a leaf is
    fixed if the lines that have it there, each counted with its number of rows, come to `least_docs`; a template
    has at most 1 - `similar` of its places as fields. Lines under `least_tokens` tokens and texts that are null or
    empty have none; rows that repeat are documents of their own. `row` is that of numbered().
    """
    row = fresh(docs, "row")
    found = _recurring(numbered(docs, row).select(F.col(row).alias("row"), F.col(text).alias("text")), least_docs, least_tokens, similar, keep_first)
    return found.select("row", F.array_union("lines", "long").alias("lines"))


def _recurring(source: DataFrame, least_docs: int, least_tokens: int, similar: float, keep_first: bool) -> DataFrame:
    """recurring() of source (row, text), long lines apart: (row, lines, long)."""
    line = ["leaf", "masked"]
    busy = mapped(source.select("text"), _leaves(least_tokens), "leaf long, long boolean").groupBy("leaf", "long").count()
    busy = stored(busy.where(F.col("count") >= F.when(F.col("long"), LONG_DOCS).otherwise(least_docs)).select("leaf", "long"), "busy", small=True)
    held = mapped(source, _lines(least_tokens, Sieve(busy, "leaf")), "row long, lines array<int>, leaf long, long boolean, masked long, tokens array<long>")
    held = stored(held.join(busy, ["leaf", "long"]), "lines")
    masked = held.where("not long")
    distinct = masked.groupBy(*line).agg(F.count("*").alias("docs"), F.first("tokens").alias("tokens"))
    places = stored(distinct.select(*line, "docs", F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("place", "token")), "places")
    cell = ["leaf", "place", "token"]
    fixed = stored(places.where("token is not null").groupBy(*cell).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select(*cell, F.xxhash64(*cell).alias("hash")), "fixed", small=True)
    cells = places.join(fixed, cell, "left")
    # A field more may come as long as `spare` isn't 0.
    spare = F.floor((F.col("n") + DEPTH) * (1 - similar) + 1e-9) - (F.col("n") - F.count("hash"))
    template = cells.groupBy(*line, "n").agg(F.coalesce(F.bit_xor("hash"), F.lit(0)).alias("t"), spare.alias("spare")).where("spare >= 0").select(*line, "t", "spare")
    template = stored(template, "templates", small=True)
    found = masked.join(template, line).select("leaf", "masked", "t", "spare", "row", "lines")
    same = held.where("long").select("leaf", "masked", F.col("masked").alias("t"), F.lit(-1).cast("long").alias("spare"), "row", "lines")
    found = stored(found.union(same), "found")
    docs_of = stored(found.groupBy("leaf", "t", "spare", "row").agg(F.lit(1)).groupBy("leaf", "t", "spare").agg(F.count("*").alias("docs")), "docs", small=True)
    sure = docs_of.where(F.col("docs") >= F.when(F.col("spare") < 0, LONG_DOCS).otherwise(least_docs))
    # One more field: a template is named by its hash without one token's; rare ones have fewer than least_docs rows each.
    open_ = template.where("spare > 0").select(*line, "t").join(cells.where("hash is not null").select(*line, "hash"), line).select("leaf", "t", "hash").distinct()
    wider = open_.select("leaf", "t", F.col("t").bitwiseXOR(F.col("hash")).alias("g")).union(docs_of.where("spare >= 0").select("leaf", "t", F.col("t").alias("g")))
    wider = stored(wider.join(docs_of.where("spare >= 0").select("leaf", "t", (F.col("docs") >= least_docs).alias("sure")), ["leaf", "t"]), "wider", small=True)
    rare = wider.where("not sure").select("leaf", "t", "g")
    by_sure = wider.where("sure").select("leaf", "g").distinct()
    rows = found.where("spare >= 0").select("leaf", "t", "row").distinct().join(rare, ["leaf", "t"]).select("leaf", "g", "row").distinct()
    enough = rows.groupBy("leaf", "g").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("leaf", "g")
    enough = stored(by_sure.union(enough).distinct(), "enough", small=True)
    merged = rare.join(enough, ["leaf", "g"]).groupBy("leaf", "t").agg(F.min("g").alias("g"))
    group = sure.select("leaf", "t", F.col("t").alias("g")).union(merged)
    group = stored(group, "groups", small=True)
    gone = found.join(group, ["leaf", "t"]).select("leaf", "g", "row", "lines", (F.col("spare") < 0).alias("same"))
    if keep_first:
        first = gone.groupBy("leaf", "g").agg(F.min(F.struct("row", F.array_min("lines").alias("line"))).alias("first"))
        gone = stored(gone, "gone")
        gone = gone.join(stored(first, "first", small=True), ["leaf", "g"]).select("row", "same", F.when(F.col("row") == F.col("first.row"), F.filter("lines", lambda x: x != F.col("first.line"))).otherwise(F.col("lines")).alias("lines"))
    all_of = lambda kind: F.array_distinct(F.flatten(F.collect_list(F.when(kind, F.col("lines")))))
    return gone.groupBy("row").agg(all_of(~F.col("same")).alias("lines"), all_of(F.col("same")).alias("long")).where(F.size("lines") + F.size("long") > 0)


def remove(docs: DataFrame, text: str = "text", length: str | None = "n_chars", counts: bool = False, spare_copies: bool = False, **options) -> DataFrame:
    """docs, columns as they were, without the recurring lines of its texts; its length column, if any, counted anew.

    Texts without such lines stay as they are, also null and empty ones; no row is left out, and an empty table stays
    empty. counts adds columns n_lines and n_dropped, in place of columns of these names. spare_copies leaves the long
    lines of a text that they are most of: it is a copy rather than a text with a passage, for others to judge whole.
    """
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    row, gone, lines, long = (fresh(docs, c) for c in ("row", "gone", "lines", "long"))
    rows = numbered(docs, row)
    defaults = {"least_docs": LEAST_DOCS, "least_tokens": LEAST_TOKENS, "similar": SIMILAR, "keep_first": True}
    kept: list[DataFrame] = []
    with scratch(kept):
        drop = _recurring(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), **(defaults | options))
        drop = stored(drop.select(F.col("row").alias(gone), F.col("lines").alias(lines), F.col("long").alias(long)), "drop", small=True)
        kept.append(drop)
    rows = rows.join(drop.hint("merge"), F.col(row) == F.col(gone), "left").drop(row, gone)
    at, size = docs.columns.index(text), len(docs.columns)
    count = docs.columns.index(length) if length in docs.columns else None
    extra = ["n_lines", "n_dropped"] if counts else []
    names = [*docs.columns, *extra]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            old, columns = part.column(at).to_pylist(), list(part.columns[:size])
            new, sizes, fewer = [], [], []
            for value, own, same in zip(old, part.column(size).to_pylist(), part.column(size + 1).to_pylist()):
                gone = set(own or ())
                parts = value.split("\n") if value else []
                if same and not (spare_copies and 2 * sum(len(parts[k]) for k in same) > len(value)):
                    gone.update(same)
                new.append("\n".join([p for k, p in enumerate(parts) if k not in gone]) if gone else value)
                sizes.append(len(parts)), fewer.append(len(gone))
            columns[at] = pa.array(new, part.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([len(b) if f else n for f, b, n in zip(fewer, new, part.column(count).to_pylist())], part.schema.field(count).type)
            if counts:
                columns += [pa.array(sizes, pa.int64()), pa.array(fewer, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in extra)])
    return mapped(rows, cut, schema)
