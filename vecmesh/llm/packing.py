"""Packing tokenised documents into fixed-length sequences by minimum bin slack.

A document's full windows go out as they are; what remains is shorter than a window. For a window, subset sums over
the multiset of remaining lengths are kept as the bits of one integer, length after length with binary splitting of
its count; the sum closest to the capacity is traced back to counts, and that filling is repeated for as long as its
counts last. Tasks pack what they read, block after block; rests that fill no window exactly wait for the next
block, and a task's last rest is cut so that its sequences are powers of two. There is no exchange, ids never leave
the task, and padding is none: sequences are full or have the length of a power of two.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Table, mapped, text_slices

CAPACITY = 2048
#: Ids that wait in a task until they are packed as one block.
BLOCK_IDS = 2_000_000
_WORD = re.compile(r"[^ \n\t\r]+")
# Texts of these characters alone split into units by _UNIT, whatever stands beside: no apostrophe, mark or special token.
_SIMPLE = re.compile(r"""[ \t\n\rA-Za-zÀ-ÖØ-öø-ÿ0-9.,;:!?*$%&#|+/=_()"@-]*""")
_UNIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|-]*)")


# In byte-level vocabularies these bytes stand for themselves, the others for characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class PartTable(Table):
    """A lower-case word of letters, a digit or a run of symbols -> its ids as bytes, straight from the tokeniser's model."""

    most = 250_000

    def __init__(self, lib):
        super().__init__()
        self.model = lib.model

    def make(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join([_BYTES[b] for b in part.encode()])
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()


class WordTable(Table):
    """Word -> its ids as little-endian unsigned 32-bit bytes. Words end at white space, which the tokeniser drops.

    Texts of simple characters are cut into the tokeniser's units at once. In others, letters with symbols behind
    them are two units; any other word goes through the whole tokeniser.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.lib = Tokenizer.from_file(tokenizer_file)
        self.parts = PartTable(self.lib)
        apart = self._whole("it is\tso\nnow")
        if apart != b"".join([self._whole(w) for w in ("it", "is", "so", "now")]):
            raise ValueError("this tokeniser doesn't drop white space")
        self.plain = all(self._whole(w) == self._parts(_PLAIN.fullmatch(w)) for w in ("Words", "Élan,", "off.!!", "a|", "Zß***", "naïve$$$"))
        self.plain = self.plain and self._whole("Él 20ßan=(x)") == b"".join([self.parts[u] for u in _UNIT.findall("él 20ßan=(x)")])

    def _whole(self, word: str) -> bytes:
        return np.array(self.lib.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _parts(self, found: re.Match) -> bytes:
        return self.parts[found[1].lower()] + (self.parts[found[2]] if found[2] else b"")

    def make(self, word: str) -> bytes:
        found = _PLAIN.fullmatch(word) if self.plain else None
        return self._parts(found) if found else self._whole(word)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain and _SIMPLE.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _UNIT.findall(text.lower())))
        return b"".join(map(self.__getitem__, _WORD.findall(text)))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset (length -> count) within `counts` that holds one of the longest and comes closest to `capacity`.

    Longer lengths are tried first and the search ends once the capacity itself is reached.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    if not lengths:
        return {}
    first, rest = lengths[0], capacity - lengths[0]
    mask, reach, layers = (1 << (rest + 1)) - 1, 1, []
    for n in lengths:
        left, take = min(counts[n] - (n == first), rest // n), 1
        while left > 0 and not reach >> rest & 1:
            take = min(take, left)
            layers.append((n, take, reach))
            reach |= reach << (n * take) & mask
            left, take = left - take, take * 2
        if reach >> rest & 1:
            break
    out, total = defaultdict(int, {first: 1}), reach.bit_length() - 1
    for n, take, before in reversed(layers):
        if not before >> total & 1:
            out[n] += take
            total -= n * take
    return dict(out)


def fillings(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings (length -> count, how often) until no exact one holds the longest that is left; `counts` keeps the rest."""
    stuck: dict[int, int] = {}
    while counts:
        one = fill(counts, capacity)
        if sum(n * c for n, c in one.items()) == capacity:
            times = min(counts[n] // c for n, c in one.items())
            yield one, times
        else:  # the longest can't be part of a full window now: set it aside
            one, times = {(longest := max(counts)): 1}, counts[max(counts)]
            stuck[longest] = times
        for n, c in one.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
    counts.update(stuck)


class Packer:
    """Takes documents' ids and gives pieces (doc, start, ids, doc_tokens, sequence, offset) of full sequences."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.rests: dict[int, list] = defaultdict(list)  # length -> [(doc, start, ids, doc_tokens)]
        self.waiting, self.fresh = 0, 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, width = len(ids) // 4, self.capacity * 4
        for at in range(0, len(ids), width):
            part = ids[at : at + width]
            if len(part) == width:
                yield doc, at // 4, part, total, self.sequence, 0
                self.sequence += 1
            else:
                self.rests[len(part) // 4].append((doc, at // 4, part, total))
                self.waiting += len(part) // 4
                self.fresh += len(part) // 4
        if self.fresh >= BLOCK_IDS:
            yield from self.pack()

    def pack(self) -> Iterator[tuple]:
        for one, times in fillings({n: len(v) for n, v in self.rests.items()}, self.capacity):
            for _ in range(times):
                yield from self._sequence([self.rests[n].pop() for n, c in one.items() for _ in range(c)])
        self.rests = defaultdict(list, {n: v for n, v in self.rests.items() if v})
        self.fresh, self.waiting = 0, sum(n * len(v) for n, v in self.rests.items())
        if self.waiting >= BLOCK_IDS:  # rests without an exact filling, such as equal lengths only: cut them
            yield from self._cut(self.waiting // self.capacity * self.capacity)

    def finish(self) -> Iterator[tuple]:
        """Pack all that waits; the last ids go into sequences of ever smaller powers of two."""
        yield from self.pack()
        yield from self._cut(self.waiting)

    def _cut(self, amount: int) -> Iterator[tuple]:
        queue = [p for n in sorted(self.rests, reverse=True) for p in self.rests[n]]
        queue.reverse()
        while amount:
            room = self.capacity if amount >= self.capacity else 1 << (amount.bit_length() - 1)
            amount, taken = amount - room, []
            while room:
                doc, start, ids, total = queue.pop()
                if len(ids) // 4 > room:
                    queue.append((doc, start + room, ids[room * 4 :], total))
                    ids = ids[: room * 4]
                room -= len(ids) // 4
                taken.append((doc, start, ids, total))
            yield from self._sequence(taken)
        self.rests = defaultdict(list)
        for p in queue:
            self.rests[len(p[2]) // 4].append(p)
        self.waiting = sum(len(p[2]) // 4 for p in queue)

    def _sequence(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: (id, start, length, ids binary, doc_tokens, sequence_id, offset).

    ids are a piece's token ids as little-endian unsigned 32-bit values. A document's ids end with end_id, so null
    and empty texts have that one id. Repeated rows are documents of their own. A sequence_id starts from the number
    of the input split, so a task that runs again gives the same ids.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two over 1")
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        table, end, type_, out, held = None, np.array([end_id], "<u4").tobytes(), None, [], 0

        def batch() -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*out)
            arrays = [pa.array(doc, type_), pa.array(start, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.int64()) for x in (total, sequence, offset))], names)

        def pieces() -> Iterator[tuple]:
            nonlocal table, type_
            for part in text_slices(batches, text):
                table, type_ = WordTable(tokenizer_file) if table is None else table, part.schema.field(id_column).type
                for doc, value in zip(part.column(id_column).to_pylist(), part.column(text).to_pylist()):
                    yield from packer.add(doc, table.ids(value) + end)
            yield from packer.finish()

        for piece in pieces():
            out.append(piece)
            held += len(piece[2])
            if held >= 4 << 20 or len(out) >= 10_000:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    return mapped(docs.select(id_column, text), run, f"`{id_column}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
