"""SentencePiece encoding and decoding over a distinct-chunk table.

In a model whose pieces hold the white-space mark only at their start, no piece crosses from one marked word into
the next, so a text's ids are those of its marked words put side by side. Each task keeps a table from marked word
to its ids and its decoded form, asks the library for a word only when the table lacks it, and joins the entries
back by position. Texts stay in the task that read them: there is no exchange.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Table, mapped, text_slices

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
STOPS = ".,;:!?*$%&#|"


class ChunkTable(Table):
    """Marked word -> (ids as int32 bytes, decoded form with a space for each mark), filled from the library on demand."""

    most = 400_000

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()) if not self.lib.is_byte(i) and not self.lib.is_control(i)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space mark")
        if self.lib.normalize("a  Å①") != f"{MARK}a{MARK}{MARK}Å①":
            raise ValueError("this model rewrites texts before it segments them")
        self.mark_id = self.lib.piece_to_id(MARK)
        self.anchor = self.lib.encode("a")
        # A line end that no piece holds stands alone too, so words end there as well.
        self.line_end = "" if any("\n" in p for p in pieces) else "\n"
        # So does a stop behind a letter, where no piece holds a letter and then that stop.
        stops = "".join(s for s in STOPS if not any(re.search(f"[{LETTERS}]{re.escape(s)}", p) for p in pieces))
        cut = f"[{LETTERS}]+(?=[{re.escape(stops)}])|" if stops else ""
        first = f"[{MARK}]+" if not self.line_end else f"(?:{MARK}+|\n)"
        rest = f"[^{MARK}{self.line_end}]"
        self.pattern = re.compile("|".join([f"{first}{c}" for c in (cut[:-1], f"{rest}*") if c] + [f"{rest}+"]))

    def make(self, chunk: str) -> tuple[bytes, str]:
        return self._made([chunk])[0]

    def _made(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Entries from the library. It puts a mark in front itself, so a chunk's own first mark is left out; before a
        line end that mark, and before a stop a letter, stands apart and its ids are dropped again."""
        sent = [c[1:] if c[0] == MARK else c if c[0] == "\n" else f"a{c}" for c in chunks]
        found = self.lib.encode(sent, num_threads=1)
        for k, c in enumerate(chunks):
            if c == MARK:
                found[k] = [self.mark_id]
            elif c[0] != MARK:
                lead = [self.mark_id] if c[0] == "\n" else self.anchor
                if found[k][: len(lead)] != lead:
                    raise ValueError("a piece joined what none holds together")
                del found[k][: len(lead)]
        decoded = self.lib.decode([[*self.anchor, *ids] for ids in found], num_threads=1)
        return [(array("i", ids).tobytes(), text[1:]) for ids, text in zip(found, decoded)]

    def fill(self, chunks: set[str]) -> None:
        """Make all entries that the table lacks in one call."""
        missing = [c for c in chunks if c not in self and c not in self.older and len(c) <= self.longest]
        for k in range(0, len(missing), 10_000):
            for c, entry in zip(missing[k : k + 10_000], self._made(missing[k : k + 10_000])):
                self.keep(c, entry)

    def chunks(self, text: str | None) -> list[str]:
        """The marked words of a text, in order; none for an empty or null one."""
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []


def encode(docs: DataFrame, model_file: str, end: bool = True, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, decoded string) for every row of docs: the ids, with an end id if asked, and their decoding.

    Null texts count as empty: no ids but the end id, and an empty decoding. Repeated rows give repeated rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = None, b""
        for part in text_slices(batches, text):
            if table is None:
                table = ChunkTable(model_file)
                last = np.array([table.lib.eos_id()] if end else [], np.int32).tobytes()
            chunks = [table.chunks(value) for value in part.column(text).to_pylist()]
            table.fill(set().union(*chunks))
            ids, decoded = [], []
            for own in chunks:
                found = [table[c] for c in own]
                ids.append(b"".join([i for i, _ in found]) + last)
                decoded.append("".join([s for _, s in found])[1:])
            offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(id_column), lists, pa.array(decoded, pa.string())], [id_column, "ids", "decoded"])

    return mapped(docs.select(id_column, text), run, f"`{id_column}` {kind}, ids array<int>, decoded string")
