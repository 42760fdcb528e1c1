"""Secret scan: base patterns plus a guess-cost judgement of values in credential contexts.

The guess cost of a value is the cheapest way to write it as words, dates, repeats, keyboard walks and brute-force
spans, found by dynamic programming over its positions. Scanning happens where a text was read; no exchange.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, text_slices

# The base patterns, the least length of what they keep, and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]

#: Further credential contexts, whose values the guess cost judges. A value ends at a space, a quote or a bracket.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pwd|pass|passphrase|passcode|passwd|password|credentials?|auth|bearer|secret|token|api_?key|(?:private|access|secret|signing|encryption)_?key|client_?secret)["']?\x20*(?:[:=]>?|:=)\x20*["']?([^\s"'<>,;()\[\]{}]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_HINT = re.compile("pass|pwd|secret|token|key|auth|bearer|cred", re.IGNORECASE | re.ASCII)
#: log10 of the guesses from which a value is taken for a secret.
LEAST_COST = 8.0

# Common words of passwords and placeholders, put together for this scan, roughly most common first.
WORDS = """
password pass admin login welcome letmein qwerty monkey dragon master user test guest root secret changeme default
example sample demo token key your my the here none null true false value string todo abc love hello sunshine
princess football baseball shadow superman batman summer winter spring autumn monday friday january august
company office server database mysql oracle postgres redis local host prod production dev staging public private
access account service system temp placeholder insert replace enter change random hidden redacted removed
""".split()


@lru_cache(maxsize=1)
def _ranks() -> tuple[dict[str, float], int]:
    """log10 of the guesses for each listed word, and the longest word's length.

    Behind WORDS come the whole words of four letters or more of the public word vocabulary, most frequent first.
    """
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = (t[: -len("</w>")] for t in sorted(vocab, key=vocab.__getitem__) if t.endswith("</w>"))
    words = dict.fromkeys([*WORDS, *(w for w in whole if len(w) >= 4 and w.isascii() and w.isalpha())])
    return {w: math.log10(i + 2) for i, w in enumerate(words)}, max(map(len, words))


#: Rows of the usual keyboard, each a little to the right of the one above: a key touches two of the next row.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _keyboard() -> dict[tuple[str, str], tuple[int, int]]:
    """The direction of a step from one key to a neighbour."""
    at = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {(a, b): (x - u, y - v) for a, (u, v) in at.items() for b, (x, y) in at.items() if (x - u, y - v) in ((1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (1, -1))}


#: The two kinds of walks: over the keyboard, and along the alphabet.
WALKS = (_keyboard(), {(a, b): step for step, order in ((1, ALPHABET), (-1, ALPHABET[::-1])) for a, b in zip(order, order[1:])})
_LEET = str.maketrans("013457@$!", "oieastasi")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
#: log10 of: days in two centuries, years in them, one more segment.
DATE, YEAR, SEGMENT = math.log10(365 * 200), math.log10(200), math.log10(2)
#: log10 of: a walk's first key and direction, each further key, each turn; and how many keys a walk has at least.
WALK, STEP, TURN, LEAST_WALK = math.log10(47 * 6), math.log10(1.2), math.log10(5), 3
#: The longest block that counts as a repeat when it comes again at once.
PERIOD = 12


def _alphabet(c: str) -> float:
    return math.log10(26 if c.isascii() and c.isalpha() else 10 if c.isascii() and c.isdigit() else 33 if c.isascii() else 1000)


def _lower(value: str) -> str:
    return value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)


def segments(value: str, i: int, low: str, leet: str) -> Iterator[tuple[int, float]]:
    """(end, cost) of the listed words, dates and repeats that begin at i.

    A word may be capitalised or have digits for letters. A repeat is one character three times or more, or a block
    of up to PERIOD characters twice or more, from where its run begins; it costs its block and their number.
    """
    n = len(value)
    ranks, longest = _ranks()
    for j in range(i + 3, min(n, i + longest) + 1):
        if (rank := ranks.get(low[i:j])) is not None:
            yield j, rank + (0.0 if value[i:j] == low[i:j] else SEGMENT)
        elif (rank := ranks.get(leet[i:j])) is not None:
            yield j, rank + 2 * SEGMENT
    if value[i].isdigit() and (m := _DATE.match(value, i)):
        yield m.end(), YEAR if m.end() - i == 4 else DATE
    for p in range(1, min(PERIOD, (n - i) // 2) + 1):
        if value[i] == value[i + p] and (i == 0 or value[i - 1] != value[i - 1 + p]) and value[i : i + p] == value[i + p : i + 2 * p]:
            j, block = i + 2 * p, _alphabet(value[i]) if p == 1 else guess_cost(value[i : i + p])
            while True:
                if p > 1 or j - i > 2:
                    yield j, block + math.log10((j - i) // p)
                if value[j : j + p] != value[i : i + p]:
                    break
                j += p


@lru_cache(maxsize=20_000)
def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation; 0 for an empty value. Time is linear in the length.

    A segment is a listed word, a date, a repeat (see segments()), a walk of LEAST_WALK keys or more over neighbours
    on the keyboard or in the alphabet, which pays for its turns, or a brute-force span, which pays for each
    character, as letters that no list holds do. Every segment after the first costs a factor of 2 more.
    """
    n, low = len(value), _lower(value)
    leet = low.translate(_LEET)
    best, force = [math.inf] * (n + 1), [math.inf] * (n + 1)  # force: the last segment is a brute-force span
    # For each kind: the last segment is a walk of 1, 2, ... or at least LEAST_WALK keys.
    walks = [[[math.inf] * (n + 1) for _ in range(LEAST_WALK)] for _ in WALKS]
    best[0] = 0.0
    for i in range(n):
        start = best[i] + (SEGMENT if i else 0.0)
        force[i + 1] = min(force[i], start) + _alphabet(value[i])
        for walk, steps in zip(walks, WALKS):
            walk[0][i + 1] = start + WALK
            if i and (step := steps.get((low[i - 1], low[i]))) is not None:
                turned = TURN if i > 1 and steps.get((low[i - 2], low[i - 1])) != step else 0.0
                for k in range(1, LEAST_WALK):
                    walk[k][i + 1] = walk[k - 1][i] + STEP + (turned if k > 1 else 0.0)
                walk[-1][i + 1] = min(walk[-1][i + 1], walk[-1][i] + STEP + turned)
        best[i + 1] = min(best[i + 1], force[i + 1], *(walk[-1][i + 1] for walk in walks))
        start = best[i] + (SEGMENT if i else 0.0)
        for j, cost in segments(value, i, low, leet):
            best[j] = min(best[j], start + cost)
    return best[n]


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, log10 guesses) of a text, by start, then kind as listed; offsets in code points.

    Base spans have their kind's own patterns, leftmost and not overlapping within a kind, short matches dropped
    after matching. A `guess` span is a value in a credential context that costs LEAST_COST or more to guess and
    overlaps no base span. Base spans carry a cost of 0. Null and empty texts have none.
    """
    if not text:
        return []
    spans = []
    hinted = _HINT.search(text) is not None
    if hinted:
        spans += [("assign", *m.span(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span(), 0.0) for m in HEX.finditer(text)]
    if hinted:
        base = sorted((a, b) for _, a, b, _ in spans)
        reach = [0, *accumulate((b for _, b in base), max)]  # how far the first k of them go
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?")
            a, b = m.start(1), m.start(1) + len(value)
            if reach[bisect_left(base, (b, 0))] <= a and (cost := guess_cost(value)) >= LEAST_COST:
                spans.append(("guess", a, b, cost))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None) -> str | None:
    """The text with each secret replaced by [secret]; overlapping spans are replaced as one. Null stays null."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end, cost>>) for every row of docs, repeated rows included.

    Texts that are null or empty have an empty array; an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            spans = [[dict(zip(("kind", "start", "end", "cost"), s)) for s in find(t)] for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(spans, _SPAN)], [id_column, "spans"])

    return mapped(docs.select(id_column, text), run, f"`{id_column}` {kind}, spans array<struct<kind:string,start:long,end:long,cost:double>>")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with the secrets of its texts replaced and, if it has one, its length column counted anew.

    Texts without secrets stay as they are, also null and empty ones; all rows stay, repeated ones included.
    """
    at = docs.columns.index(text)
    count = docs.columns.index(length) if length in docs.columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            old, columns = part.column(at).to_pylist(), list(part.columns)
            new = [redact(t) for t in old]
            columns[at] = pa.array(new, part.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([n if a is b else len(b) for a, b, n in zip(old, new, part.column(count).to_pylist())], part.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return mapped(docs, run, schema)
