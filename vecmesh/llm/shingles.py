"""Word shingles of whole texts as 64-bit hashes, vectorised over the UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, text_bytes

WIDTH = 5
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers that a worker keeps, as many as a slice needs; longer texts get theirs for as long as they take.
KEPT = SLICE_BYTES + (1 << 16)
_powers: list[np.ndarray] = []


def _made(n: int) -> list[np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if n > KEPT:
        up, down = _made(n)
        return up, down
    if not _powers:
        _powers.extend(_made(KEPT))
    return _powers[0], _powers[1]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, in order, and each text's number of words. Words are runs of [^\\x20\\x09-\\x0D]."""
    raw, offsets = text_bytes(column)
    n = len(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)  # a text starts here
    cut[offsets[:-1]] = True
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | cut[:-1]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    hashes = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[0])
    return hashes, np.bincount(np.searchsorted(offsets, start, side="right") - 1, minlength=n)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of distinct shingles, each sorted, one after the other, and the n + 1 offsets of the sets.

    A text of fewer than `width` words has its whole sequence as its only shingle; one without words has none.
    """
    words, counts = word_hashes(column)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    rolled = sum((padded[k : k + len(words)] * _MIX[1 + k] for k in range(1, width)), padded[: len(words)] * _MIX[1])
    at = np.arange(bounds[-1]) + np.repeat(firsts[:-1] - bounds[:-1], sizes)
    out = rolled[at] if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[firsts[i] : firsts[i + 1]]
        out[bounds[i]] = np.append(own * _MIX[1 : 1 + len(own)], _MIX[40 + len(own)]).sum()
    out = mix64(out)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[bounds]
