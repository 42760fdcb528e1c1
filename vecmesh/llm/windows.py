"""Rolling hashes of byte strings and the anchors of fixed-length windows, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

from .common import mix64
from .shingles import powers

_RNG = np.random.default_rng(20231107)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = np.uint64((1 << 26) - 1)
STEP = 1 << 24


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes P modulo 2**64: P[b] - P[a] is the hash of raw[a:b] times base**a."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of raw[start:end] for each pair, mixed with its length."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i, by block-wise running minima."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.uint64(2**64 - 1))
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(prefix: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows within texts: (text, anchor, first, last), one row per anchor.

    A window's anchor is the start of its gram with the least hash, the leftmost of equals, so equal windows have
    their anchors at the same place. first and last are the least and the largest start of the windows it anchors,
    which are all the starts between them. Beyond STEP bytes the work goes on step by step; an anchor whose windows
    lie in two steps has two rows then.
    """
    n = len(prefix) - 1
    parts = [_anchors(prefix, base, min(n, base + STEP + window - 1), offsets, window, gram) for base in range(0, max(n - window + 1, 0), STEP)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *column]) for column in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4


def _anchors(prefix: np.ndarray, base: int, end: int, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchors() of the windows that lie within bytes base to end."""
    count = end - base - gram + 1
    keys = prefix[base + gram : end + 1] - prefix[base : base + count]
    keys *= powers(len(prefix))[1][base : base + count]  # the high bits of the product are the ones that are mixed
    keys &= ~_POSITION
    keys |= np.arange(count, dtype=np.uint64)
    where = (sliding_minimum(keys, window - gram + 1) & _POSITION).astype(np.int64)
    offsets = np.clip(offsets, base, end) - base
    valid = np.zeros(len(where) + 1, np.int64)
    a, b = offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1])
    np.add.at(valid, np.minimum(a, len(where)), 1)
    np.add.at(valid, np.minimum(b, len(where)), -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    text = np.searchsorted(offsets, starts, side="right") - 1
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (where[starts[1:]] != where[starts[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return text[first], where[starts[first]] + base, starts[first] + base, starts[last] + base
