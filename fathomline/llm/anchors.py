"""Content-defined anchors: where equal stretches of text can meet."""

from __future__ import annotations

import numpy as np

from fathomline.llm.ngram_join import mix

GRAM = 32
PLACE_BITS = 24
BASE = 0x9E3779B97F4A7C15 | 1

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(12, n.bit_length())
    if size not in _powers:
        _powers.clear()
        steps = [np.full(size, b, dtype=np.uint64) for b in (BASE, pow(BASE, -1, 2**64))]
        for s in steps:
            s[0] = 1
        _powers[size] = tuple(np.multiply.accumulate(s) for s in steps)
    return _powers[size]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the least of values[i : i + width], from running minima of blocks to both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which any stretch's 64-bit polynomial hash follows."""
    up, _ = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])


def stretch_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[begin]) * down[begin], 3)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(key, first, last)`` of groups of windows of documents laid end to end.

    ``ends`` are the documents' ends in ``data``, of fewer than 2**24 bytes.
    The anchor of a window of ``length`` bytes is its gram of least hash, the
    first of equal ones. It depends on the window's bytes alone, so equal
    windows have equal anchors at equal offsets. The windows of one anchor are
    two groups: those that begin less than half a window before it all contain
    the half window from the anchor on, the others the half window up to the
    anchor's end; ``key`` hashes those bytes. ``first`` to ``last`` are the
    starts of a group's windows. Every window inside a document is in exactly
    one group. Different bytes may share a key; equal ones never differ in it.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none
    sums = prefix_sums(data)
    starts = np.arange(len(data) - GRAM + 1)
    grams = stretch_hash(sums, starts, starts + GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = (window_minima((grams & ~mask) | starts.astype(np.uint64), length - GRAM + 1) & mask).astype(np.int64)
    window = np.arange(len(place))
    doc = np.searchsorted(ends, window, side="right")
    inside = window + length <= ends[np.minimum(doc, len(ends) - 1)]
    begins = inside & np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(begins)
    stops = inside & np.concatenate([(place[1:] != place[:-1]) | ~inside[1:] | (doc[1:] != doc[:-1]), [True]])
    last = np.flatnonzero(stops)
    at = place[first]
    half = (length - GRAM) // 2
    begin = np.maximum(first, at - half)
    late = begin <= last
    stop = np.minimum(last, at - half - 1)
    early = first <= stop
    key = np.concatenate([stretch_hash(sums, at[late], at[late] + GRAM + half), stretch_hash(sums, at[early] - half, at[early] + GRAM) ^ np.uint64(0x5555555555555555)])
    return key, np.concatenate([begin[late], first[early]]), np.concatenate([last[late], stop[early]])
