"""Synchronised positions of texts: every run of WINDOW bytes picks one by its content alone.

Each run of WINDOW bytes picks the leftmost of its grams (GRAM bytes) with the least hash. Equal
runs pick the same place in themselves, wherever they stand, so equal runs meet at equal grams,
and only about one position in 30 is ever picked.
"""

from __future__ import annotations

import numpy as np

from flowtide.llm.textbytes import BLOCK_BYTES, _power_tables, mix

GRAM = 40


def _pieces(n: int) -> list[tuple[int, int]]:
    """Ranges of run starts taken together, so that eight-byte arrays stay small."""
    return [(a, min(a + BLOCK_BYTES, n)) for a in range(0, n, BLOCK_BYTES)]


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of data[i:i + width] for every i."""
    up, down = _power_tables(len(data) + 1)
    n = len(data) - width + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[width:] - sums[:n]) * down[:n])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[i:i + width]) for every i, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def anchors(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`at`, `gram` hash, first and last run start (inclusive) of each position picked by some run.

    `data` is one text. Positions ascend; each run of `window` bytes belongs to one of them.
    """
    runs = len(data) - window + 1
    if runs <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for a, b in _pieces(runs):
        part = _piece(data[a : b + window - 1], window)
        found.append((part[0] + a, part[1], part[2] + a, part[3] + a))
    at, gram, first, last = (np.concatenate(x) for x in zip(*found))
    # a position picked on both sides of a cut between pieces is one
    new = np.append(True, at[1:] != at[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    return at[new], gram[new], first[new], last[ends]


def _piece(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = rolling_hash(data, GRAM)
    least = _least(h, window - GRAM + 1)
    # runs of neighbours with the same least value
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    value = least[first]
    # the first place from each start on with that value; a later one if the run outlives it
    out = []
    places = np.flatnonzero(_picked(h, least, window - GRAM + 1))
    while len(first):
        k = np.searchsorted(places, first)
        wrong = np.flatnonzero(h[places[k]] != value)
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[h[places[k[wrong]]] != value[wrong]]
        at = places[k]
        out.append((at, value, first, np.minimum(last, at)))
        on = last > at
        first, last, value = at[on] + 1, last[on], value[on]
    at, value, first, last = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((first, at))
    return at[order], value[order], first[order], last[order]


def _picked(h: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Positions that have the least value of some run around them."""
    # the greatest of the least values of all runs that hold a position
    pad = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return ~_least(~pad, width)[: len(h)] == h
