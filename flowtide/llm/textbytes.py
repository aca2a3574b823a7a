"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow string array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes handled at once; bounds the arrays of eight bytes per text byte
BLOCK_BYTES = 1 << 20

#: odd multiplier of the byte polynomial, modulo 2**64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_WHITE = bytes([0x20, *range(0x09, 0x0E)])


def class_table(members: bytes, inverse: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return ~table if inverse else table


#: bytes of `[^\\x20\\x09-\\x0D]`
NOT_WHITE = class_table(_WHITE, inverse=True)
#: bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` once A-Z are lower case
ALPHANUMERIC = class_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A-Z to a-z, all else as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        _tables.update(up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every data[start:end], in ascending order; equal bytes give equal hashes.

    A long text is taken in pieces, so that the arrays of eight bytes per byte stay small.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(int(np.searchsorted(end, start[at] + BLOCK_BYTES, side="right")), at + 1)
        origin = start[at]
        out[at:stop] = _hash_piece(data[origin : end[stop - 1]], start[at:stop] - origin, end[at:stop] - origin)
        at = stop
    return out


def _hash_piece(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of consecutive texts from row `row` on.

    `text_start` has the first byte of each text and `first` its first word, both with one end.
    """

    row: int
    data: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        return segments_hash(self.data, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = texts.buffers()[2]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of at most `limit` bytes, or of one long text."""
    data, offsets = text_bytes(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words_of(row: int, data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = members[data]
    change = np.diff(inside)
    # a word never goes on from one text to the next
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[(inside[cuts] & inside[cuts + 1]).astype(bool)])
    start = np.flatnonzero(change == 1)
    end = np.flatnonzero(change == -1)
    if len(cuts):
        start = np.sort(np.concatenate([start, cuts]))
        end = np.sort(np.concatenate([end, cuts]))
    return Words(row, data, offsets, start, end, np.searchsorted(start, offsets))


def words(texts: pa.Array, members: np.ndarray, lower: bool = False) -> Iterator[Words]:
    """Words of all texts in blocks; every text is in one block, whole."""
    for row, data, offsets in blocks(texts):
        yield words_of(row, LOWER[data] if lower else data, offsets, members)
