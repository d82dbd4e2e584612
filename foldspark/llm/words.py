"""Vectorised words and windows of words over Arrow batches.

A batch's texts are cut into blocks of about a megabyte (a longer text is a
block of its own), and every step runs over the whole block in numpy: no
Python code runs per word.  Words are keyed by 64-bit polynomial hashes of
their bytes, windows by Rabin-Karp polynomials of word hashes, mixed so that
their order is a pseudo-random one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
_STEPS = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 2**62, 64)]
#: What takes back a multiplication by the base, which is odd.
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {_BASE: np.ones(1, np.uint64), _UNDO: np.ones(1, np.uint64)}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """The first n powers of the base, modulo 2^64."""
    if len(_powers[base]) < n:
        grown = np.full(max(n, 2 * len(_powers[base])), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.multiply.accumulate(grown)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch: the bytes, and where rows begin."""

    first: int
    last: int
    data: np.ndarray
    at: np.ndarray


def blocks(texts: pa.Array) -> Iterator[Block]:
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, values = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    at = np.frombuffer(ends, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
        last = min(last, n)
        yield Block(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


@dataclass
class Words:
    """Words of a block: byte ranges, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row_at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_at)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), self.counts)


def words(block: Block) -> Words:
    data, at = block.data, block.at
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(at), np.int64))
    blank = _IS_BLANK[data]
    filled = at[:-1][at[1:] > at[:-1]]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = blank[:-1]
    before[filled] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = blank[1:]
    after[at[1:][at[1:] > at[:-1]] - 1] = True
    start = np.flatnonzero(~blank & before)
    end = np.flatnonzero(~blank & after) + 1
    return Words(start, end, np.searchsorted(start, at))


def word_hashes(data: np.ndarray, w: Words, lower: bool = False) -> np.ndarray:
    """64 bits of every word's bytes; with ``lower``, A-Z count as a-z."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    at = np.cumsum(size) - size
    index = np.arange(int(at[-1] + size[-1])) - np.repeat(at, size)
    own = data[np.repeat(w.start, size) + index]
    if lower:
        own = _ASCII_LOWER[own]
    return mixed(np.add.reduceat(_BYTE_CODE[own] * powers(int(size.max()))[index], at) + size.astype(np.uint64))


def windows(hashes: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of k words inside a row, and their
    first words: of words h the polynomial h[0] B^(k-1) + ... + h[k-1].  All
    windows roll at once: differences of one running sum of h[j] B^-j, each
    lifted to its place; so any k costs the same."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    running = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), _UNDO), out=running[1:])
    row = w.row
    inside = np.flatnonzero(row[:n] == row[k - 1 :])
    return mixed((running[inside + k] - running[inside]) * powers(len(hashes))[inside + (k - 1)]), inside
