"""Words of Arrow text batches as numpy arrays.

A word is `[^\\x20\\x09-\\x0D]+`. Bytes are looked at, never decoded: the separators are ASCII, so they never occur
inside a character of UTF-8. A batch is worked on in pieces of about `PIECE` bytes, whole documents at a time, so
that memory follows the piece or the longest document, not the batch. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18

# The separators space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]

IS_WORD = np.ones(256, bool)
IS_WORD[SEPARATORS] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD6E8FEB86659FD93
BACK = pow(STEP, -1, 1 << 64)


def powers(base: int | np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def place_codes(n: int) -> np.ndarray:
    """A random odd factor for each place. Powers of one base would not do: modulo 2 ** 64, texts that repeat themselves
    by a simple rule have equal sums for every base."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * BASE) | np.uint64(1)


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; the runs lie one after another in `values`. About `PIECE` bytes are worked on at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    ends = starts + lengths
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        at, many = starts[first:last], lengths[first:last]
        place = np.arange(at[0], ends[last - 1]) - np.repeat(at, many)
        codes = CODES[values[at[0] : ends[last - 1]]] * place_codes(int(many.max()))[place]
        out[first:last] = np.add.reduceat(codes, at - at[0])
        first = last
    return mixed(out)


@dataclass
class Piece:
    """Some documents of a batch: rows `first` to `last`, their bytes and where each begins in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """The rows of a text or binary column in order; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n, (_, offsets, data) = len(column), column.buffers()
    if not n:
        return
    ends = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lengths = np.diff(ends)
    if column.null_count:
        lengths[~np.asarray(column.is_valid())] = 0
    first = 0
    while first < n:
        last = first + max(1, int(np.searchsorted(ends[first + 1 :] - ends[first], size, "right")))
        part = lengths[first:last]
        bounds = np.concatenate([[0], np.cumsum(part)])
        if bounds[-1] == ends[last] - ends[first]:
            own = raw[ends[first] : ends[last]]
        else:
            own = np.concatenate([raw[a : a + k] for a, k in zip(ends[first:last], part, strict=True)])
        yield Piece(first, last, own, bounds)
        first = last


@dataclass
class Words:
    """The words of a piece: hash, the document of each, where each document's words begin, and byte places."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def places(self) -> np.ndarray:
        """The place of each word in its document."""
        return np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.counts())


def words(piece: Piece, lower: bool = False) -> Words:
    data = LOWER[piece.data] if lower else piece.data
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = piece.bounds[:-1][piece.bounds[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    sums = np.concatenate([[0], np.cumsum(inside)])
    stops = np.append(starts[1:], len(data))
    lengths = sums[stops] - sums[starts]
    hashes = run_hashes(data[inside], sums[starts], lengths)
    return Words(hashes, np.searchsorted(starts, piece.bounds), starts, starts + lengths)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive words, by first word; windows that cross documents are to be masked out."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(STEP, n), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(BACK, n - width + 1))


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows of `window_hashes` lie in one document."""
    n = int(bounds[-1])
    inside = np.ones(max(0, n - width + 1), bool)
    counts = np.diff(bounds)
    short = np.zeros(n + 1, np.int64)
    tail = np.minimum(counts, width - 1)
    np.add.at(short, bounds[1:] - tail, 1)
    np.add.at(short, bounds[1:], -1)
    inside[np.cumsum(short[: len(inside)]) > 0] = False
    return inside


def joined(data: bytes) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(data.split())
