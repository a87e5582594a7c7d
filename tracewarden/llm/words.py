"""Words, word windows and their hashes over whole Arrow columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

# Numpy work on a chunk takes some hundred bytes per byte of text at its peak.
CHUNK_BYTES = 512 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20_011).integers(1, 1 << 64, 256, dtype=np.uint64)
_LARGEST_KEPT = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits (one-to-one)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and its inverse; one pair of tables serves all smaller sizes."""
    if size <= len(_powers[0]):
        return _powers[0], _powers[1]
    size = 1 << int(size).bit_length()
    tables = []
    for factor in (_BASE, _INVERSE):
        table = np.full(size, factor, np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        tables.append(table)
    if size <= _LARGEST_KEPT:
        _powers[:] = tables
    return tables[0], tables[1]


class RangeHashes:
    """64-bit hashes of any ranges of a sequence, each in constant time (prefix sums)."""

    def __init__(self, values: np.ndarray):
        powers, self._back = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mixed((self._sums[ends] - self._sums[starts]) * self._back[starts] + length * _BASE)


class Texts:
    """Texts that lie one after the other in a byte buffer, cut into words.

    ``starts`` and ``ends`` are the byte places of all words, ``first`` the number of
    the first word of each text (one entry more than texts), ``text_of`` the text of
    each word. Nulls count as empty.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~SPACES[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = word
        before[offsets] = False
        self.starts = np.flatnonzero(word & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = word
        after[offsets] = False
        self.ends = np.flatnonzero(word & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)

    def word_hashes(self) -> np.ndarray:
        return RangeHashes(_BYTE_VALUES[self.data]).of(self.starts, self.ends)

    def single_spaced(self) -> Texts:
        """The same texts with one space between words and perhaps one at the end."""
        word = ~SPACES[self.data]
        after = np.concatenate([[False], word[:-1]]) if len(word) else word
        after[self.offsets[:-1][self.offsets[:-1] < len(word)]] = False
        keep = word | after
        places = np.concatenate([[0], np.cumsum(keep)])
        return Texts(np.where(word, self.data, 0x20).astype(np.uint8)[keep], places[self.offsets])

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words at which a window of ``size`` words of one text starts."""
        if len(self.starts) < size:
            return np.zeros(0, np.int64)
        at = np.arange(len(self.starts) - size + 1)
        return at[self.text_of[at] == self.text_of[at + size - 1]]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text or binary column and the place of each value; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, Texts]]:
    """Consecutive rows of about ``limit`` bytes of text each; a longer text is a chunk of its own."""
    data, offsets = utf8(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield slice(row, end), Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def row_ranges(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``limit`` bytes."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)])
    row = 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(places, places[row] + limit, "right")) - 1)
        yield row, end
        row = end


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given ranges of ``data`` one after the other, and the place of each in the result."""
    lengths = ends - starts
    places = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=places[1:])
    index = np.arange(places[-1]) + np.repeat(starts - places[:-1], lengths)
    return data[index], places


def large_text(data: np.ndarray, places: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow column over bytes that lie one after the other."""
    wide = pa.large_string() if kind == pa.string() else pa.large_binary()
    array = pa.Array.from_buffers(wide, len(places) - 1, [None, pa.py_buffer(np.ascontiguousarray(places, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return array.cast(kind)
