"""Words of whole texts as NumPy arrays, a batch at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Every byte that is not a letter, a digit or part of a non-ASCII character becomes a blank; A-Z becomes a-z.
ALNUM = bytes((b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20)
              for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(ALNUM).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased (bytes.lower and bytes.split are ASCII only)."""
    return text.lower().split() if text else []


def hash64(word: bytes) -> int:
    """A 64-bit hash of a word, the same on every machine."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class WordIds(dict):
    """Numbers words 0, 1, 2 .. as they are first looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(hash64, self), dtype=np.uint64, count=len(self))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each row of equally long arrays of hashes; order matters."""
    h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 20
#: A fixed odd multiplier and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class BlankHashes:
    """64-bit hashes of the words of whole texts (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), many texts at a time.

    A word's hash is the sum of a value of each byte times a power of its place, mixed with the
    length; sums over all bytes of a chunk give every word's at once.
    """

    def __init__(self):
        self.values = _VALUES[[b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]]
        self.blank = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
        self._grow(CHUNK_BYTES)

    def _grow(self, n: int) -> None:
        self.power = _powers(_BASE, n)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)

    def texts(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, hashes of the words, start of each row's words and the end) of chunks of an Arrow binary column."""
        n = len(column)
        if not n:
            return
        if column.null_count:
            column = column.fill_null(b"")
        wide = pa.types.is_large_binary(column.type)
        ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_BYTES, side="right")) - 1)
            yield first, *self._chunk(data[ends[first]:ends[last]], ends[first:last + 1] - ends[first])
            first = last

    def _chunk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self.power):
            self._grow(len(data))
        inside = np.concatenate([[False], ~self.blank[data], [False]])
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True  # words end with their text
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        stops = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:len(data)], out=sums[1:])
        words = mixed((sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64) * _VALUES[0])
        return words, np.searchsorted(starts, ends)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_sets(hashes: BlankHashes, column, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) by chunk: each text's distinct k-word shingles, sorted; fewer words make one, none make none."""
    for first, words, cuts in hashes.texts(column):
        n = len(words) - k + 1
        chain = chained([words[i:i + n] for i in range(k)]) if n > 0 else words[:0]
        sets = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(distinct(chain[a:b - k + 1]))
            else:
                sets.append(chained([words[i:i + 1] for i in range(a, b)]) if b > a else words[:0])
        yield first, sets
