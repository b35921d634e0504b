"""Words of whole texts, as bytes of UTF-8. bytes.split() cuts at just the bytes 0x20 and 0x09-0x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def texts_of(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a worker holds of long texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class Cache(dict):
    """Word to number, computed once by make(word). When it has grown over limit, trim(), between documents, lays its words
    aside: one that comes again is taken back from there, the others are forgotten at the next time."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.aside = make, limit, {}

    def __missing__(self, word: bytes):
        out = self.aside.get(word)
        if out is None:
            out = self.make(word)
        self[word] = out
        return out

    def trim(self) -> None:
        if len(self) > self.limit:
            self.aside = dict(self)
            self.clear()


_KEPT: list[Cache] = []


def alone(cache: Cache | None = None) -> None:
    """Empties what other operators left in a worker that serves one after the other, so that it holds the words of one stage at
    a time. cache is kept from task to task."""
    for other in _KEPT:
        if other is not cache:
            other.clear()
            other.aside = {}
    if cache is not None and not any(other is cache for other in _KEPT):
        _KEPT.append(cache)
    pa.default_memory_pool().release_unused()


def numbers(words: list[bytes], cache: Cache, dtype=np.uint64) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all windows of size words; with fewer words, one hash of the whole sequence; none of none."""
    if not len(words):
        return words
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
    return np.unique(out)
