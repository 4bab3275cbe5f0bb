"""Word splitting on UTF-8 bytes: only ASCII letters change case, bytes of other letters pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Maps every ASCII byte outside 0-9, A-Z and a-z to a space.
_ALNUM = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else _LOWER[c] for c in range(256))


def space_words(text: bytes) -> list[bytes]:
    """Runs of anything but space and tab to carriage return, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            yield batch
            continue
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, for kernels that make Python objects of a batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def emptied(kernel: Callable[[Iterator], Iterator], *caches: dict) -> Callable[[Iterator], Iterator]:
    """kernel, which leaves no cache and no spare memory of Arrow's in its worker for the stages after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            for cache in caches:
                cache.clear()
            pa.default_memory_pool().release_unused()

    return run


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each word a task meets; emptied when large."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; fewer words than k make one shingle, none make none."""
    n = len(hashes)
    if not n:
        return hashes
    with np.errstate(over="ignore"):
        width = min(k, n)
        out = np.full(n - width + 1, np.uint64(width), np.uint64)
        for i in range(width):
            out = mix64(out * _MIX + hashes[i : n - width + 1 + i])
    return np.unique(out)
