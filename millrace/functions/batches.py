"""Arrow batches of texts: bounded slices, and hashes of all their windows and of any of their runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = (1 << 64) - 1


def slices_of_bytes(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most `limit` bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def window_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, hash) of every run of `size` code points of every text; size is a power of two.

    Runs of twice the length follow from two runs beside each other, so that a length takes log2(size) products over all texts at once.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(length) - length
    held, factor = 1, 0x9E3779B97F4A7C15
    while held < size:
        codes = codes[:-held] * np.uint64(factor) + codes[held:] if len(codes) > held else codes[:0]
        held, factor = 2 * held, factor * factor & _WORD
    number = np.repeat(np.arange(len(texts)), np.maximum(length - size + 1, 0))
    start = np.arange(len(number)) - np.repeat(np.cumsum(np.maximum(length - size + 1, 0)) - np.maximum(length - size + 1, 0), np.maximum(length - size + 1, 0))
    x = codes[first[number] + start] if len(number) else codes[:0]
    return number, start, _mixed(x, size)


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    x = (x ^ np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 to the 64th."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (base, pow(base, -1, _WORD + 1)))


class RunHashes:
    """Hashes of runs of code points of texts, of any length, from running sums: a run's hash tells the run and its length, not its place.

    `whole` is all texts one after the other, where they begin and end is in `starts` and `ends`.
    """

    def __init__(self, texts: list[str]):
        self.whole = "".join(texts)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(length)
        self.starts = self.ends - length
        n = len(self.whole)
        powers, self._inverse = _powers(1 << max(20, n.bit_length()))
        codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes += np.uint64(1)
        codes *= powers[:n]
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes, out=self._sums[1:])

    def number(self, at: np.ndarray) -> np.ndarray:
        """Which text a place is in."""
        return np.searchsorted(self.ends, at, "right")

    def at(self, at: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
        """Hashes of the runs of `size` from these places on; those of another kind (0 to 255) are others."""
        return _mixed((self._sums[at + size] - self._sums[at]) * self._inverse[at], size | kind << 56)

    def everywhere(self, size: int) -> np.ndarray:
        """Hashes of the runs of `size` from every place on, beyond the ends of texts too."""
        n = max(len(self.whole) - size + 1, 0)
        return _mixed((self._sums[size : size + n] - self._sums[:n]) * self._inverse[:n], size)
