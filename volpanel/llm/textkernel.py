"""Array kernels over batches of texts, for use inside Arrow tasks.

A batch of texts becomes one array of code points, in which words are runs and every
substring has a 64-bit polynomial hash in constant time from a prefix-sum array.  All
work on a batch is then a handful of NumPy passes, and memory is bounded by the slice of
texts at hand (:func:`slices`), or by one longer text, never by a partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
SLICE_CHARS = 1 << 16


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``chars`` characters, one text at least."""
    low = total = 0
    for i, text in enumerate(texts):
        if i > low and total + len(text) > chars:
            yield low, i
            low, total = i, 0
        total += len(text)
    if low < len(texts):
        yield low, len(texts)


@lru_cache(maxsize=None)
def _char_table(kind: str) -> np.ndarray:
    test = {"letter": str.isalpha, "wordlike": str.isalnum}[kind]
    return np.fromiter((test(chr(i)) for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters(codes: np.ndarray) -> np.ndarray:
    return _char_table("letter")[codes]


def wordlike(codes: np.ndarray) -> np.ndarray:
    return _char_table("wordlike")[codes]


def not_blank(codes: np.ndarray) -> np.ndarray:
    """Characters of words as ``[^\\x20\\x09-\\x0D]+`` has them."""
    return ~((codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection with good avalanche)."""
    x = x ^ (x >> np.uint64(32))
    x = x * STEP
    x = x ^ (x >> np.uint64(32))
    x = x * STEP
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of BASE and of its inverse, grown to the longest slice seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), SLICE_CHARS + 4096)
            self.up = np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(size - 1, BASE_INVERSE)]).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Batch:
    """Code points of some texts, one line end between them, with their prefix hashes."""

    def __init__(self, texts: list[str]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.n = len(texts)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        self._prefix: np.ndarray | None = None

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of true values; ``inside`` is false at line ends."""
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each position."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each substring; equal strings have equal hashes wherever they stand."""
        up, down = _POWERS.get(len(self.codes) + 1)
        if self._prefix is None:
            terms = (self.codes.astype(np.uint64) + np.uint64(1)) * up[: len(self.codes)]
            self._prefix = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        return mix((self._prefix[ends] - self._prefix[starts]) * down[starts])


def ngrams(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k neighbouring word hashes of one text, and the index of their first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(owner[:n] == owner[k - 1 :])
    out = np.zeros(len(whole), np.uint64)
    for j in range(k):
        out = mix(out * BASE + words[whole + j])
    return out, whole


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    at[table[at] != keys] = -1
    return at


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


ROWS_AT_ONCE = 512


def texts_of(batches: Iterable, *columns: str) -> Iterator[tuple]:
    """(values of other columns..., texts) of each slice of some hundred rows; null texts come as None."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            raw = part.column("text").to_pylist()
            others = [part.column(c).to_pylist() for c in columns]
            for low, high in slices([t or "" for t in raw]):
                yield (*[o[low:high] for o in others], raw[low:high])


def parts_of(batches: Iterable) -> Iterator[tuple]:
    """(record batch, texts) of each slice of some hundred rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            raw = part.column("text").to_pylist()
            for low, high in slices([t or "" for t in raw]):
                yield part.slice(low, high - low), raw[low:high]
