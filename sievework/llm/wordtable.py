"""A bounded memory of per-word score rows, kept by Python workers across batches and tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np

BYTES = 96 << 20
BLOCK_CHARS = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed_grams(words: list[str], sizes: Iterable[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word itself and of the character n-grams of ``<word>``, and the number of the word that each belongs to."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words)), lens)
    left = ends[owner] - np.arange(len(c))  # characters from here to the word's end
    place = (lens[owner] - left).astype(np.uint64)
    ids, owners = [_mix(np.add.reduceat(_mix(c * _ODD + place), ends - lens))], [np.arange(len(words))]
    g = np.zeros(len(c), np.uint64)
    for n in range(1, max(sizes) + 1):
        g = g[: len(c) - n + 1]
        if not len(g):
            break
        g = _mix(g * _ODD + c[n - 1 :] + np.uint64(n))
        if n in sizes:
            ok = left[: len(g)] >= n
            ids.append(g[ok])
            owners.append(owner[: len(g)][ok])
    return (np.concatenate(ids) % np.uint64(buckets)).astype(np.int64), np.concatenate(owners)


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[list[str | None]]:
    """The texts in order, in runs of about ``chars`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


class WordTable(dict):
    """Maps words to row numbers of ``rows``; words that are not there yet are scored together.

    There are two generations of half of ``limit`` bytes: words in use move from the older to the newer one, and when the newer
    is full the older is dropped.
    """

    ENTRY = 150

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int, limit: int = BYTES):
        super().__init__()
        self.score, self.width, self.half, self.size = score, width, limit // 2, 0
        self.rows, self.older, self.older_rows = np.zeros((1024, width), np.float32), {}, None

    def take(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the words, in order, and their row numbers."""
        if self.size > self.half:
            self.older, self.older_rows, self.rows, self.size = dict(self), self.rows, np.zeros((1024, self.width), np.float32), 0
            self.clear()
        new = set(words).difference(self)
        if new:
            known = [w for w in new if w in self.older]
            if known:
                self._add(known, self.older_rows[[self.older[w] for w in known]])
                new.difference_update(known)
            fresh = list(new)
            for k in range(0, len(fresh), 50_000):
                self._add(fresh[k : k + 50_000], self.score(fresh[k : k + 50_000]))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at], at

    def _add(self, words: list[str], rows: np.ndarray) -> None:
        k = len(self)
        while k + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k : k + len(words)] = rows
        self.update(zip(words, range(k, k + len(words))))
        self.size += sum(map(sys.getsizeof, words)) + len(words) * (self.ENTRY + 8 * self.width)
