"""Words and word shingles as 64-bit hashes in numpy. Words are runs of \\w, lower case; white space, punctuation and
case don't count. Hashes don't depend on the process, so executors agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

WORDS = re.compile(r"\w+")
#: Words remembered by a worker; then it starts anew. Memory only, results don't depend on it.
REMEMBERED = 200_000
#: Words that are worked on at once; a longer text is a chunk of its own.
CHUNK = 200_000
#: Increment and multipliers of the splitmix64 generator: fixed values.
GOLDEN, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def step(n: int) -> np.uint64:
    """n times GOLDEN, modulo 2^64."""
    return np.uint64(int(GOLDEN) * n % (1 << 64))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = WORDS.findall(text.lower()) if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first text, all word hashes, word counts by text)."""
    first, own, total = 0, [], 0
    for i, t in enumerate(texts):
        own.append(word_hashes(t))
        total += len(own[-1])
        if total >= CHUNK:
            yield first, np.concatenate(own), np.array([len(x) for x in own])
            first, own, total = i + 1, [], 0
    if own:
        yield first, np.concatenate(own), np.array([len(x) for x in own])


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all shingles of k words, repeats included; a text of 1 to k-1 words has one shingle,
    of all its words."""
    n, starts = len(hashes), np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    h = np.zeros(n, np.uint64)
    left = np.repeat(starts + counts, counts) - np.arange(n)  # words from here to the end of the text
    for j in range(k):
        at = np.arange(n) + j
        word = np.where(left > j, hashes[np.minimum(at, n - 1)], np.uint64(0)) if n else hashes
        h = mixed(h * MIX_1 + word + step(j + 1))
    whole = left >= k
    short = (np.repeat(counts, counts) < k) & (np.repeat(starts, counts) == np.arange(n))
    use = whole | short
    return of[use], h[use]


def first_least(hashes: np.ndarray, start: np.ndarray, reach: int) -> np.ndarray:
    """For each start, the place of the least hash (by its upper 34 bits, the first of ties) among reach places from it.
    Least values of blocks, from their ends inwards, give that of any run of a block's length."""
    pos = np.arange(len(hashes), dtype=np.uint64)
    key = ((hashes >> np.uint64(30)) << np.uint64(30)) | pos
    pad = -len(key) % reach + reach
    key = np.concatenate([key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, reach)
    ahead = np.minimum.accumulate(key, 1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(back[start], ahead[start + reach - 1]) & np.uint64((1 << 30) - 1)).astype(np.int64)


def weighted(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, shingle) pairs, sorted, with their counts."""
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(np.append(at, len(h)))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as sorted hashes and their counts: the sum of smaller by that of larger
    counts; 0 if both are empty."""
    (h, c), (g, d) = a, b
    if not len(h) or not len(g):
        return 0.0
    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
    both = int(np.minimum(c, d[at])[g[at] == h].sum())
    return both / (int(c.sum()) + int(d.sum()) - both)


def similarity(a: str | None, b: str | None, k: int) -> float:
    """The same for the shingles of two texts."""
    x, y = word_hashes(a), word_hashes(b)
    of, h, c = weighted(*shingles(np.concatenate([x, y]), np.array([len(x), len(y)]), k))
    m = np.searchsorted(of, 1)
    return overlap((h[:m], c[:m]), (h[m:], c[m:]))
