"""Word hashes, shingles, signatures and content-defined chunks of whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Entries of a worker's word-hash cache, after which it starts anew.
CACHE = 1_000_000
_cache: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    if len(_cache) > CACHE:
        _cache.clear()
    get, out = _cache.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _cache[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Batch:
    """The words of several texts in one array. words: each text's words; tails: words that follow a piece, for its last shingles."""

    def __init__(self, words: list[list[str]], tails: list[list[str]] | None = None, n: int = 3):
        self.n = n
        extra = [t[: n - 1] for t in tails] if tails else [[] for _ in words]
        self.own = np.array([len(w) for w in words], dtype=np.int64)
        self.full = self.own + np.array([len(t) for t in extra], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.full)])
        flat = [x for w, t in zip(words, extra) for x in (*w, *t)]
        self.h, self.length = word_hashes(flat), np.array(list(map(len, flat)), dtype=np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of the distinct n-word sequences that begin in each text, ordered by both. A text of fewer than n
        words, but of one at least, has its whole word sequence as its only shingle."""
        n, total = self.n, len(self.h)
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        doc = np.repeat(np.arange(len(self.full)), self.full)
        at = np.arange(total) - self.start[doc]
        s = np.full(total, n, dtype=_U)
        for k in range(n):
            s = mix(s * _U(0x9E3779B97F4A7C15) + np.concatenate([self.h[k:], np.zeros(min(k, total), _U)]))
        ok = (at + n <= self.full[doc]) & (at < self.own[doc])
        short = np.flatnonzero((self.full < n) & (self.own > 0))
        doc, s = doc[ok], s[ok]
        if len(short):
            more = []
            for d in short:
                x = np.full(1, self.full[d], dtype=_U)
                for h in self.h[self.start[d] : self.start[d + 1]]:
                    x = mix(x * _U(0x9E3779B97F4A7C15) + h)
                more.append(x[0])
            doc, s = np.concatenate([doc, short]), np.concatenate([s, np.array(more, dtype=_U)])
        order = np.lexsort((s, doc))
        doc, s = doc[order], s[order]
        first = np.ones(len(s), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
        return doc[first], s[first]

    def chunks(self, divisor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, chunk hash, characters) of content-defined chunks: a chunk ends after a word where the rolling hash over two words
        is a multiple of divisor, and at the end of the text."""
        total = len(self.h)
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.full)), self.full)
        prev = np.concatenate([np.zeros(1, _U), self.h[:-1]])
        first = np.ones(total, bool)
        first[1:] = doc[1:] != doc[:-1]
        prev[first] = 0
        ends = mix(self.h * _U(3) + prev) % _U(divisor) == 0
        begin = first.copy()
        begin[1:] |= ends[:-1]
        at = np.flatnonzero(begin)
        size = np.diff(np.concatenate([at, [total]]))
        pos = np.arange(total) - np.repeat(at, size)
        return doc[at], mix(np.add.reduceat(mix(self.h + pos.astype(_U) * _U(0xD1B54A32D192ED03)), at)), np.add.reduceat(self.length, at)


def signatures(doc: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, one row of k 32-bit minima for each) from ordered (text number, shingle hash)."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros((0, k), np.uint32)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    seeds = mix(np.arange(1, k + 1, dtype=_U) * _U(0xA0761D6478BD642F))
    out = np.empty((len(at), k), np.uint32)
    for i, x in enumerate(seeds):
        out[:, i] = np.minimum.reduceat(mix(s ^ x) >> _U(32), at)
    return doc[at], out


def likeness(a: list[str], b: list[str], n: int) -> float:
    """The Jaccard index of the sets of n-word sequences (whole sequences where there are fewer words); 0 if either has no word."""

    def grams(w: list[str]) -> set:
        return set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else {tuple(w)} if w else set()

    x, y = grams(a), grams(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


