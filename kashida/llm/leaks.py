"""Held-out passages in a corpus (problem 8): a generalised suffix automaton of the items, through which documents are streamed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textforms import FOLD, WORD, words

#: Characters of items in one automaton, which bounds the driver while it builds one, and automata that one pass over the corpus uses,
#: which bounds what is broadcast (some 40 bytes a word of the items). More items take further passes.
BLOCK, TOGETHER = 2_000_000, 8
#: Words of a document that are streamed one after another; longer documents are streamed in parts side by side, and documents in
#: groups of so many words.
PART, GROUP = 512, 400_000


class Automaton:
    """A generalised suffix automaton over the words of several items, in flat arrays.

    items: (number, words as numbers); seeds: the match length from which each counts. An edge is a number, state * words + word, in
    the sorted array `edge`, with its target in `to`; the root's edges are in `root`. `link` leads to the longest proper suffix of another
    class, `size` is the longest word sequence of a class. States are numbered so that those below a state in the tree of links follow
    it, up to `last`; `item` and `place` hold the ends of all items' beginnings in that order, from `first` of each state on.
    """

    def __init__(self, items: list[list[int]], seeds: list[int], vocabulary: int):
        nexts: list[dict[int, int]] = [{}]
        link, size, ends = [-1], [0], [[]]

        def state(n: int, up: int, edges: dict[int, int]) -> int:
            nexts.append(edges)
            link.append(up)
            size.append(n)
            ends.append([])
            return len(link) - 1

        def split(p: int, q: int, w: int) -> int:
            """The part of q's class that is reached from p: a state of its own."""
            clone = state(size[p] + 1, link[q], dict(nexts[q]))
            link[q] = clone
            while p != -1 and nexts[p].get(w) == q:
                nexts[p][w] = clone
                p = link[p]
            return clone

        for n, own in enumerate(items):
            at = 0
            for k, w in enumerate(own, 1):
                q = nexts[at].get(w)
                if q is not None:
                    at = q if size[q] == size[at] + 1 else split(at, q, w)
                else:
                    new, p = state(size[at] + 1, 0, {}), at
                    while p != -1 and w not in nexts[p]:
                        nexts[p][w] = new
                        p = link[p]
                    if p != -1:
                        q = nexts[p][w]
                        link[new] = q if size[q] == size[p] + 1 else split(p, q, w)
                    at = new
                ends[at].append((n, k))
        children: list[list[int]] = [[] for _ in link]
        for x in range(1, len(link)):
            children[link[x]].append(x)
        order, todo = [], [0]
        while todo:
            x = todo.pop()
            order.append(x)
            todo += children[x]
        number = np.empty(len(link), np.int64)
        number[order] = np.arange(len(link))
        self.words = vocabulary
        self.size = np.array(size, np.int32)[order]
        self.link = np.array([0 if link[x] < 0 else number[link[x]] for x in order], np.int32)
        below = np.ones(len(link), np.int64)
        for x in range(len(link) - 1, 0, -1):
            below[self.link[x]] += below[x]
        self.last = np.arange(len(link)) + below
        flat = [e for x in order for e in ends[x]]
        self.item, self.place = (np.array([e[k] for e in flat], np.int32) for k in (0, 1))
        self.first = np.append(0, np.cumsum([len(ends[x]) for x in order]))
        count = sum(len(nexts[x]) for x in order)
        edge = np.fromiter((number[x] * vocabulary + w for x in order for w in nexts[x]), np.int64, count)
        to = np.fromiter((number[t] for x in order for t in nexts[x].values()), np.int32, count)
        by = np.argsort(edge, kind="stable")
        self.edge, self.to = edge[by], to[by]
        self.root = np.zeros(vocabulary, np.int32)
        self.root[list(nexts[0])] = number[list(nexts[0].values())] if nexts[0] else []
        self.seeds = np.array(seeds, np.int32)
        # the shortest match of a state that some item counts, and whether a suffix of it is long enough for one
        far = np.iinfo(np.int32).max
        need = np.full(len(link), far, np.int64)
        if len(flat):
            np.minimum.at(need, np.repeat(np.arange(len(link)), np.diff(self.first)), self.seeds[self.item])
        for x in range(len(link) - 1, 0, -1):
            if need[x] < need[self.link[x]]:
                need[self.link[x]] = need[x]
        need[0] = far
        self.need, self.above = need, np.zeros(len(link), bool)
        for x in range(1, len(link)):
            up = self.link[x]
            self.above[x] = self.above[up] or self.size[up] >= need[up]

    def occurrences(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, places) where the state's sequences end."""
        lo, hi = self.first[s], self.first[self.last[s]]
        return self.item[lo:hi], self.place[lo:hi]

    def stream(self, tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, place, state, length) after each word where the longest match with items is one that some item counts, or has such
        a suffix. tokens: numbers of words, -1 for words that no item has; lo, hi: the stretches of it that are streamed side by side."""
        by = np.argsort(lo - hi, kind="stable")
        lo, long = lo[by], (hi - lo)[by]
        s, n = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for t in range(int(long[0]) if len(long) else 0):
            a = int(np.searchsorted(-long, -t, side="left"))  # stretches that still go on
            w = tokens[lo[:a] + t]
            todo = np.flatnonzero(w >= 0)
            s[:a][w < 0] = n[:a][w < 0] = 0
            while len(todo):
                at = s[todo]
                root = at == 0
                x = todo[root]
                s[x] = self.root[w[x]]
                n[x] = s[x] > 0
                todo, at = todo[~root], at[~root]
                if not len(todo):
                    break
                key = at * self.words + w[todo]
                i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                hit = self.edge[i] == key
                s[todo[hit]] = self.to[i[hit]]
                n[todo[hit]] += 1
                todo = todo[~hit]
                s[todo] = self.link[s[todo]]
                n[todo] = self.size[s[todo]]
            good = np.flatnonzero((n[:a] >= self.need[s[:a]]) | self.above[s[:a]])
            if len(good):
                found.append((by[good], np.full(len(good), t + 1), s[good], n[good]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def seed(n: int, share: float, changed: int) -> int:
    """The longest run without a change that a stretch of at least `share` of n words must have, one word in `changed` being changed."""
    low = max(1, -(-n * share // 1)) if n else 1
    return min(-(-(k - k // changed) // (k // changed + 1)) for k in range(int(low), max(int(low), n) + 1))


def stretch(same: list[bool] | np.ndarray, changed: int) -> tuple[int, int]:
    """(begin, end) of the longest stretch of which at most one in `changed` is not the same; the first of equals."""
    sums, total = [0], 0
    for x in same:
        total += 1 if x else 1 - changed
        sums.append(total)
    falling = [0]  # begins that no earlier begin undercuts
    for i in range(1, len(sums)):
        if sums[i] < sums[falling[-1]]:
            falling.append(i)
    best = (0, 0)
    for j in range(len(sums) - 1, 0, -1):
        while falling and sums[falling[-1]] <= sums[j]:
            i = falling.pop()
            if j - i >= best[1] - best[0] and j > i:
                best = (i, j)
    return best


class Leaks:
    """The items of some automata, and the search for their stretches in documents. parts: (id, text) of the items of each automaton."""

    def __init__(self, parts: list[list[tuple[int, str]]], share: float, changed: int):
        self.share, self.changed = share, changed
        self.number: dict[str, int] = {}
        self.automata: list[Automaton] = []
        self.items: list[list[tuple[int, np.ndarray]]] = []
        read = [[(i, [self.number.setdefault(x, len(self.number)) for x in w]) for i, t in part if (w := words(t))] for part in parts]
        for own in read:
            if own:
                seeds = [seed(len(w), share, changed) for _, w in own]
                self.automata.append(Automaton([w for _, w in own], seeds, len(self.number)))
                self.items.append([(i, np.array(w, np.int64)) for i, w in own])
        self.back = max((int(a.seeds.max()) for a in self.automata), default=1)

    def find(self, documents: list[list[str]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item_id, begin, end, item words): for each item that leaked into a document, its longest stretch, as places of the
        document's words. Long documents are cut into parts that begin early enough to know every match that counts."""
        if not self.automata:
            return
        get = self.number.get
        sizes = np.array([len(d) for d in documents], np.int64)
        tokens = np.fromiter((get(w, -1) for d in documents for w in d), np.int64, int(sizes.sum()))
        starts = np.append(0, np.cumsum(sizes))
        doc = np.repeat(np.arange(len(documents)), -(-sizes // PART))
        begin = np.concatenate([np.arange(0, n, PART) for n in sizes]) if len(sizes) else np.zeros(0, np.int64)
        begin = begin.astype(np.int64)
        lo, hi = starts[doc] + np.maximum(begin - self.back, 0), starts[doc] + np.minimum(begin + PART, sizes[doc])
        for a, items in zip(self.automata, self.items):
            part, place, state, length = a.stream(tokens, lo, hi)
            at = lo[part] - starts[doc[part]] + place
            ok = at > begin[part]
            diagonals: dict[int, set[tuple[int, int]]] = {}
            for d, p, s, n in zip(doc[part[ok]].tolist(), at[ok].tolist(), state[ok].tolist(), length[ok].tolist()):
                mine = diagonals.setdefault(d, set())
                # suffixes of the match that other items share are on the way to the root
                while s > 0:
                    n = min(n, int(a.size[s]))
                    if n >= a.need[s]:
                        item, where = a.occurrences(s)
                        fit = a.seeds[item] <= n
                        mine.update(zip(item[fit].tolist(), (p - where[fit]).tolist()))
                    if not a.above[s]:
                        break
                    s = int(a.link[s])
            for d, mine in sorted(diagonals.items()):
                text = tokens[starts[d] : starts[d + 1]]
                best: dict[int, tuple[int, int]] = {}
                for item, shift in mine:
                    own = items[item][1]
                    low, top = max(0, -shift), min(len(own), len(text) - shift)
                    i, j = stretch(own[low:top] == text[low + shift : top + shift], self.changed)
                    if j - i >= self.share * len(own):
                        found = (low + i + shift, low + j + shift)
                        if item not in best or (found[0] - found[1], found[0]) < (best[item][0] - best[item][1], best[item][0]):
                            best[item] = found
                for item, (i, j) in sorted(best.items()):
                    yield d, items[item][0], i, j, len(items[item][1])


def _blocks(items: DataFrame, item_id: str, text: str, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in parts of about `block` characters."""
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-size // block))
    for k in range(parts):
        yield [(r.i, r.t) for r in (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)).collect()]


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, changed: int = 10, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """(doc_id, item_id, begin, end, item_words): documents that hold at least `share` of an item's words as one continuous stretch, at
    most one word in `changed` being another; begin and end are the places of the stretch in the document's words.

    documents: doc_id, text; items: item_id, text. Words are compared in the consistent form, so formatting and character differences
    play no part. The automata are built once, on the driver, from parts of about `block` characters of items, and sent as arrays; every
    document is read whole, once for every `together` of them. A document in several rows counts in each. Null texts and texts without
    words leak nothing; an item without words leaks nowhere.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, parts = None, []

    def search(parts: list[list[tuple[int, str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Leaks(parts, share, changed))  # arrays of at most `together` * `block` characters of items

        def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def flush() -> pa.RecordBatch:
                rows = [(ids[d], *r) for d, *r in shared.value.find(texts)]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "begin", "end", "item_words"])

            ids, texts, held = [], [], 0
            for b in it:
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    if w := words(t):
                        ids.append(d)
                        texts.append(w)
                        held += len(w)
                    if held > GROUP:
                        yield flush()
                        ids, texts, held = [], [], 0
            yield flush()

        return docs.mapInArrow(of, "doc_id long, item_id long, begin int, end int, item_words int")

    for part in _blocks(items, "item_id", "text", block):
        parts.append(part)
        if len(parts) == together:
            out = search(parts) if out is None else out.unionByName(search(parts))
            parts = []
    if parts or out is None:
        out = search(parts) if out is None else out.unionByName(search(parts))
    return out


def cleaned(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, removed) of every document (doc_id, text): the text without the spans (doc_id, begin, end) that leaked into it,
    and the number of words taken out. Texts without spans stay as they are; others are in the consistent form. Null texts stay null."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out, removed = [], []
            for t, v in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                cuts = [(x["begin"], x["end"]) for x in v or []]
                out.append(without(t, cuts) if cuts and t is not None else t)
                removed.append(len({k for i, j in cuts for k in range(i, j)}))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed"])

    # a document has at most one span for each item, and those are as long as half the item
    of_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(of_doc, "doc_id", "left").mapInArrow(of, "doc_id long, text string, removed int")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (begin, end) of its words; what stands between words goes with the word before it.

    The consistent form is the text that is cut, since words are counted in it.
    """
    text = FOLD(text)
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for i, j in sorted(spans):
        lo, hi = at[i][0], at[j][0] if j < len(at) else len(text)
        out.append(text[last : max(last, lo)])
        last = max(last, hi)
    return "".join([*out, text[last:]])
