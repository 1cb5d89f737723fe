"""Occurrences of every word, n-word term or whole value, and the records that hold it (problem 5), by suffix arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .textforms import words

#: Words in one suffix array; bounds a worker's memory, whatever the partition.
BLOCK = 2_000_000


def suffix_array(tokens: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, words that each shares with the one before) of all records, to their ends.

    tokens: word numbers of all records one after another; record: the record of each. Suffixes are ordered by their words, a beginning
    before what it begins, equal ones by record. Ranks by the first 1, 2, 4, 8 ... words follow from each other until all differ or the
    longest record is reached; the common prefixes follow from the same ranks, from the longest down.
    """
    total = len(tokens)
    here = np.arange(total)
    ends = np.append(np.flatnonzero(record[1:] != record[:-1]) + 1, total)
    end = ends[np.searchsorted(ends, here, side="right")]
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, width, longest = [rank], 1, int(np.diff(np.append(0, ends)).max())
    while width < longest and rank.max() < total - 1:
        after = np.minimum(here + width, total - 1)
        key = rank * (total + 1) + np.where(here + width < end, rank[after] + 1, 0)
        order = np.argsort(key, kind="stable")
        rank = np.empty(total, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        levels.append(rank)
        width *= 2
    order = np.lexsort((record, rank))
    common = np.zeros(total, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        # ranks are equal where as many words are, or both records end after the same ones
        x, y = a + common[1:], b + common[1:]
        go = np.flatnonzero((x < end[a]) & (y < end[b]))
        go = go[levels[k][x[go]] == levels[k][y[go]]]
        common[1:][go] += np.minimum(1 << k, end[a[go]] - x[go])
    return order, common


def intervals(tokens: np.ndarray, record: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n from 1 to most: (n, place of one occurrence, occurrences, records) of every distinct n-word term.

    In the suffix array, the suffixes that begin with one term of n words are an interval: neighbours in it share n words at least. Its
    length is the number of occurrences. A suffix whose predecessor of the same record lies in the same interval is a duplicate; less
    these, the length is the number of records.
    """
    if not len(tokens):
        return
    order, common = suffix_array(tokens, record)
    ends = np.append(np.flatnonzero(record[1:] != record[:-1]) + 1, len(record))
    left = ends[np.searchsorted(ends, order, side="right")] - order  # words to the record's end
    owner = record[order]
    by = np.argsort(owner, kind="stable")
    before = np.full(len(order), -1)
    same = owner[by[1:]] == owner[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    for n in range(1, most + 1):
        alive = left >= n
        first = alive & (common < n)
        if not first.any():
            return
        # a suffix too short for n words never lies between two of one term, so neighbours stay neighbours
        run = np.cumsum(first) - 1
        occurrences = np.bincount(run[alive])
        again = alive & (before >= 0)
        at = np.flatnonzero(again)
        q = before[at]
        at = at[alive[q] & (run[q] == run[at])]
        yield n, order[first], occurrences, occurrences - np.bincount(run[at], minlength=len(occurrences))


def term_counts(records: DataFrame, column: str, most: int = 1, whole: bool = False, read: Callable[[str | None], list[str]] = words) -> DataFrame:
    """(n, term, occurrences, records): how often every term of up to `most` words occurs in the column, and in how many rows.

    Terms may have any number of words, as far as `most` says: the suffix arrays reach to the ends of records. whole: the row's words,
    joined by one blank, are one term. A row with term null and n 0 gives the number of rows that hold a word.
    Each task builds suffix arrays over whole records and sends one row per distinct term, so frequent terms are added up before the
    shuffle. Null, empty and wordless values count nowhere.
    """

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            if not tokens:
                return
            names = list(number)
            t, r = np.array(tokens, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)
            yield _batch([0], [None], [len(sizes)], [len(sizes)])
            for n, place, occurrences, held in intervals(t, r, most):
                for lo in range(0, len(place), 100_000):
                    at = place[lo : lo + 100_000].tolist()
                    terms = [names[tokens[p]] for p in at] if n == 1 else [" ".join([names[x] for x in tokens[p : p + n]]) for p in at]
                    yield _batch([n] * len(at), terms, occurrences[lo : lo + 100_000], held[lo : lo + 100_000])

        number: dict[str, int] = {}
        tokens: list[int] = []
        sizes: list[int] = []
        for b in it:
            for x in b.column(0).to_pylist():
                if w := read(x):
                    w = [" ".join(w)] if whole else w
                    tokens += [number.setdefault(y, len(number)) for y in w]
                    sizes.append(len(w))
                    if len(tokens) > BLOCK:
                        yield from flush()
                        number, tokens, sizes = {}, [], []
        yield from flush()

    part = records.select(column).where(F.col(column).isNotNull()).mapInArrow(of, "n int, term string, occurrences long, records long")
    return part.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _batch(n: list, terms: list, occurrences, records) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], names=["n", "term", "occurrences", "records"])


def marked(counts: DataFrame, rare: int, common: float) -> DataFrame:
    """counts without the total row, with marks: an array of 'rare' (at most `rare` records) and 'common' (at least that share of the
    records that hold a word). The counts are stored first: the total and the marks both read them."""
    counts = cut(counts)
    total = counts.where("n = 0").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"))  # one row
    marks: Column = F.filter(F.array(F.when(F.col("records") <= rare, "rare"), F.when(F.col("records") >= F.lit(common) * F.col("total"), "common")), lambda x: x.isNotNull())
    return counts.where("n > 0").crossJoin(F.broadcast(total)).withColumn("marks", marks)


def latest(rows: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """(key, value): of each key the value in its latest row; of rows of one time the greatest value. Null times come first."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(when, value)).alias("v")).select(key, f"v.{value}")
