from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from kashida.llm import terms

from .test_copies import pairs


def counted(rows, most):
    n, held = Counter(), Counter()
    for w in rows:
        grams = [tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]
        n.update(grams)
        held.update(set(grams))
    return {" ".join(g): (len(g), n[g], held[g]) for g in n}


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    r = random.Random(seed)
    rows = [[r.choice("ab" if seed % 2 else "abcdefgh") for _ in range(r.choice([1, 2, 9, 40]))] for _ in range(1 if seed == 4 else 30)]
    rows += rows[:3]  # equal records
    flat = [ord(x) for w in rows for x in w]
    record = np.repeat(np.arange(len(rows)), [len(w) for w in rows])
    order, common = terms.suffix_array(np.array(flat), record)
    starts = np.cumsum([0] + [len(w) for w in rows])
    suffix = lambda i: flat[i : starts[record[i] + 1]]
    assert order.tolist() == sorted(range(len(flat)), key=lambda i: (suffix(i), record[i], i))
    for k in range(1, len(order)):
        a, b = suffix(order[k - 1]), suffix(order[k])
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("most", [1, 2, 3, 7, 100])
def test_counts(spark, monkeypatch, most):
    r = random.Random(most)
    rows = [[r.choice("abcde") for _ in range(r.choice([0, 1, 2, 9, 30]))] for _ in range(80)]
    df = spark.createDataFrame([(" ".join(w), 1) for w in rows] + [(None, 1), ("...", 2)], "text string, term int").repartition(5)
    got = {x.term: (x.n, x.occurrences, x.records) for x in terms.term_counts(df, "text", most).collect()}
    assert got.pop(None) == (0, *[sum(1 for w in rows if w)] * 2)
    assert got == counted(rows, most)


def test_whole_values_and_marks(spark):
    df = spark.createDataFrame([("Dil  hai",)] * 5 + [("dil hai!",), ("tha",), ("",), (None,)], "v string")
    got = terms.marked(terms.term_counts(df, "v", whole=True), 2, 0.5)
    assert sorted((x.term, x.records, tuple(x.marks)) for x in got.collect()) == [("dil hai", 6, ("common",)), ("tha", 1, ("rare",))]
    one = terms.marked(terms.term_counts(df.limit(1), "v"), 2, 0.2)
    assert {tuple(x.marks) for x in one.collect()} == {("rare", "common")}


def test_empty(spark):
    df = spark.createDataFrame([], "v string, n int")
    assert terms.term_counts(df, "v").collect() == terms.marked(terms.term_counts(df, "v"), 2, 0.2).collect() == []


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c"), (2, 1, None), (None, 3, "d"), (3, 5, "x"), (3, 5, "y")], "k long, t long, v string")
    assert pairs(terms.latest(df, "k", "t", "v")) == [(1, "b"), (2, None), (3, "y")]
