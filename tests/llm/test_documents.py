from __future__ import annotations

import os
import random

import numpy as np
import pytest

from kashida.llm import leaks, mixing, quality
from kashida.llm.textforms import words

from .test_copies import pairs

DOCS = "doc_id long, text string, lang string, source string, words string, item_id long, votes string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, "w", 1, "v") for i, t, s in rows], DOCS)


def brute_leaks(documents, items, share=0.5, changed=10):
    out = set()
    for d, t in documents:
        w = words(t)
        for i, x in items:
            own = words(x)
            for shift in range(-len(own), len(w)):
                same = [0 <= k + shift < len(w) and own[k] == w[k + shift] for k in range(len(own))]
                if own and any((j - k) >= share * len(own) and (j - k - sum(same[k:j])) * changed <= j - k and 0 <= k + shift and j + shift <= len(w) for k in range(len(own)) for j in range(k + 1, len(own) + 1)):
                    out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("seeds", [1, 3])
def test_automaton_finds_every_occurrence(seeds):
    r = random.Random(seeds)
    items = [[r.choice([0, 1, 2]) for _ in range(r.randrange(1, 12))] for _ in range(8)]
    a = leaks.Automaton(items, [seeds + i % 2 for i in range(8)], 4)
    texts = [[r.choice([-1, 0, 1, 2, 3]) if r.random() < 0.1 else r.choice([0, 1, 2]) for _ in range(n)] for n in (60, 1, 33, 60)]
    tokens = np.array([x for t in texts for x in t])
    ends = np.cumsum([len(t) for t in texts])
    got = {(p, at): (s, n) for p, at, s, n in zip(*(x.tolist() for x in a.stream(tokens, ends - [len(t) for t in texts], ends)))}
    for p, text in enumerate(texts):
        for at in range(1, len(text) + 1):
            match = lambda n: [(i, k) for i, w in enumerate(items) for k in range(n, len(w) + 1) if w[k - n : k] == text[at - n : at]]  # noqa: E731, B023
            n = max((n for n in range(1, at + 1) if match(n)), default=0)
            counts = any(m >= seeds + i % 2 for m in range(1, n + 1) for i, _ in match(m))
            assert ((p, at) in got) == counts
            if counts:
                s, m = got[p, at]
                assert m == n and sorted(zip(*(x.tolist() for x in a.occurrences(s)))) == match(n)


def test_stretch():
    assert leaks.stretch([True] * 5, 10) == (0, 5)
    assert leaks.stretch([], 10) == leaks.stretch([False], 10) == (0, 0)
    same = [True] * 9 + [False] + [True] * 3
    assert leaks.stretch(same, 10) == (0, 13)
    assert leaks.stretch([False, *same[:8], False, True], 10) == (1, 11)
    assert leaks.stretch([False, *same[:7], False, True], 10) == (1, 8)


def test_seed_is_never_too_long():
    for n in range(1, 80):
        k = leaks.seed(n, 0.5, 10)
        for size in range(max(1, -(-n // 2)), n + 1):
            m = size // 10
            assert k <= -(-(size - m) // (m + 1))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks(spark, seed):
    r = random.Random(seed)
    v = [f"v{x}" for x in range(60)]
    v = ["".join(chr(97 + int(c)) for c in x[1:]) + "q" for x in v]
    items = [(i, " ".join(r.choices(v, k=r.choice([1, 3, 12, 25])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, items[3][1])]
    documents = []
    for d in range(40):
        w = r.choices(v, k=30)
        own = words(r.choice(items[:12])[1])
        lo = r.randrange(len(own))
        part = own[lo : lo + r.randrange(1, len(own) + 1)]
        if len(part) > 6 and r.random() < 0.6:
            part[r.randrange(len(part))] = r.choice(v)
        documents.append((d, " ".join(w[:10]) + ";\n" + " ".join(part).upper() + " , " + " ".join(w[10:])))
    documents += [(90, None), (91, ""), (92, items[5][1])]
    df, it = docs(spark, [(d, t, "s") for d, t in documents] + [(None, "x", "s")]), spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc_id string")
    want = brute_leaks(documents, items)
    assert pairs(leaks.leaks(df, it).select("doc_id", "item_id")) == want
    # the items in several automata
    assert pairs(leaks.leaks(df, it, block=200).select("doc_id", "item_id")) == pairs(leaks.leaks(df, it, block=100, together=2).select("doc_id", "item_id")) == want
    clean = {x.doc_id: (x.text, x.removed) for x in leaks.cleaned(df, leaks.leaks(df, it)).collect()}
    assert clean.pop(None) == ("x", 0)  # a document without id stays as it is
    assert set(clean) == {d for d, _ in documents} and {d for d, x in clean.items() if x[1]} == {d for d, _ in want}
    assert all(len(words(clean[d][0])) == len(words(t)) - clean[d][1] and (clean[d][1] or clean[d][0] == t) for d, t in documents)


def test_long_documents_are_streamed_in_parts(spark, monkeypatch):
    r = random.Random(9)
    v = ["".join(r.choices("abcdefgh", k=4)) for _ in range(3000)]
    items = [(i, " ".join(r.choices(v, k=40))) for i in range(6)]
    w = r.choices(v, k=5000)
    for i, at in enumerate((500, 1010, 1536, 2040, 4960)):
        w[at : at + 40] = words(items[i][1])
    found = leaks.Leaks([items], 0.5, 10).find([w, w[:10], w[490:560]])
    assert sorted((d, i, b, e) for d, i, b, e, _ in found) == [(0, i, at, at + 40) for i, at in enumerate((500, 1010, 1536, 2040, 4960))] + [(2, 0, 10, 50)]


def test_no_documents_or_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert pairs(leaks.leaks(docs(spark, [(1, "a", "s")]), none)) == pairs(leaks.leaks(docs(spark, []), none)) == []


def test_without():
    assert leaks.without("One two, THREE four. Five", [(1, 3)]) == "One four. Five"
    assert leaks.without("a b", [(0, 2)]) == ""


def test_water_fill():
    fill = mixing.water_fill([("a", 0.5, 1, 100), ("b", 0.25, 2, 100), ("c", 0.25, 9, 800)])
    assert fill == {"a": 100.0, "b": 200.0, "c": 700.0}
    assert mixing.water_fill([("a", 0.5, 1, 0), ("b", None, 1, 5), ("c", 0.5, 0, 5)]) == {"a": 0.0, "b": 0.0, "c": 0.0}
    assert mixing.water_fill([("a", 1.0, 1, 10), ("b", 1.0, 1, 10)], 100) == {"a": 10.0, "b": 10.0}
    assert mixing.water_fill([]) == {}


@pytest.mark.skipif(not os.path.exists(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}"), reason="no tokenizer files")
def test_mixture(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["dil", "hai", "poem"], k=r.randrange(1, 20))), "abc"[min(2, i % 6)]) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "b"), (702, "lost", None), (703, "other", "z"), (None, "x", "a")]
    targets = spark.createDataFrame([("a", 0.6, 2, "k"), ("b", 0.3, 3, "k"), ("c", 0.1, 1, "k"), ("none", 0.0, 1, "k"), (None, 0.5, 1, "k")], "source string, target_share double, max_repeats int, tokens string")
    used, report = mixing.mixture(docs(spark, rows), targets)
    most, got = {"a": 2, "b": 3, "c": 1}, {x.doc_id: (x.source, x.copies) for x in used.collect()}
    assert all(1 <= c <= most[s] for s, c in got.values()) and len(got) == used.count()
    by = {x.source: x for x in report.collect()}
    assert set(by) == {"a", "b", "c", "none"} and abs(sum(x.share for x in by.values()) - 1) < 1e-5
    assert by["a"].most_copies == 2 and by["a"].used_tokens == 2 * by["a"].tokens
    for x in by.values():
        assert abs(x.used_tokens - x.allotted) <= 20
    again = {x.doc_id: (x.source, x.copies) for x in mixing.mixture(docs(spark, rows).repartition(7), targets)[0].collect()}
    assert again == got
    assert mixing.mixture(docs(spark, []), targets)[0].collect() == []


def statistic(text, name):
    return dict(zip(quality.STATISTICS, quality.statistics(text, [frozenset(["the", "hai"]), frozenset(["of"])])))[name]


def test_statistics():
    t = "The lamp opens, the door.\n- one\nABC دلx 12"
    assert statistic(t, "words") == 8 and statistic(t, "lines") == 3
    assert statistic(t, "common_share") == 2 / 8 and statistic(t, "end_share") == 1 / 3
    assert statistic(t, "mixed_share") == 1 / 8 and statistic(t, "marker_share") == 2 / 10
    assert all(x == 0 for x in quality.statistics("", [])) and quality.statistics("...", [])[0] == 0


def test_types(spark):
    r = random.Random(4)
    w = [f"{a}{b}{c}" for a in "bdg" for b in "aiou" for c in "nrst"]
    prose = lambda: ". ".join("the " + " ".join(r.choices(w, k=6)) + " hai " + " ".join(r.choices(w, k=4)) + " the of the hai" for _ in range(6)) + "."
    verse = lambda: "\n".join("the " + " ".join(r.choices(w, k=3)) + " hai of the" for _ in range(10))
    lists = lambda: "\n".join(f"{i}. " + " ".join(r.choices(w, k=2)) for i in range(1, 15))
    tables = lambda: "\n".join(f"{r.randrange(999)} | {r.choice(w)} | 0.{r.randrange(99)} | {r.choice(w)}" for _ in range(12))
    junk = lambda: "\n".join("".join(r.choices("#^|<>=*~", k=40)) for _ in range(6))
    rows = [(k * 100 + i, f(), "s") for k, f in enumerate((prose, verse, lists, tables, junk)) for i in range(60 if k < 2 else 20)]
    common = spark.createDataFrame([("en", "the", 1), ("en", "of", 1), ("u", "hai", 1), (None, None, 1)], "lang string, word string, doc_id int")
    df = docs(spark, [*rows, (900, None, "s"), (901, "", "s"), (None, "x", "s"), (0, rows[0][1], "s")])
    got = quality.text_types(df, common)
    assert {x.doc_id for x in got.where("junk > 0.5").collect()} == {i for i, *_ in rows if i >= 200} | {900, 901}
    assert got.count() == len(rows) + 3
    assert quality.text_types(docs(spark, []), common).count() == 0
    long = quality.text_types(docs(spark, [(1, prose() * 3000, "s")]), common).first()
    assert long.words > 100_000


def test_learning_needs_no_labels():
    p = quality.learn([("00", 90), ("11", 10), ("0-", 5), ("1-", 2)])
    assert p["00"] < 0.1 and p["11"] > 0.9 and quality.learn([]) == {}
