from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from kashida.llm import graph, history, neardup
from kashida.llm.frames import bodies
from kashida.llm.shingles import Batch, likeness, signatures
from kashida.llm.textforms import words

from .test_copies import pairs, texts, verses


def word(i):
    """A word of letters for a number."""
    return "".join(chr(97 + int(c)) for c in str(i))


def corpus(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = [a + b + c for a in "bdgkl" for b in "aiou" for c in "mnrst"]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = list(r.choice(out)[1].split())
            for _ in range(r.randrange(0, 7)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w = w[: len(w) * 4 // 5] or w
        else:
            w = r.choices(vocabulary, k=r.choice([1, 2, 5, 20, 40, 60]))
        out.append((i + 1, " ".join(w)))
    return out


def brute(rows, n, threshold):
    w = {i: words(t) for i, t in rows if t and words(t)}
    return sorted((a, b) for a, b in itertools.combinations(sorted(w), 2) if likeness(w[a], w[b], n) >= threshold)


def test_shingles_and_signatures():
    b = Batch([["a", "b", "c", "d"], [], ["a"], ["a", "b", "c"], ["a"]], n=3)
    doc, s = b.shingles()
    assert doc.tolist() == [0, 0, 2, 3, 4] and s[2] == s[4] and s[3] in s[:2]
    d, sig = signatures(doc, s, 8)
    assert d.tolist() == [0, 2, 3, 4] and (sig[1] == sig[3]).all()
    assert not len(Batch([]).shingles()[0]) and not len(Batch([[]]).chunks(4)[0])


def test_pieces_have_the_shingles_of_the_whole():
    w = [str(x) for x in range(50)]
    whole = set(Batch([w]).shingles()[1].tolist())
    parts = Batch([w[:20], w[20:]], [w[20:22], []])
    assert set(parts.shingles()[1].tolist()) == whole


def test_chunks_cover_and_resynchronise():
    r = random.Random(1)
    w = [str(r.randrange(1000)) for _ in range(300)]
    d, c, n = Batch([w, w[:100] + ["new"] + w[100:]]).chunks(4)
    assert n[d == 0].sum() == sum(map(len, w)) and n[d == 1].sum() == sum(map(len, w)) + 3
    assert len(set(c[d == 0]) & set(c[d == 1])) >= len(c[d == 0]) - 3


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.6), (5, 0.8)])
def test_near_duplicates(spark, n, threshold):
    rows = [*corpus(), (500, None), (501, ""), (502, "..."), (503, "the same"), (504, "The  same!"), (505, "the")]
    found = neardup.all_pairs(*neardup.near_duplicates(bodies(texts(spark, rows), verses(spark)), n=n, threshold=threshold))
    assert pairs(found) == brute(rows, n, threshold)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d")]
    assert pairs(neardup.all_pairs(*neardup.near_duplicates(bodies(texts(spark, rows), verses(spark)), n=3, threshold=0.6))) == [(1, 2)]
    t, links = neardup.near_duplicates(bodies(texts(spark, []), verses(spark)))
    assert pairs(neardup.all_pairs(t, links)) == pairs(neardup.classes(t, links)) == []


@pytest.mark.parametrize("hot", [2, 4, 9, 256])
def test_long_lists_are_split_without_loss(spark, hot):
    """All pairs of fitting size that agree on three coordinates, whatever lists are skipped, and no others."""
    r = random.Random(hot)
    rows = [(i, " ".join([*"abcdefghijklmnopqrstuvwxyz", "x" + word(i)])) for i in range(1, 30)] + [(100 + i, t) for i, t in corpus(60, 8)]
    rows += [(300 + i, " ".join(r.choices("abcdefgh", k=12))) for i in range(40)]
    t = neardup.distinct_texts(neardup.read_words(bodies(texts(spark, rows), verses(spark)), 3, 20), 3, 20)
    got = pairs(neardup.collisions(t.reps, 0.6, 20, 3, hot=hot))
    sig = {x.id: (x.n, x.sig) for x in t.reps.collect()}
    want = [(a, b) for a, b in itertools.combinations(sorted(sig), 2) if min(sig[a][0], sig[b][0]) >= 0.6 * max(sig[a][0], sig[b][0]) and sum(x == y for x, y in zip(sig[a][1], sig[b][1])) >= 3]
    assert sorted(set(got)) == want and len(got) == len(want) > 400


def test_texts_in_pieces(spark):
    r = random.Random(2)
    line = lambda: " ".join(r.choices([word(x) for x in range(400)], k=6))
    poem = [(line(), line()) for _ in range(40)]
    v = [(1, k + 1, *x) for k, x in enumerate(poem)] + [(2, k + 1, *(x if k % 11 else (line(), line()))) for k, x in enumerate(poem)]
    cell = "\n".join(y for x in poem[:36] for y in x)
    t, links = neardup.near_duplicates(bodies(texts(spark, [(1, None), (2, None), (3, cell), (4, line())]), verses(spark, v), piece=8, overlap=2), n=3, threshold=0.6)
    w = {1: words("\n".join(y for x in poem for y in x)), 2: words("\n".join(y for x in v if x[0] == 2 for y in x[2:])), 3: words(cell)}
    assert {(x.a, x.b): round(x.likeness, 9) for x in links.collect()} == {(a, b): round(likeness(w[a], w[b], 3), 9) for a, b in itertools.combinations(w, 2)}


def test_classes(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g x"), (4, "z y x w v")]
    got = pairs(neardup.classes(*neardup.near_duplicates(bodies(texts(spark, rows), verses(spark)), n=3, threshold=0.6)))
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(None, 1), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(pairs(graph.components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {x: root(x) for x in parent}
    assert pairs(graph.components(spark.createDataFrame([], "a long, b long"))) == []


def sequential(items, old, couplets, n, threshold):
    """The statement, item after item."""
    have, lines, cases = [words(t) for t in old if t and words(t)], set(couplets), set()
    first = {}
    for i, at, full, form in sorted(items, key=lambda x: (x[0], x[1])):
        first.setdefault(i, (full, form))
    for i in sorted(first):
        full, form = first[i]
        w, c = words(full if full is not None else form), tuple(history.first_lines(full))
        if w and (any(likeness(w, x, n) >= threshold for x in have) or (c and c in lines)):
            cases.add(i)
        elif w:
            have.append(w)
            lines |= {c} - {()}
    return cases


@pytest.mark.parametrize("seed", [1, 2])
def test_new_items(spark, seed):
    rows = corpus(60, seed)
    r = random.Random(seed)
    pool = corpus(90, seed)[30:]
    items = []
    for i, t in enumerate(pool, 1):
        w = t.split() if isinstance(t, str) else t[1].split()
        lines = "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4))
        items.append((i, 100 + i, lines if i % 4 else None, " ".join(w)))
        if i % 9 == 0:
            items.append((i, 500 + i, lines if i % 4 else None, " ".join(w)))
    items += [(900, 1, "", None), (901, 2, None, None), (902, 3, "...", "x"), (903, 4, items[5][2], None), (904, 5, (items[8][2] or "q w e r").split("\n")[0] + "\nanother line of new words\n" + " ".join(r.choices("mnop", k=9)), None)]
    v = [(1, 1, "one two three", "four five six"), (2, 1, None, "tab"), (3, 2, "not first", "one"), (1, 1, "one two three", "four five six")]
    items.append((905, 6, "One two, three\n\nfour five six\nthen other words", None))
    df = spark.createDataFrame([(*x, "k") for x in items], "item_id long, arrived_at long, full_text string, normalized_text string, id string")
    status, table = history.new_items(df, bodies(texts(spark, rows), verses(spark)), verses(spark, v), n=3, threshold=0.6)
    want = sequential(items, [t for _, t in rows], {tuple(words("one two three four five six")), ("tab",)}, 3, 0.6)
    got = {x.id: x.status for x in status.collect()}
    assert {i for i, s in got.items() if s == "case"} == want
    assert set(got) == {x[0] for x in items}
    # what is accepted goes into the table, and the same batch brings nothing new then, but for items without words
    again = history.new_items(df, None, None, n=3, threshold=0.6, table=table)[0]
    wordless = {x[0] for x in items} - {i for i, _, f, t in items if words(f if f is not None else t)}
    assert {x.id for x in again.collect() if x.status == "accepted"} == wordless


def test_cases_that_share_no_chunk(spark):
    """Short items with a changed word at each end, of which hardly a chunk is left: the word sequences still find the text."""
    r = random.Random(5)
    rows, items = [], []
    while len(rows) < 12:
        w = [word(r.randrange(100_000, 1_000_000)) for _ in range(r.randrange(10, 15))]
        v = ["new", *w[1:-1], "made"] if r.random() < 0.5 else [w[0], "new", *w[2:]]
        doc, chunk, size = Batch([v, w]).chunks(history.DIVISOR)
        shared = size[(doc == 0) & np.isin(chunk, chunk[doc == 1])].sum()
        if likeness(v, w, 3) >= 0.6 and shared < (history.COVERAGE - history.SKIPPED) * sum(map(len, v)):
            rows.append((len(rows) + 1, " ".join(w)))
            items += [(len(rows), 1, None, " ".join(v)), (len(rows) + 100, 1, None, " ".join(v[::-1])), (len(rows) + 200, 1, None, " ".join(w[::-1]))]
    df = spark.createDataFrame(items, "item_id long, arrived_at long, full_text string, normalized_text string")
    want = sequential(items, [t for _, t in rows], set(), 3, 0.6)
    assert set(range(1, 13)) <= want and set(range(201, 213)) <= want and not set(range(101, 113)) & want
    got = history.new_items(df, bodies(texts(spark, rows), verses(spark)), verses(spark), n=3, threshold=0.6)[0]
    assert {x.id for x in got.collect() if x.status == "case"} == want


def test_refrains_with_one_word_changed_and_short_texts(spark):
    """Poems whose refrain comes sixty times and differs in one word, and texts of 14 words with one changed: none is lost."""
    r = random.Random(7)
    some = lambda k: [word(r.randrange(100_000, 1_000_000)) for _ in range(k)]
    rows, items = [], []
    for i in range(1, 41):
        refrain, verse = some(9), [some(8) for _ in range(60)]
        if i % 2:
            changed = [*refrain[:4], *some(1), *refrain[5:]]
            a, b = (" ".join(x for v in verse for x in (*v, *f)) for f in (refrain, changed))
        else:
            short = some(14)
            at = r.choice([0, 1, 12, 13])
            a, b = " ".join(short), " ".join([*short[:at], *some(1), *short[at + 1 :]])
        rows.append((i, a))
        items.append((i, 1, None, b))
    df = spark.createDataFrame(items, "item_id long, arrived_at long, full_text string, normalized_text string")
    want = sequential(items, [t for _, t in rows], set(), 3, 0.6)
    assert len(want) == 40
    got = history.new_items(df, bodies(texts(spark, rows), verses(spark)), verses(spark), n=3, threshold=0.6)[0]
    assert {x.id for x in got.collect() if x.status == "case"} == want


def test_two_batches(spark):
    """A second batch is held against what the first accepted, by the table alone; its item ids may be those of texts and items."""
    rows, pool = corpus(30, 4), corpus(75, 4)[30:]
    plain = [t for _, t in pool]
    lines = ["\n".join(" ".join(t.split()[k : k + 4]) for k in range(0, len(t.split()), 4)) for t in plain]
    one = [(i, 1, x, None) for i, x in enumerate(lines[:25], 1)]
    two = [(i, 1, x, None) for i, x in enumerate(lines[15:], 5)]
    cases = sequential(one, [t for _, t in rows], set(), 3, 0.6)
    taken = next(x for i, _, x, _ in one if i not in cases and x.count("\n") > 2)
    two.append((90, 1, "\n".join([*taken.split("\n")[:2], "other words here altogether"]), None))
    v = [(1, 1, "one two three", "four five six")]
    two.append((91, 1, "One two three\nfour five six\nthen other words", None))
    want = sequential(one + [(i + 1000, *x) for i, *x in two], [t for _, t in rows], {tuple(words("one two three four five six"))}, 3, 0.6)
    schema = "item_id long, arrived_at long, full_text string, normalized_text string"
    a, table = history.new_items(spark.createDataFrame(one, schema), bodies(texts(spark, rows), verses(spark)), verses(spark, v), n=3, threshold=0.6)
    before = table.rows().count()
    b = history.new_items(spark.createDataFrame(two, schema), None, None, n=3, threshold=0.6, table=table)[0]
    got = {x.id for x in a.collect() if x.status == "case"} | {x.id + 1000 for x in b.collect() if x.status == "case"}
    assert sorted(got - want) == sorted(want - got) == [] and {1090, 1091} <= want
    assert table.rows().count() > before


def test_copies_and_hot_sequences(spark):
    """A text that a third of all rows have is few records, and a formula that all texts hold finds none by itself."""
    formula = " ".join(f"f{word(k)}" for k in range(12))
    rows = [(i, f"{formula} " + " ".join(word(1000 * i + k) for k in range(12))) for i in range(1, 60)] + [(i, "the same text again and again here") for i in range(100, 130)]
    items = [(1, 1, None, formula + " " + " ".join(word(90_000 + k) for k in range(12))), (2, 1, None, rows[4][1] + " end"), (3, 1, None, "The same text again and again, here!"), (4, 1, None, formula)]
    df = spark.createDataFrame(items, "item_id long, arrived_at long, full_text string, normalized_text string")
    status, table = history.new_items(df.repartition(1), bodies(texts(spark, rows).coalesce(1), verses(spark)), verses(spark), n=3, threshold=0.6)
    assert {x.id for x in status.collect() if x.status == "case"} == sequential(items, [t for _, t in rows], set(), 3, 0.6) == {2, 3}
    assert table.rows().where("kind = 0").count() <= 59 * 24 + 30 + 24 + 12


def test_texts_in_pieces_are_known(spark):
    r = random.Random(4)
    line = lambda: " ".join(r.choices([word(x) for x in range(400)], k=6))
    poem = [(line(), line()) for _ in range(30)]
    v = verses(spark, [(1, k + 1, *x) for k, x in enumerate(poem)])
    items = [(1, 1, "\n".join(y for x in [(line(), line())] + poem[1:] for y in x), None), (2, 1, "\n".join(y for x in poem[:12] for y in x[::-1]), None), (3, 1, "\n".join(poem[0]) + "\nmore", None)]
    df = spark.createDataFrame(items, "item_id long, arrived_at long, full_text string, normalized_text string")
    status = history.new_items(df, bodies(texts(spark, [(1, None), (2, "x y")]), v, piece=8, overlap=2), v, n=3, threshold=0.6)[0]
    assert pairs(status) == [(1, "case"), (2, "accepted"), (3, "case")]


def test_no_items_or_history(spark):
    e = "item_id long, arrived_at long, full_text string, normalized_text string"
    none = bodies(texts(spark, []), verses(spark))
    assert history.new_items(spark.createDataFrame([], e), none, verses(spark), 3, 0.6)[0].collect() == []
    got = history.new_items(spark.createDataFrame([(1, 1, "a b c", None), (2, 2, "a b c", None), (None, 3, "a", "a")], e), none, verses(spark), 3, 0.6)[0]
    assert pairs(got) == [(1, "accepted"), (2, "case")]


def test_chains_are_decided_in_order(spark):
    nodes = spark.createDataFrame([(i, bytes([i // 6]) if i < 12 else None) for i in range(1, 30)], "id long, couplet binary")
    links = spark.createDataFrame([(i, i + 1) for i in range(12, 29)] + [(3, 20)], "lo long, hi long")
    status, done = {}, {}
    lo = {}
    for a, b in [(i, i + 1) for i in range(12, 29)] + [(3, 20)]:
        lo.setdefault(b, []).append(a)
    for i in range(1, 30):
        c = i // 6 if i < 12 else None
        case = any(status[a] == "accepted" for a in lo.get(i, [])) or (c is not None and c in done)
        status[i] = "case" if case else "accepted"
        if not case and c is not None:
            done[c] = i
    assert dict(pairs(history.in_order(nodes, links))) == status
    for group in (5, 100):  # what rounds leave is decided group by group, or in further rounds
        assert dict(pairs(history.in_order(nodes, links, rounds=2, group=group))) == status


def test_very_long_text(spark):
    long = " ".join(word(i % 5000) for i in range(200_000))
    got = neardup.all_pairs(*neardup.near_duplicates(bodies(texts(spark, [(1, long), (2, long + " end"), (3, "short")]), verses(spark)), n=3, threshold=0.6))
    assert pairs(got) == [(1, 2)]
    assert np.isclose(likeness(words(long), words(long + " end"), 3), 5000 / 5001)
