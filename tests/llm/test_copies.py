from __future__ import annotations

import random

from kashida.llm import copies
from kashida.llm.frames import bodies

TEXTS = "id long, text_urdu string, piece string, body string, key string"
VERSES = "text_id long, couplet_index int, misra1_urdu string, misra2_urdu string, id string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], TEXTS)


def verses(spark, rows=()):
    return spark.createDataFrame([(*r, "q") for r in rows], VERSES)


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_bodies(spark):
    t = texts(spark, [(1, None), (2, "a\nb"), (3, None), (None, "c"), (4, "")])
    v = verses(spark, [(1, 2, "c", None), (1, 1, "a", "b"), (1, 1, "a", "b"), (1, 3, " ", ""), (9, 1, "z", "z"), (None, 1, "k", "k"), (2, 1, "no", "no"), (1, None, "first", "")])
    got = {(r.id, r.piece): (r.body, r.tail) for r in bodies(t, v).collect()}
    assert got == {(1, 0): ("first\na\nb\nc", ""), (2, 0): ("a\nb", ""), (4, 0): ("", "")}


def test_bodies_in_pieces(spark):
    v = verses(spark, [(1, k, f"a{k}", f"b{k}") for k in range(1, 8)])
    got = {r.piece: (r.body, r.tail) for r in bodies(texts(spark, [(1, None)]), v, piece=3, overlap=1).collect()}
    assert got == {0: ("a1\nb1\na2\nb2", "a3\nb3"), 1: ("a3\nb3\na4\nb4\na5\nb5", "a6\nb6"), 2: ("a6\nb6\na7\nb7", "")}


def test_canonical():
    a = copies.canonical("Title: A b | Poet: C\nDil  hai,\n\nTha!")
    assert a == copies.canonical("poet : c\nTITLE: a B\ndil hai tha") != copies.canonical("poet : c\nTITLE: a B\ndil tha hai")
    assert copies.canonical("ab cd") != copies.canonical("abcd") != copies.canonical("ａbcd")
    assert copies.canonical("") == copies.canonical(" .,\n") == ""


def test_copies(spark):
    rows = [(5, "A b, c"), (3, "a  B\nC!"), (9, "a b c"), (4, "x"), (7, None), (8, "..."), (6, "..."), (2, "Poet: p\nTitle: t\nv"), (1, "title: T | poet: P\nV"), (9, "a b c")]
    v = verses(spark, [(7, 1, "a", "b"), (7, 2, "c", "")])
    assert pairs(copies.copies(bodies(texts(spark, rows), v))) == [(1, 2), (3, 5), (3, 7), (3, 9)]
    rep = {r.id: r.copies for r in copies.representatives(bodies(texts(spark, rows[:-1]), v)).collect()}
    assert rep == {3: 4, 4: 1, 1: 2}


def test_runs_over_range_ends(spark):
    random.seed(1)
    rows = [("hot" if i % 3 == 0 else f"k{random.randrange(40)}", i) for i in range(600)]
    random.shuffle(rows)
    low = {}
    for k, i in rows:
        low[k] = min(i, low.get(k, i))
    got = pairs(copies.runs(spark.createDataFrame(rows, "key string, id long"), 7))
    assert got == sorted((low[k], i) for k, i in rows if i != low[k])


def test_texts_in_pieces_are_compared(spark):
    v = verses(spark, [(i, k, f"a{k}", "b") for i in (1, 2) for k in range(1, 9)] + [(3, k, f"a{k}", "b") for k in range(1, 8)])
    b = bodies(texts(spark, [(1, None), (2, None), (3, None)]), v, piece=3, overlap=1)
    assert pairs(copies.copies(b)) == [(1, 2)]


def test_pieces_and_one_text_have_one_key(spark):
    """However long a body is, and wherever it is cut: the words decide."""
    poem = [(k + (k > 5), f"misra {k}", "dіl" if k == 9 else f"b{k}") for k in range(1, 12)]
    cell = "Title: t\n" + "\n".join(f"{a}\n{b}" for _, a, b in poem)
    v = verses(spark, [(1, 0, "title : T", None), *((1, *x) for x in poem), (2, 0, "title : T", None), *((2, k + 40, a, b) for k, a, b in poem)])
    t = texts(spark, [(1, None), (2, None), (3, cell), (4, cell.upper()), (5, cell + " more"), (6, cell.replace("і", "i"))])
    for long in (4, 1 << 16):
        got = pairs(copies.runs(copies.keys(bodies(t, v, piece=3, overlap=1), long=long)))
        assert got == [(1, 2), (1, 3), (1, 4)]
    b = bodies(t.where("id <> 4"), verses(spark, [(i, k, a, x) for i, y in ((1, 0), (2, 3)) for k, a, x in [(y, "Title: t", None), *((z + 2 * y, *w) for z, *w in poem)]]), piece=3, overlap=1)
    assert pairs(copies.look_alikes(b)) == [(1, 6), (2, 6), (3, 6)]


def test_look_classes(spark):
    rows = [(1, "dil hai"), (2, "dіl hai"), (3, "dil　hai"), (4, "Dil hai"), (5, "dil"), (6, "dil"), (7, "ｄil hai"), (8, None)]
    assert pairs(copies.look_classes(bodies(texts(spark, rows), verses(spark)))) == [(1, 1, 1, 3), (2, 1, 2, 3), (3, 1, 1, 3), (7, 1, 7, 3)]


def test_look_alikes(spark):
    rows = [(1, "dil hai"), (2, "dіl hai"), (3, "dil　hai​"), (4, "Dil hai"), (5, "dil  hai"), (6, "ｄil hai"), (7, None), (8, "1"), (9, "１"), (10, "")]
    assert pairs(copies.look_alikes(bodies(texts(spark, rows), verses(spark)))) == [(1, 2), (1, 6), (2, 3), (2, 6), (3, 6)]


def test_consistent(spark):
    df = spark.createDataFrame([(1, "ك", None), (2, None, "ab"), (3, "", "ａ")], "id int, a string, b string")
    assert pairs(copies.consistent(df, ["a", "b"])) == [(1, "ک", None), (2, None, "ab"), (3, "", "a")]


def test_empty(spark):
    b = bodies(texts(spark, []), verses(spark))
    assert pairs(copies.copies(b)) == pairs(copies.look_alikes(b)) == pairs(copies.representatives(b)) == []
