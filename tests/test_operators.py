from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kashida.operators import catalogue, ingest, learning, likeness, search, verse
from kashida.sources import files, tables

V = "text_id long, couplet_index int, misra1_urdu string, misra2_urdu string, misra1_english string, misra2_english string"


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def verses(spark, *v):
    return spark.createDataFrame([(*x, None, None) for x in v], V)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 5), (2, "z", 4), (3, "d", None)], "k int, v string, t int")
    once = tables.upsert(old, new, ["k"], ["t"])
    assert rows(once) == [(1, "a", 1), (2, "c", 5), (3, "d", None)]
    assert rows(tables.upsert(once, new, ["k"], ["t"])) == rows(once)
    assert rows(tables.upsert(old.limit(0), new.limit(0), ["k"], ["t"])) == []


def test_insert_missing(spark):
    old = spark.createDataFrame([(1, None)], "a int, b int")
    new = spark.createDataFrame([(1, None), (2, 1), (2, 1)], "a int, b int")
    assert rows(tables.insert_missing(old, new, ["a", "b"])) == [(1, None), (2, 1)]


def test_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5)
    got = rows(tables.number(df, 10, ["v"]), "v", "id")
    assert sorted(got) == [(i, i + 11) for i in range(1000)]
    assert rows(tables.number(df.limit(0), 10, ["v"])) == []


def test_get_or_create(spark):
    known = spark.createDataFrame([(5, "x", None)], "id long, name string, email string")
    facts = spark.createDataFrame([("x", None, 1), ("y", "e", 2), ("y", "e", 3), (None, None, 4)], "name string, email string, f int")
    table, got = tables.get_or_create(known, facts, ["name", "email"])
    assert table.count() == 3 and {r.f: r.id for r in got.collect()}[1] == 5
    ids = {r.f: r.id for r in got.collect()}
    assert ids[2] == ids[3] != ids[4] and {ids[2], ids[4]} == {6, 7}


def test_rewrite_from_itself(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(3).write.parquet(p)
    tables.rewrite(spark.read.parquet(p).select((F.col("id") + 1).alias("id")), p)
    assert rows(spark.read.parquet(p)) == [(1,), (2,), (3,)] and os.listdir(tmp_path) == ["t"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("دل".encode() + b"\xff")
    assert rows(files.read_texts(spark, str(tmp_path)), "text") == [("دل",)]
    df = spark.createDataFrame([(1, None, ["a"])], "a int, b string, c array<string>")
    assert rows(files.spill(df, str(tmp_path / "s"))) == rows(df)


def test_pages(spark):
    assert spark.range(1).select(*catalogue.page_numbers(F.lit(25), 3, 12).values()).first()[:] == (3, 2, None)
    t = spark.range(1, 26).withColumn("poet_id", F.lit(1).cast("long")).withColumn("form", F.lit("ghazal")).withColumn("title_urdu", F.lit("t")).withColumn("title_english", F.lit("t"))
    all_pages = [r.id for n in (1, 2, 3) for r in catalogue.poet_page(t, verses(spark), 1, n).orderBy("id").collect()]
    assert all_pages == list(range(1, 26))


def test_navigation(spark):
    t = spark.createDataFrame([(3, 1, "ghazal"), (7, 1, "ghazal"), (9, 1, "ghazal"), (8, 1, "nazm")], "id long, poet_id long, form string")
    assert rows(catalogue.navigation(t).where("id = 7"), "previous_id", "next_id", "total") == [(3, 9, 3)]
    assert rows(catalogue.navigation(t).where("id = 8")) == []


def test_navigation_over_ranges(spark):
    t = spark.createDataFrame([(i, i % 3 or None, "ghazal") for i in range(1, 60)], "id long, poet_id long, form string")
    assert rows(catalogue.navigation(t, width=7)) == rows(catalogue.navigation(t))


def test_refrains(spark):
    v = verses(spark, (1, 1, "a", "x کیوں"), (1, 2, "b", "y ستائے کیوں"), (1, 3, "c", ""), (1, 4, "d", None), (2, 1, "m n", "a b"), (2, 2, "e", "c d"))
    s = verse.seconds(v)
    assert rows(verse.refrains(s)) == [(1, "کیوں", 1.0), (2, "b", 0.5)]
    assert rows(verse.refrains_repeated(s)) == [(1, "کیوں"), (2, None)]
    assert rows(verse.refrains_of_words(verse.seconds(verses(spark, (1, 1, "", "a نہ ملا"), (1, 2, "", "b نہ ملا"))))) == [(1, "نہ ملا", 2)]
    assert rows(verse.rhymes(s, verse.refrains(s)), "text_id", "qaafiya", "qaafiya_pattern") == [(1, ["x", "ستایے"], "x"), (2, ["a"], "a")]
    assert rows(verse.refrains(verse.seconds(verses(spark)))) == []


def test_openings(spark):
    v = verses(spark, (1, 1, "x ملیں", "y ملیں"), (1, 2, "a", "میر ملیں"), (2, 1, "x", "y ملیں"))
    names = spark.createDataFrame([(1, "مير"), (2, None)], "text_id long, name string")
    r = verse.refrains(verse.seconds(v))
    assert rows(verse.openings_and_closings(v, r, names)) == [(1, True, True), (2, False, False)]


def test_analysis(spark):
    t = spark.createDataFrame([(1, 5)], "id long, poet_id long")
    p = spark.createDataFrame([(5, "میر")], "id long, name_urdu string")
    got = verse.analysis(t, p, verses(spark, (1, 1, "دل ملیں", "خواب ملیں"), (1, 2, "a", "میر ملیں"))).first()
    assert (got.radif, got.radif_confidence, got.qaafiya, got.theme, got.matla, got.maqta_detected) == ("ملیں", 1.0, ["خواب", "میر"], "love", True, True)


def test_search(spark):
    t = spark.createDataFrame([(1, 1, "ghazal", "دل", None, 3), (2, 1, "ghazal", None, "DIL", 4), (3, 1, "ghazal", "x", None, 3), (4, 1, "nazm", "دل", None, 3), (5, 9, "ghazal", "دل", None, 3)], "id long, poet_id long, form string, title_urdu string, title_english string, contributor_id long")
    p = spark.createDataFrame([(1, "P")], "id long, name string")
    v = verses(spark, (3, 1, "کا دل", None), (3, 2, "دل", "دل"), (1, 1, "a", "b"))
    assert rows(search.search(t, p, v, "dil"), "text_id", "first_verse") == [(1, "a\nb"), (2, None), (3, "کا دل")]
    assert rows(search.total(t, v, keyword="dil")) == [(4,)]  # the unknown poet's text counts, but isn't shown
    assert rows(search.search(t, p, v, contributor_id=4), "text_id") == [(2,)] and rows(search.search(t, p, v)) == []


def test_ingest(spark):
    up = spark.createDataFrame([(1, "a b\nc d\n###GHZ###\none\n###GHZ###\nA  b\nC d"), (2, None), (3, "")], "upload_id long, text string")
    items = ingest.hashed(ingest.read_blocks(up), "text").withColumn("key", F.col("block")).withColumn("poet_id", F.lit(1).cast("long")).withColumn("contributor_id", F.lit(None).cast("long"))
    texts = spark.createDataFrame([(4, "none", None)], "id long, content_hash string, first_couplet_hash string")
    assert rows(ingest.flagged(items, texts, "key"), "key", "dup_content", "dup_couplet", "dup_in_batch") == [(0, False, False, False), (2, False, False, True)]
    new, v = ingest.new_rows(ingest.accept(items, texts, "key"), texts, "text", "key")
    assert rows(new, "id", "title_urdu", "verse_count") == [(5, "a b", 1)] and rows(v) == [(5, 1, "a b", "c d")]
    again = texts.unionByName(new.select("id", "content_hash", "first_couplet_hash"))
    assert ingest.accept(items, again, "key").count() == 0


def test_explained(spark):
    f = spark.createDataFrame([(1, "r", ["a", "b"], "t"), (2, "r", ["b", "c"], "u"), (3, None, None, None)], "text_id long, radif string, qaafiya array<string>, theme string")
    pairs = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.0), (3, 3, 0.0)], "a long, b long, cosine double")
    assert rows(likeness.explained(pairs, f), "a", "b", "score", "percentage") == [(1, 2, 0.7, 70.0), (1, 3, 0.0, 0.0), (3, 3, 0.0, 0.0)]
    first = likeness.explained(pairs, f).where("b = 2").first().explanation
    assert first.split("\n") == ["Semantic similarity (0.80) → 40.0%", "Same radif 'r' → 20%", "Qaafiya overlap (0.50) → 10.0%", "Different theme → 0%"]


def test_searches_in_blocks(spark):
    """Every target against all rows, whatever the blocks; equal values by id."""
    import numpy as np

    r = np.random.default_rng(1)
    x = np.round(r.standard_normal((60, 5)), 1)
    x[7] = x[3]
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "text_id long, v array<double>")
    targets = spark.createDataFrame([(3,), (20,), (3,), (99,)], "text_id long")
    n = np.sqrt((x * x).sum(1))
    want = sorted((a, b, c) for a in (3, 20) for c, b in sorted((round(float(x[a] @ x[b] / (n[a] * n[b] + 1e-8)), 6), b) for b in range(60) if b != a) for _ in [0] if (-c, b) in sorted((-round(float(x[a] @ x[k] / (n[a] * n[k] + 1e-8)), 6), k) for k in range(60) if k != a)[:4])
    for size in (7, 2048):
        assert rows(likeness.by_vectors(v, targets, 4, size=size)) == sorted(want, key=repr)
    assert rows(likeness.by_vectors(v.limit(0), targets, 4)) == rows(likeness.by_vectors(v, targets.limit(0), 4)) == []

    vocabulary = "دل خواب رات چاند گل".split()
    t = [(i, i % 3 + 1, "t", "ghazal" if i % 5 else "nazm", " ".join(r.choice(vocabulary, r.integers(0, 5)).tolist()) if i % 11 else None) for i in range(50)]
    texts = spark.createDataFrame(t, "id long, poet_id long, title_urdu string, form string, text_urdu string")
    poets = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, name string")
    names = {1: "A", 2: "B", 3: None}
    sets = {i: set((w or "").split()) for i, _, _, _, w in t}
    poet = {i: names[p] for i, p, *_ in t}

    def score(a, b):
        j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
        return int(min(1.0, 0.7 * j + (0.15 if poet[a] is not None and poet[a] == poet[b] else 0)) * 1000 + 0.5) / 1000

    want = [(a, b, s) for a in (5, 6, 11) for s, b in sorted((-score(a, b), b) for b, _, _, f, _ in t if b != a and f == "ghazal")[:6]]
    for size in (9, 2048):
        got = likeness.by_words(texts, poets, texts.where("id IN (5, 6, 11)").select("id"), n=6, size=size)
        assert rows(got, "target", "id", "score") == sorted([(a, b, -s) for a, b, s in want], key=repr)


def test_centroids(spark):
    v = spark.createDataFrame([(i, i % 3 if i % 7 else None, [float(i), 1.0]) for i in range(60)], "text_id long, k long, v array<double>").repartition(4)
    want = {k: [i for i in range(60) if i % 7 and i % 3 == k] for k in range(3)}
    assert {r.k: r.centroid for r in likeness.centroids(v, "k", held=1).collect()} == {k: [sum(x) / len(x), 1.0] for k, x in want.items()}
    assert likeness.centroids(v.limit(0), "k").collect() == []


def test_fingerprints_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)], "text_id long, v array<double>")
    f = spark.createDataFrame([(1, "r")], "text_id long, radif string")
    p = spark.createDataFrame([(k, [float(k), 1.0], [("r", 2)] if k == 5 else None) for k in range(1, 12)], "poet_id long, centroid array<double>, common_radif array<struct<radif:string,n:bigint>>")
    one, many = (rows(likeness.by_fingerprint(v, f, p, block=b)) for b in (4096, 3))
    assert one == many and len(one) == 24 and likeness.by_fingerprint(v, f, p.limit(0)).collect() == []
    assert [r for r in one if r[0] == 1 and r[3] == 1][0][1] == 5


@pytest.mark.parametrize("block", [2, 4096])
def test_nearest_means(spark, block):
    data = spark.createDataFrame([(1, 7, [1.0, 0.1]), (2, 8, [0.0, 1.0]), (3, 9, None), (4, None, [1.0, 1.0])], "id long, label int, v array<double>")
    means = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 3.0]), (9, [1.0, 1.0]), (5, [2.0, 2.0])], "label int, centroid array<double>")
    assert rows(learning.nearest_centroid(data, means, "id", "label", "v", block)) == [(1, 7, 7, 5, 9), (2, 8, 8, 5, 9), (3, 9, None, None, None), (4, None, 5, 9, 8)]  # the epsilon below the fraction tells 8 from 7
    assert rows(learning.nearest_centroid(data, means.limit(0), "id", "label", "v"), "id", "predicted") == [(1, None), (2, None), (3, None), (4, None)]


def test_rounding_is_that_of_binary_numbers(spark):
    from kashida.functions.vectors import rounded

    df = spark.createDataFrame([(4.015,), (0.125,), (2.5,), (None,), (-2.795,), (0.0,)], "x double")
    assert [r[0] for r in df.select(rounded(F.col("x"), 2)).collect()] == [4.01, 0.13, 2.5, None, -2.8, 0.0]


def test_rounding_keeps_the_sign_of_zero_and_large_numbers(spark):
    from kashida.functions.vectors import rounded

    inf = float("inf")
    x = [-0.0, 0.0, -1e-9, 1e-9, -5e-7, 5e-7, 0.0078125, -0.0078125, 3e38, -3e38, 1e308, inf, -inf, float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    assert list(map(repr, (r.y for r in df.select("i", rounded(F.col("x"), 6).alias("y")).orderBy("i").collect()))) == list(map(repr, [-0.0, 0.0, -0.0, 0.0, -1e-6, 1e-6, 0.007813, -0.007813, 3e38, -3e38, 1e308, inf, -inf, float("nan"), None]))


def test_trigram_filter_keeps_all(spark):
    from kashida.functions.vectors import may_share_trigrams, trigrams

    df = spark.createDataFrame([(x,) for x in ("Dil", "a dilx", "xdil", "il d", "d", "", None, "دل میں", "di l", "ld", "DI-L1")], "s string")
    for query in ("dil", "دل", "d", "l1", "..."):
        share = F.size(F.array_intersect(trigrams(F.col("s")), trigrams(F.lit(query)))) > 0
        assert all(r[0] == r[1] for r in df.select(share, may_share_trigrams(F.col("s"), query)).collect())


def test_long_texts_are_joined_in_order(spark):
    v = verses(spark, *((1, k, f"a{k}", None) for k in range(20, 0, -1)), (2, 1, "x", "y"))
    assert rows(verse.full_texts(v)) == [(1, " ".join(f"a{k} " for k in range(1, 21))), (2, "x y")]
    assert rows(catalogue.in_order(v, F.col("misra1_urdu"), "", "t", piece=3), "t") == [("".join(f"a{k}" for k in range(1, 21)),), ("x",)]


def test_measures(spark):
    p = spark.createDataFrame([(1, 1, 2, 3), (1, 2, 1, 3), (2, 2, 1, 3), (3, 1, 2, 4)], "label int, predicted int, second int, third int")
    assert rows(learning.measures(p, "label")) == [(1, 2, 0.5, 0.5, 0.5), (2, 1, 0.5, 1.0, 0.666667), (3, 1, 0.0, 0.0, 0.0)]
    assert rows(learning.accuracy(p, "label")) == [(4, 0.5, 0.75)] and rows(learning.worst(p, "label")) == [(1, 1), (3, 1)]
    assert sum(r.n for r in learning.confusion(p, "label").collect()) == 4


def test_feature_names():
    assert learning.feature_name(0) == "Vocabulary richness" and learning.feature_name(383) == "Emotional tone" and learning.feature_name(37) == "Vocabulary richness" and learning.feature_name(38) == "Syntactic patterns"
    assert learning.feature_name(384) == "Radif (refrain) pattern" and learning.feature_name(390) == "Number of verses" and learning.feature_name(391) == "Feature 391"


def test_forest(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(i, i % 3, [float(i % 3), float(i % 5)]) for i in range(120)], "id long, label long, v array<double>")
    model = learning.train(df, "label", "v", trees=5)
    model.write().overwrite().save(str(tmp_path / "m"))
    got = learning.predict(PipelineModel.load(str(tmp_path / "m")), df, "id", "label", "v")
    assert got.where("label = predicted").count() == 120
    assert learning.importances(model, 1, width=2)[0][0] == "Vocabulary richness"


def test_hashed_terms(spark):
    got = learning.hashed_terms(spark.createDataFrame([(["a", "b"],), (["a"],)], "w array<string>"), "w", 16)
    assert {len(r.embedding_vector) for r in got.collect()} == {16}


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(403)], "id long, label int")
    got = learning.split(df, "id", "label")
    assert {(r.label, r.n) for r in got.where("test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(k, 20) for k in range(4)}
    assert rows(got) == rows(learning.split(df.repartition(7), "id", "label"))


def test_random_text(spark):
    t = spark.createDataFrame([(1, True), (2, None), (3, False)], "id long, is_deleted boolean")
    assert {catalogue.random_text(t, s).first().id for s in range(20)} == {2, 3}


@pytest.mark.parametrize("n", [1, 2])
def test_first_per(spark, n):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, i int")
    assert rows(tables.first_per(df, ["k"], [F.desc("i")], n), "k", "i") == sorted((k, 4 - i) for k in "ab" for i in range(n))
