from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kashida.operators import keeping, learning
from kashida.sources.store import ChangedMeanwhile, Store
from kashida.sources.tables import empty
from kashida.streaming import ingest

NOW, LATER = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_versions(spark, store):
    assert store.version() == 0 and store.read("poets").count() == 0
    one = spark.createDataFrame([(1, "a")], "id long, name string")
    store.commit(append={"poets": one, "numbers": spark.range(3)})
    store.commit(append={"poets": one.withColumn("id", F.lit(2))})
    assert rows(store.read("poets"), "id", "name", "slug") == [(1, "a", None), (2, "a", None)] and store.read("numbers").count() == 3
    store.commit(replace={"numbers": store.read("numbers").where("id > 1")})
    assert rows(store.read("numbers")) == [(2,)] and store.read("numbers", 1).count() == 3 and store.read("poets", 1).count() == 1
    store.compact("poets", ["id"])
    assert rows(store.read("poets"), "id") == [(1,), (2,)] and len(store.state()["poets"]) == 1


def test_a_change_is_whole_or_not_at_all(spark, store):
    store.commit(append={"a": spark.range(1), "b": spark.range(1)})
    base = store.version()
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.commit(append={"a": spark.range(5), "b": bad})
    assert store.version() == base and store.read("a").count() == 1
    store.commit(base, append={"a": spark.range(2)})
    with pytest.raises(ChangedMeanwhile):  # a writer that had read the version before
        store.commit(base, append={"a": spark.range(7)})
    assert store.read("a").count() == 3 and not [n for n in os.listdir(f"{store.path}/_log") if n.startswith(".") and not n.endswith(".crc")]


def test_upsert_and_insert(spark, store):
    v = lambda *r: spark.createDataFrame(list(r), "text_id long, embedding_vector array<float>")
    keeping.keep_vectors(store, v((1, [3.0, 4.0]), (2, None)), NOW)
    keeping.keep_vectors(store, v((1, [6.0, 8.0])), LATER)
    keeping.keep_vectors(store, v((1, [0.0, 1.0])), NOW)  # older
    assert rows(store.read("ghazal_embeddings"), "text_id", "embedding_norm") == [(1, 10.0), (2, None)]
    store.insert_missing("contributions", spark.createDataFrame([(1, 2, "x"), (1, 2, "y")], "text_id long, contributor_id long, role string"), ["text_id", "contributor_id"])
    store.insert_missing("contributions", spark.createDataFrame([(1, 2, "z"), (3, 2, "z")], "text_id long, contributor_id long, role string"), ["text_id", "contributor_id"])
    assert rows(store.read("contributions"), "text_id", "contributor_id") == [(1, 2), (3, 2)]


def archive(spark, store):
    texts = [(1, 5, "a", None), (2, 5, "b", True), (3, 9, "c", False), (4, 5, "d", None)]
    verses = [(1, 1, "دل ملیں", "خواب ملیں"), (1, 2, "a", "میر ملیں"), (1, 2, "a", "میر ملیں"), (2, 1, "x ملیں", "y ملیں"), (4, 1, "only", "")]
    store.commit(replace={
        "texts": spark.createDataFrame(texts, "id long, poet_id long, content_hash string, nlp_processed boolean"),
        "verses": spark.createDataFrame(verses, "text_id long, couplet_index int, misra1_urdu string, misra2_urdu string"),
        "poets": spark.createDataFrame([(5, "Mir", "میر", "mir")], "id long, name string, name_urdu string, slug string"),
    })


def test_analysis_is_written_back(spark, store):
    archive(spark, store)
    keeping.analyse(store, now=NOW)
    assert rows(store.read("poetic_features"), "text_id", "radif", "maqta_detected", F.col("created_at").cast("string")) == [(1, "ملیں", True, "2024-01-01 00:00:00")]
    assert rows(store.read("texts"), "id", "nlp_processed", "nlp_version") == [(1, True, 2), (2, True, None), (3, True, None), (4, True, None)]
    flags = rows(store.read("verses"), "text_id", "couplet_index", "is_matla", "is_maqta")
    assert flags == [(1, 1, True, False), (1, 2, False, True), (1, 2, False, True), (2, 1, None, None), (4, 1, None, None)]
    keeping.analyse(store, now=LATER)  # nothing is left to do
    assert rows(store.read("verses"), "text_id", "couplet_index", "is_matla", "is_maqta") == flags
    keeping.analyse(store, again=True, now=LATER)  # all again; the first time of writing stays
    assert rows(store.read("poetic_features"), "text_id", F.col("created_at").cast("string")) == [(1, "2024-01-01 00:00:00"), (2, "2024-02-01 00:00:00")]
    assert rows(store.read("texts").where("id = 2"), "nlp_version") == [(2,)]


def test_analysis_of_nothing(spark, store):
    keeping.analyse(store)
    assert store.read("poetic_features").count() == store.read("texts").count() == 0


def test_uploads_are_appended_once(spark, store):
    archive(spark, store)
    items = spark.createDataFrame([(1, 5, 8, "نیا شعر\nدوسرا مصرع\nتیسرا"), (2, 5, None, "نیا  شعر\nدوسرا مصرع\nتیسرا"), (3, None, None, "اور\nکچھ")], "item_id long, poet_id long, contributor_id long, t string")
    assert rows(keeping.accept(store, items, "t", "item_id", now=NOW), "item_id", "id") == [(1, 5), (3, 6)]
    assert keeping.accept(store, items, "t", "item_id", now=NOW).count() == 0
    assert rows(store.read("texts").where("id > 4"), "id", "verse_count", "is_deleted", "nlp_processed") == [(5, 2, False, False), (6, 1, False, False)]
    assert rows(store.read("verses").where("text_id > 4"), "text_id", "couplet_index", "misra2_urdu") == [(5, 1, "دوسرا مصرع"), (5, 2, ""), (6, 1, "کچھ")]
    assert rows(store.read("contributions")) == [(5, 8, "uploader")]


def test_fingerprints_and_predictions(spark, store):
    archive(spark, store)
    keeping.keep_vectors(store, spark.createDataFrame([(i, [float(i)] * 384) for i in (1, 2)], "text_id long, embedding_vector array<float>"), NOW)
    keeping.analyse(store, again=True)
    keeping.analyse(store)
    keeping.keep_fingerprints(store, NOW)
    got = keeping.read_fingerprints(store.read("poet_fingerprints")).first()
    assert got.poet_id == 5 and got.centroid[:2] == [1.5, 1.5] and [(r.radif, r.n) for r in got.common_radif] == [("ملیں", 2)] and sum(got.metres.values()) == 2
    data = spark.createDataFrame([(i, 5 if i % 2 else 7, [float(i % 2), 0.0]) for i in range(40)], "text_id long, label long, features array<double>")
    model = learning.train(data, "label", "features", trees=5)
    for now in (NOW, LATER):
        out = keeping.predicted(store, model, data.where("text_id < 2"), now)
    assert rows(out, "text_id", "predicted_poet_id", F.get_json_object("top3", "$[0].name"), F.get_json_object("feature_contributions", "$[0].feature"), F.col("updated_at").cast("string")) == [(0, 5, "Mir", "Vocabulary richness", "2024-01-01 00:00:00"), (1, 5, "Mir", "Vocabulary richness", "2024-01-01 00:00:00")]


def test_models_are_loaded_once(spark, tmp_path):
    data = spark.createDataFrame([(i, i % 2, [float(i % 2)]) for i in range(20)], "id long, label long, v array<double>")
    path = str(tmp_path / "m")
    learning.save(learning.train(data, "label", "v", trees=2), path)
    one = learning.load(path)
    assert learning.load(path) is one
    learning.save(learning.train(data, "label", "v", trees=2), path)
    assert learning.load(path) is not one


def test_poets_and_books(spark, store):
    archive(spark, store)
    new = spark.createDataFrame([("Mir!", None, None, 1700, None), ("Wali  Dakni", "ولی", "b", None, None), ("wali dakni", None, None, None, None), (None, "x", None, None, None), ("", None, None, None, None)], "name string, name_urdu string, bio_english string, birth_year int, death_year int")
    assert rows(keeping.add_poets(store, new), "id", "slug") == [(6, "wali-dakni")] and keeping.add_poets(store, new).count() == 0
    books = spark.createDataFrame([(5, "B", None), (None, "C", None), (5, None, None), (6, "A", "ا")], "poet_id long, name string, name_urdu string")
    assert rows(keeping.add_books(store, books), "id", "poet_id", "name") == [(1, 5, "B"), (2, 6, "A")]


def test_streams_go_into_the_store(spark, store, tmp_path):
    archive(spark, store)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("دل ملیں\nخواب ملیں\n###GHZ###\nدل  ملیں\nخواب ملیں")
    for at in ("c", "d"):  # the second stream sees the same files, and a store that has their texts
        q = ingest.into_store(ingest.fresh_blocks(ingest.uploads(spark, str(tmp_path / "in"))), store).option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start()
        q.awaitTermination(180)
    assert store.read("texts").where("id > 4").count() == 1 and rows(store.read("texts").where("id = 5"), "nlp_processed") == [(True,)]


def test_schemas(spark):
    for name in ("poet_fingerprints", "poet_predictions", "meter_patterns", "texts"):
        assert empty(spark, name).count() == 0
