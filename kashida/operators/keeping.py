"""Writing results back: accepted uploads, analyses with their flags, vectors, fingerprints, predictions, poets and books.

Every operation reads one version of a store and writes one change, which holds all tables it touches. Repeated, it changes nothing but
the times of writing. `now` is the time that is written; by default that of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..functions.vectors import norm
from ..lineage import cut
from ..sources.store import Store, shaped
from ..sources.tables import latest, number
from . import ingest, learning, likeness, verse
from .catalogue import distinct_verses, first_and_last

#: The version of the analysis that is noted with a text.
ANALYSIS = 2


def _now(now: Column | str | None) -> Column:
    return (F.current_timestamp() if now is None else F.lit(now)).cast("timestamp_ntz")


def accept(store: Store, items: DataFrame, text: str, key: str, form: str = "ghazal", now: Column | str | None = None) -> DataFrame:
    """The items (key, poet_id, contributor_id, text) that are new, with the ids of their texts; texts, verses and contributions are
    appended in one change. An item is new if no stored text and no earlier item has its content or its first couplet."""
    base = store.version()
    texts = store.read("texts", base)
    items = cut(ingest.accept(ingest.hashed(items, text), texts, key))
    rows, v = ingest.new_rows(items, texts, text, key, form)
    rows = cut(rows)
    given = rows.where("contributor_id IS NOT NULL").select(F.col("id").alias("text_id"), "contributor_id", F.lit("uploader").alias("role"))
    parts = {"texts": rows.withColumn("created_at", _now(now)).withColumn("is_deleted", F.lit(False)), "verses": v, "contributions": given}
    store.commit(base, append=parts)
    return items.join(rows.select("id", "content_hash"), F.col("content_md5") == F.col("content_hash")).drop("content_hash")


def analyse(store: Store, again: bool = False, now: Column | str | None = None) -> int:
    """Analyses all texts that aren't yet, or again those that are: features are written over those of the same texts, opening and closing
    couplets are flagged, and the texts are marked. Texts without second lines are marked only. Gives the store's version."""
    base = store.version()
    texts, verses, poets = (store.read(n, base) for n in ("texts", "verses", "poets"))
    done = F.coalesce("nlp_processed", F.lit(False))
    todo = cut(texts.where(done if again else ~done).select("id", "poet_id"))
    own = distinct_verses(verses.join(todo.select(F.col("id").alias("text_id")), "text_id", "left_semi"))
    found = cut(verse.analysis(todo, poets, own))
    features = store.read("poetic_features", base)
    old = features.select("text_id", F.col("created_at").alias("first")).groupBy("text_id").agg(F.min("first").alias("first"))
    fresh = shaped(found.join(old, "text_id", "left").withColumn("created_at", F.coalesce("first", _now(now))), "poetic_features")
    kept = features.join(found.select("text_id"), "text_id", "left_anti")
    # one row per text, of the couplets only their ends
    ends = first_and_last(verses).join(found.select("text_id", "matla", "maqta_detected"), "text_id")
    flags = ends.select("text_id", "couplet_index", (F.col("is_first") & F.col("matla")).alias("_matla"), (F.col("is_last") & F.col("maqta_detected")).alias("_maqta"))
    flagged = verses.join(flags, ["text_id", "couplet_index"], "left").withColumns({"is_matla": F.coalesce("_matla", "is_matla"), "is_maqta": F.coalesce("_maqta", "is_maqta")})
    marks = todo.select("id", F.lit(True).alias("_todo")).join(found.select(F.col("text_id").alias("id"), F.lit(ANALYSIS).alias("_version")), "id", "left")
    marked = texts.join(marks, "id", "left").withColumns({"nlp_processed": F.coalesce("_todo", "nlp_processed"), "nlp_version": F.coalesce("_version", "nlp_version")})
    return store.commit(base, replace={"poetic_features": kept.unionByName(fresh), "verses": flagged, "texts": marked})


def keep_vectors(store: Store, vectors: DataFrame, now: Column | str | None = None) -> int:
    """Writes vectors (text_id, embedding_vector) over those of the same texts, with their norms and the time."""
    rows = vectors.select("text_id", "embedding_vector", norm(F.col("embedding_vector")).alias("embedding_norm"), _now(now).alias("updated_at"))
    return store.upsert("ghazal_embeddings", rows, ["text_id"], ["updated_at"])


def fingerprint_rows(prints: DataFrame, now: Column | str | None = None) -> DataFrame:
    """Fingerprints as they are stored: the styles as JSON."""
    style = F.to_json(F.struct(F.coalesce("common_radif", F.array().cast("array<struct<radif:string,n:bigint>>")).alias("common_radif"), F.coalesce("metres", F.create_map().cast("map<string,bigint>")).alias("meter_distribution")))
    return prints.select("poet_id", F.col("centroid").alias("avg_embedding"), style.alias("stylistic_features"), _now(now).alias("updated_at"))


def read_fingerprints(rows: DataFrame) -> DataFrame:
    """(poet_id, centroid, common_radif, metres) of stored fingerprints."""
    of = F.from_json("stylistic_features", "common_radif ARRAY<STRUCT<radif: STRING, n: BIGINT>>, meter_distribution MAP<STRING, BIGINT>")
    return rows.select("poet_id", F.col("avg_embedding").alias("centroid"), of["common_radif"].alias("common_radif"), of["meter_distribution"].alias("metres"))


def keep_fingerprints(store: Store, now: Column | str | None = None) -> int:
    """Computes all poets' fingerprints from the store and writes them over older ones."""
    base = store.version()
    prints = likeness.fingerprints(likeness.vectors(store.read("ghazal_embeddings", base)), store.read("texts", base), latest(store.read("poetic_features", base), ["text_id"], ["created_at"]))
    return store.commit(base, replace={"poet_fingerprints": store.upserted("poet_fingerprints", fingerprint_rows(prints, now), ["poet_id"], ["updated_at"])})


def keep_predictions(store: Store, predictions: DataFrame, now: Column | str | None = None) -> int:
    """Writes predictions (as of learning.top_three, with text_id) over those of the same texts."""
    return store.upsert("poet_predictions", predictions.withColumn("updated_at", _now(now)), ["text_id"], ["updated_at"])


def predicted(store: Store, model, rows: DataFrame, now: Column | str | None = None) -> DataFrame:  # noqa: ANN001
    """The stored predictions of rows (text_id, features), those that were missing being computed and stored first."""
    new = learning.missing(rows.select(F.col("text_id").alias("id")), store.read("poet_predictions"))
    fresh = cut(learning.top_three(model, rows.join(new, "text_id", "left_semi"), "text_id", "features", store.read("poets")))
    if not fresh.isEmpty():
        keep_predictions(store, fresh, now)
    return store.read("poet_predictions").join(rows.select("text_id"), "text_id", "left_semi")


def add_poets(store: Store, poets: DataFrame) -> DataFrame:
    """Appends poets (name, name_urdu, bio_english, birth_year, death_year) under new ids, with slugs of their names; rows without a name,
    and those whose slug a poet or an earlier row has, are left out. Gives the rows that were stored."""
    base = store.version()
    old = store.read("poets", base)
    rows = poets.where(F.coalesce("name", F.lit("")) != "").withColumn("slug", slug(F.col("name"))).dropDuplicates(["slug"]).join(old.select("slug").distinct(), "slug", "left_anti")
    start = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = cut(shaped(number(rows, start, ["slug"]), "poets"))
    store.commit(base, append={"poets": fresh})
    return fresh


def add_books(store: Store, books: DataFrame) -> DataFrame:
    """Appends books (poet_id, name, name_urdu) under new ids; rows without poet or name are left out. Gives the rows that were stored."""
    base = store.version()
    old = store.read("books", base)
    start = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = cut(shaped(number(books.where("poet_id IS NOT NULL AND coalesce(name, '') <> ''"), start, ["poet_id", "name", "name_urdu"]), "books"))
    store.commit(base, append={"books": fresh})
    return fresh


def rebuild_metres(store: Store) -> int:
    """Mines the metre patterns of all verses anew, in place of the stored ones."""
    base = store.version()
    return store.commit(base, replace={"meter_patterns": verse.metre_mining(distinct_verses(store.read("verses", base)))})
