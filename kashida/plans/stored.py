"""Queries that write through a store and read back, and those on what the other modules leave open."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from ..functions.vectors import cosine_exact
from ..lineage import cut, shared
from ..operators import catalogue, ingest, keeping, learning, likeness, search, verse
from ..sources import files
from ..sources.store import Store
from ..sources.tables import Tables, first_per, latest, lookup
from . import archive, poetry
from . import sql as q

SQL: dict[str, str] = {}


def _store(spark: SparkSession, d: str, *names: str) -> Store:
    """A new store with some tables of a folder."""
    store = Store(spark, shared(spark, f"store-{uuid.uuid4().hex}"))
    store.commit(replace={n: getattr(Tables(spark, d), n) for n in names})
    return store


def _analysed(spark: SparkSession, d: str, again: bool) -> Store:
    store = _store(spark, d, "texts", "verses", "poets")
    keeping.analyse(store, again)
    return store


def _stored_features(store: Store) -> DataFrame:
    return store.read("poetic_features").where("created_at IS NOT NULL").drop("created_at").withColumn("qaafiya", F.array_join("qaafiya", ","))


def stored_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The features of all texts that weren't analysed yet, written and read back."""
    return _stored_features(_analysed(spark, d, False))


_STORED = f"SELECT a.text_id, radif, radif_confidence, qaafiya, qaafiya_pattern, theme, maqta_detected, meter_name, meter_pattern, meter_confidence FROM ({poetry.SQL['text_analysis']}) a JOIN texts t ON t.id = a.text_id WHERE coalesce(t.nlp_processed, false) = "
SQL["stored_analysis"] = _STORED + "false"


def stored_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The features of all texts that were marked as analysed, computed again."""
    return _stored_features(_analysed(spark, d, True))


SQL["stored_backfill"] = _STORED + "true"


def stored_flags(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their marks, and their flagged couplets, after the analysis of those that weren't analysed yet."""
    store = _analysed(spark, d, False)
    v = store.read("verses").groupBy(F.col("text_id").alias("id")).agg(*(F.count_if(c).alias(c) for c in ("is_matla", "is_maqta")))
    return store.read("texts").select("id", "nlp_processed", "nlp_version").join(v, "id", "left")


SQL["stored_flags"] = f"""WITH a AS ({poetry.SQL['text_analysis']}), n AS (SELECT a.* FROM a JOIN texts t ON t.id = a.text_id WHERE NOT coalesce(t.nlp_processed, false)), x AS (SELECT *, min(couplet_index) OVER w AS lo, max(couplet_index) OVER w AS hi FROM verses WINDOW w AS (PARTITION BY text_id)),
y AS (SELECT x.text_id, coalesce(n.matla AND couplet_index = lo, x.is_matla) AS m, coalesce(n.maqta_detected AND couplet_index = hi, x.is_maqta) AS k FROM x LEFT JOIN n USING (text_id)), c AS (SELECT text_id AS id, count(*) FILTER (m) AS is_matla, count(*) FILTER (k) AS is_maqta FROM y GROUP BY text_id)
SELECT t.id, CASE WHEN NOT coalesce(t.nlp_processed, false) THEN true ELSE t.nlp_processed END AS nlp_processed, CASE WHEN n.text_id IS NOT NULL THEN 2 ELSE t.nlp_version END AS nlp_version, c.is_matla, c.is_maqta FROM texts t LEFT JOIN n ON n.text_id = t.id LEFT JOIN c ON c.id = t.id"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).bulk_preview.where("full_text IS NOT NULL")
    return latest(rows.select("item_id", "full_text", "poet_id", "contributor_id", "arrived_at"), ["item_id"], ["arrived_at"])


def stored_uploads(spark: SparkSession, d: str) -> DataFrame:
    """The texts of accepted uploads with their couplets, appended twice: the second time nothing is new."""
    store = _store(spark, d, "texts", "verses")
    for _ in range(2):
        keeping.accept(store, _items(spark, d), "full_text", "item_id")
    top = Tables(spark, d).texts.agg(F.max("id").alias("top"))  # one row
    new = store.read("texts").crossJoin(F.broadcast(top)).where("id > top").select((F.col("id") - F.col("top")).alias("place"), "id", "content_hash", "verse_count", "title_urdu")
    n = store.read("verses").groupBy(F.col("text_id").alias("id")).agg(F.count("*").alias("couplets"))
    return new.join(n, "id", "left").drop("id")


SQL["stored_uploads"] = f"""WITH f AS ({archive.SQL['bulk_dup_flags']}), i AS (SELECT item_id, full_text FROM bulk_preview WHERE full_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY arrived_at DESC, full_text DESC) = 1),
l AS (SELECT item_id, full_text, {q.lines('full_text')} AS l FROM i JOIN f USING (item_id) WHERE NOT dup_content AND NOT dup_couplet AND NOT dup_in_batch)
SELECT row_number() OVER (ORDER BY item_id) AS place, md5({q.bulk_form('full_text')}) AS content_hash, CAST((len(l) + 1) // 2 AS INTEGER) AS verse_count, substring(l[1], 1, 100) AS title_urdu, nullif((len(l) + 1) // 2, 0) AS couplets FROM l"""


def stored_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprints of all poets, written twice and read back from JSON."""
    store = _store(spark, d, "texts", "ghazal_embeddings", "poetic_features")
    for _ in range(2):
        keeping.keep_fingerprints(store)
    p = keeping.read_fingerprints(store.read("poet_fingerprints").where("updated_at IS NOT NULL"))
    radifs = F.when(F.size("common_radif") > 0, F.array_join(F.transform("common_radif", lambda x: F.concat(x["radif"], F.lit("="), x["n"].cast("string"))), "|"))
    metres = F.when(F.size("metres") > 0, F.array_join(F.transform(F.array_sort(F.map_entries("metres")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), "|"))
    return p.select("poet_id", radifs.alias("radifs"), metres.alias("metres"), F.size("centroid").cast("long").alias("width"))


SQL["stored_fingerprints"] = poetry.SQL["poet_fingerprints"]


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of half their length written over the stored ones, and their norms read back."""
    store = _store(spark, d, "ghazal_embeddings")
    v = likeness.vectors(Tables(spark, d).ghazal_embeddings)
    keeping.keep_vectors(store, v.select("text_id", F.transform("v", lambda x: x / 2).alias("embedding_vector")))
    return store.read("ghazal_embeddings").join(v.select("text_id"), "text_id", "left_semi").select("text_id", F.round("embedding_norm", 6).alias("norm"), F.size("embedding_vector").cast("long").alias("width"))


SQL["stored_vectors"] = f"WITH {q.VECTORS} SELECT text_id, round(sqrt({q.dot('h', 'h')}), 6) AS norm, CAST(384 AS BIGINT) AS width FROM (SELECT text_id, [(x / 2)::FLOAT::DOUBLE for x in v] AS h FROM e)"


def stored_poets(spark: SparkSession, d: str) -> DataFrame:
    """Books' names taken as new poets: each slug once, under dense ids; and a book for each of them."""
    store = _store(spark, d, "poets", "books")
    names = first_per(Tables(spark, d).books.where("name IS NOT NULL").select("name", "name_urdu", t.slug(F.col("name")).alias("s")).distinct(), ["s"], [F.col("name"), F.col("name_urdu").asc_nulls_last()]).select("name", "name_urdu")
    p = keeping.add_poets(store, names)
    keeping.add_books(store, p.select(F.col("id").alias("poet_id"), "name", "name_urdu"))
    top = Tables(spark, d).poets.agg(F.max("id").alias("top"))  # one row
    kept = store.read("books").groupBy("poet_id").agg(F.count("*").alias("books"))
    return store.read("poets").crossJoin(F.broadcast(top)).where("id > top").join(kept, F.col("id") == F.col("poet_id"), "left").select((F.col("id") - F.col("top")).alias("place"), "slug", "name", "books")


_SLUG = f"regexp_replace(regexp_replace({q.strip('lower(name)')}, '[^a-z0-9{q.BLANK}-]', '', 'g'), '[{q.BLANK}-]+', '-', 'g')"
SQL["stored_poets"] = f"""WITH n AS (SELECT name, name_urdu, {_SLUG} AS slug FROM books WHERE name IS NOT NULL), o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY slug ORDER BY name, name_urdu NULLS LAST) = 1), k AS (SELECT * FROM o WHERE name <> '' AND slug NOT IN (SELECT slug FROM poets WHERE slug IS NOT NULL)),
i AS (SELECT row_number() OVER (ORDER BY slug) AS place, (SELECT max(id) FROM poets) AS top, slug, name FROM k), b AS (SELECT poet_id, count(*) AS c FROM books GROUP BY poet_id) SELECT place, slug, name, 1 + coalesce(b.c, 0) AS books FROM i LEFT JOIN b ON b.poet_id = top + place"""


def stored_metres(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d, "verses")
    keeping.rebuild_metres(store)
    return store.read("meter_patterns")


SQL["stored_metres"] = poetry.SQL["meter_clusters"]


def stored_measures(spark: SparkSession, d: str) -> DataFrame:
    """The measures of predictions, written as JSON for display and read back."""
    names = Tables(spark, d).poets.select(F.col("id").cast("int").alias("label"), "name")
    path = shared(spark, f"measures-{uuid.uuid4().hex}")
    files.write_json(learning.report(poetry._predicted(spark, d), "label", names), path)
    r = files.read_json(spark, path)
    return r.select("n", "top1", "top3", F.explode("per_label").alias("p")).select("n", "top1", "top3", "p.label", "p.name", "p.support", "p.precision", "p.recall", "p.f1")


SQL["stored_measures"] = f"SELECT a.n, a.top1, a.top3, m.label, coalesce(p.name, 'Poet ' || m.label) AS name, m.support, m.precision, m.recall, m.f1 FROM ({poetry.SQL['accuracy']}) a, ({poetry.SQL['eval_metrics']}) m LEFT JOIN poets p ON p.id = m.label"


def stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A forest, saved and loaded; its three best labels for every row, stored with names, and read back from the store the second time."""
    rows = poetry._rows(spark, d).select(F.col("vec_id").alias("text_id"), "label", F.col("v").alias("features"))
    path = shared(spark, f"model-{uuid.uuid4().hex}")
    learning.save(learning.train(rows, "label", "features"), path)
    store = _store(spark, d, "poets")
    for _ in range(2):
        keeping.predicted(store, learning.load(path), rows)
    return store.read("poet_predictions").drop("updated_at")


def spilled_preview(spark: SparkSession, d: str) -> DataFrame:
    """The preview written as JSON lines and read back."""
    return files.spill(Tables(spark, d).bulk_preview.select("item_id", "batch_no", "full_text"), shared(spark, f"preview-{uuid.uuid4().hex}"))


SQL["spilled_preview"] = "SELECT item_id, batch_no, full_text FROM bulk_preview"


def one_text(spark: SparkSession, d: str) -> DataFrame:
    """A text by its key."""
    return lookup(Tables(spark, d).texts, "id", 2).select("id", "public_id", "title_urdu", "text_urdu")


SQL["one_text"] = "SELECT id, public_id, title_urdu, text_urdu FROM texts WHERE id = 2"


def separated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that hold several texts, a separator between them: each text of two lines or more."""
    rows = Tables(spark, d).verses.select(F.col("text_id").alias("upload_id"), F.concat_ws(f"\r\n{fixed.SEPARATOR}\r\n", F.concat_ws("\r\n", "misra1_urdu", "misra2_urdu"), "misra2_urdu", F.concat_ws("\n", "misra2_urdu", "misra1_urdu")).alias("text"))
    return ingest.read_blocks(rows).groupBy("upload_id", "block").agg(F.count("*").alias("n"), F.min("text").alias("least"))


_UP = f"concat_ws(chr(13) || chr(10) || '{fixed.SEPARATOR}' || chr(13) || chr(10), concat_ws(chr(13) || chr(10), misra1_urdu, misra2_urdu), misra2_urdu, concat_ws(chr(10), misra2_urdu, misra1_urdu))"
_BLOCKS = f"[b for b in [{q.strip('p')} for p in string_split(replace(replace({_UP}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{fixed.SEPARATOR}')] if b <> '']"
SQL["separated_blocks"] = f"WITH b AS (SELECT text_id AS upload_id, {_BLOCKS} AS bs FROM verses), x AS (SELECT upload_id, CAST(unnest(range(len(bs))) AS INTEGER) AS block, unnest(bs) AS text FROM b) SELECT upload_id, block, count(*) AS n, min(text) AS least FROM x WHERE len({q.lines('text')}) >= 2 GROUP BY ALL"


def search_of_contributor(spark: SparkSession, d: str) -> DataFrame:
    """A keyword within the texts of one poet and one contributor, and all texts of a contributor."""
    a = Tables(spark, d)
    both = search.matching(a.texts, a.verses, keyword="dil", poet_id=1, contributor_id=1).select(F.lit("keyword, poet, contributor").alias("asked"), "id")
    some = search.matching(a.texts, a.verses, keyword="dil", poet_id=1).select(F.lit("keyword, poet").alias("asked"), "id")
    none = search.search(a.texts, a.poets, a.verses).select(F.lit("nothing").alias("asked"), F.col("text_id").alias("id"))
    return both.unionByName(some).unionByName(search.matching(a.texts, a.verses, contributor_id=1).select(F.lit("contributor").alias("asked"), "id")).unionByName(none)


SQL["search_of_contributor"] = f"""WITH h AS (SELECT t.id, t.poet_id, t.contributor_id FROM texts t WHERE t.{archive.GHAZAL} AND {archive._HIT})
SELECT 'keyword, poet, contributor' AS asked, id FROM h WHERE poet_id = 1 AND contributor_id = 1 UNION ALL SELECT 'keyword, poet', id FROM h WHERE poet_id = 1 UNION ALL SELECT 'contributor', id FROM texts WHERE {archive.GHAZAL} AND contributor_id = 1"""


def faceted_by_rhyme(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the poet with most texts, by a rhyme word, and by a refrain: those that most of its texts have."""
    a = Tables(spark, d)
    f = cut(archive._features(a).join(a.texts.where("poet_id = 1").select(F.col("id").alias("text_id")), "text_id", "left_semi"))
    word = f.select(F.explode("qaafiya").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").first()
    radif = f.where("radif IS NOT NULL AND radif <> ''").groupBy("radif").count().orderBy(F.desc("count"), "radif").first()
    rows = lambda kind, **x: search.faceted(a.texts, a.poets, archive._features(a), poet_id=1, limit=1000, **x).withColumn("asked", F.lit(kind))
    return rows("qaafiya", qaafiya=word[0] if word else "none").unionByName(rows("radif", radif=radif[0] if radif else "none"))


SQL["faceted_by_rhyme"] = f"""WITH {q.FEATURES}, o AS (SELECT f.* FROM f JOIN texts t ON t.id = f.text_id WHERE t.poet_id = 1), w AS (SELECT w FROM (SELECT unnest(qaafiya) AS w FROM o) GROUP BY w ORDER BY count(*) DESC, w LIMIT 1), r AS (SELECT radif FROM o WHERE radif <> '' GROUP BY radif ORDER BY count(*) DESC, radif LIMIT 1)
SELECT {archive._FACET}, 0.0::DOUBLE AS rank, k.asked FROM (SELECT 'qaafiya' AS asked UNION ALL SELECT 'radif') k, texts t JOIN poets p ON p.id = t.poet_id JOIN f ON f.text_id = t.id WHERE t.poet_id = 1 AND CASE k.asked WHEN 'qaafiya' THEN list_contains(f.qaafiya, (SELECT w FROM w)) ELSE f.radif = (SELECT radif FROM r) END"""


def exact_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each text with a vector against the one before it: cosine without epsilon."""
    v = poetry._v(spark, d)
    j = v.join(v.select((F.col("text_id") + 1).alias("text_id"), F.col("v").alias("w")), "text_id")
    return j.select("text_id", F.round(cosine_exact(F.col("v"), F.col("w")), 6).alias("cosine"))


SQL["exact_cosine"] = f"WITH {q.VECTORS} SELECT a.text_id, CASE WHEN {q.dot('a.v', 'a.v')} = 0 OR {q.dot('b.v', 'b.v')} = 0 THEN 0.0 ELSE round({q.dot('a.v', 'b.v')} / (sqrt({q.dot('a.v', 'a.v')}) * sqrt({q.dot('b.v', 'b.v')})), 6) END AS cosine FROM e a JOIN e b ON b.text_id = a.text_id - 1"


def typed_couplets(spark: SparkSession, d: str) -> DataFrame:
    """Couplets of texts as they are typed in: by blocks, or line by line where there is one block."""
    rows = Tables(spark, d).texts.where("text_urdu IS NOT NULL").select("id", t.stanza_couplets(F.col("text_urdu")).alias("c"))
    return rows.select("id", F.array_join(F.transform("c", lambda x: F.concat(x["couplet_index"].cast("string"), F.lit(":"), x["m1"], F.lit("|"), x["m2"])), "\n").alias("couplets"))


_STANZAS = f"[b for b in string_split_regex(text_urdu, '\\n\\s*\\n') if {q.strip('b')} <> '']"
SQL["typed_couplets"] = rf"""WITH b AS (SELECT id, {_STANZAS} AS bs, string_split(text_urdu, chr(10)) AS ls FROM texts WHERE text_urdu IS NOT NULL), s AS (SELECT id, ls, [string_split({q.strip('b')}, chr(10)) for b in bs] AS ss FROM b)
SELECT id, CASE WHEN len(ss) > 1 THEN array_to_string([CAST(i AS VARCHAR) || ':' || ss[i][1] || '|' || coalesce(ss[i][2], '') for i in range(1, len(ss) + 1)], chr(10)) ELSE array_to_string([CAST(i AS VARCHAR) || ':' || ls[2 * i - 1] || '|' || coalesce(ls[2 * i], '') for i in range(1, (len(ls) + 1) // 2 + 1)], chr(10)) END AS couplets FROM s"""


def wide_transliteration(spark: SparkSession, d: str) -> DataFrame:
    """Documents with Latin and English words in Urdu, and the script that they are written in."""
    rows = Tables(spark, d).documents
    return rows.select("doc_id", t.to_urdu_wide(F.col("text")).alias("urdu"), t.is_urdu(F.col("text")).alias("is_urdu"), t.is_roman_urdu(F.col("text")).alias("is_roman"))


_WIDE = {t._fold_key(k): v for k, v in (fixed.ROMAN | fixed.ENGLISH).items()}
_VOWELS = f"replace(replace(replace({q.strip('lower(w)')}, 'aa', 'a'), 'ee', 'i'), 'oo', 'u')"
SQL["wide_transliteration"] = f"""WITH l AS ({archive.SQL['detect_language_script']}) SELECT d.doc_id, array_to_string([CASE WHEN regexp_matches(w, '[{q.ARABIC}]') THEN w ELSE coalesce({q.lookup(_VOWELS, _WIDE)}, w) END for w in {q.words('text')}], ' ') AS urdu, l.language = 'urdu' AS is_urdu, l.language = 'roman' AS is_roman FROM documents d JOIN l USING (doc_id)"""


def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines of each text in one."""
    return verse.full_texts(catalogue.distinct_verses(Tables(spark, d).verses))


SQL["joined_lines"] = f"WITH {q.VERSES} SELECT text_id, string_agg(misra1_urdu || ' ' || misra2_urdu, ' ' ORDER BY couplet_index) AS text FROM v GROUP BY text_id"


def _shown(verses: str = "verses"):  # noqa: ANN202
    return F.array_join(F.transform(verses, lambda x: F.concat(x["m1"], F.lit("|"), x["m2"])), "\n").alias("verses")


def analysis_bundle(spark: SparkSession, d: str) -> DataFrame:
    rows = verse.bundle(Tables(spark, d).texts.where("text_urdu IS NOT NULL").select("id", "text_urdu"), "text_urdu")
    return rows.select("id", _shown(), "verse_count", "radif", "qafia", "meter", "behr", "first_line")


_PAIRS = "[l[2 * i - 1] || '|' || coalesce(l[2 * i], '') for i in range(1, (len(l) + 1) // 2 + 1)]"
_COUNTED = f"array_to_string([CAST(greatest(length(regexp_replace(w, '[^{fixed.VOWELS}]', '', 'g')), 1) AS VARCHAR) for w in ({q.words('m')})[1:3]], '-')"
SQL["analysis_bundle"] = f"""WITH o AS ({poetry.SQL['text_outline']}), x AS (SELECT id, {q.lines('text_urdu')} AS l FROM texts WHERE text_urdu IS NOT NULL), y AS (SELECT id, l, (len(l) + 1) // 2 AS n, list_sum([length(s) for s in l]) AS total, [coalesce(l[2 * i], '') for i in range(1, least((len(l) + 1) // 2, 3) + 1)] AS ms FROM x),
z AS (SELECT *, [p for p in [{_COUNTED} for m in ms if m <> ''] if p <> ''] AS p FROM y)
SELECT z.id, array_to_string({_PAIRS}, chr(10)) AS verses, CAST(n AS INTEGER) AS verse_count, coalesce(o.radif, '') AS radif, coalesce(o.rhymes, '') AS qafia, CASE WHEN coalesce(total, 0) < 120 THEN 'short' WHEN total < 250 THEN 'medium' ELSE 'long' END AS meter,
CASE WHEN n = 0 THEN 'unknown' WHEN len(p) >= 2 AND len(list_distinct(p)) = 1 THEN 'regular_' || p[1] ELSE 'irregular' END AS behr, coalesce(l[1], '') AS first_line FROM z JOIN o USING (id)"""


def processed_bundle(spark: SparkSession, d: str) -> DataFrame:
    rows = verse.processed(Tables(spark, d).texts.where("text_urdu IS NOT NULL").select("id", "text_urdu"), "text_urdu")
    return rows.select("id", _shown(), "radif", "qaafiya", "beher")


_VC = f"length(regexp_replace(m, '[^{fixed.VOWELS} ]', '', 'g'))"
SQL["processed_bundle"] = f"""WITH x AS (SELECT id, [{q.squeeze('r')} for r in {q.lines('text_urdu')}] AS l FROM texts WHERE text_urdu IS NOT NULL), b AS (SELECT id AS text_id, i AS k, coalesce(l[2 * i], '') AS line FROM (SELECT id, l, unnest(range(1, (len(l) + 1) // 2 + 1)) AS i FROM x)), s AS (SELECT * FROM b WHERE line <> ''), {q.REFRAINS},
o AS (SELECT s.text_id, k, {q.words('line')} AS ws, radif FROM s JOIN r USING (text_id)), y AS (SELECT text_id, ws[-2] AS word, count(*) AS n, min(k) AS k FROM o WHERE len(ws) >= 2 AND ws[-1] = radif GROUP BY ALL), z AS (SELECT text_id, word FROM y QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY n DESC, k) = 1),
a AS (SELECT id, list_avg([{_VC} for m in l if m <> '']) AS mean FROM x)
SELECT x.id, array_to_string({_PAIRS}, chr(10)) AS verses, r.radif, z.word AS qaafiya, CASE WHEN mean IS NULL THEN 'unknown' WHEN mean < 5 THEN 'short (khafif)' WHEN mean < 9 THEN 'medium (hazaj)' ELSE 'long (muzari)' END AS beher FROM x LEFT JOIN r ON r.text_id = x.id LEFT JOIN z ON z.text_id = x.id JOIN a ON a.id = x.id"""


def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    """The places of a forest's features that weigh most, and what every place stands for."""
    model = learning.train(poetry._rows(spark, d), "label", "v")
    top = learning.importances(model, 3, 64)
    return spark.createDataFrame([("top", i, n, float(w)) for i, (n, w) in enumerate(top)] + [("place", i, learning.feature_name(i), None) for i in range(392)], "kind string, place int, name string, weight double")


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of hashed words for texts, where no sentence vectors are at hand."""
    rows = Tables(spark, d).texts.where("text_urdu IS NOT NULL").select("id", t.words(F.col("text_urdu")).alias("w"))
    return learning.hashed_terms(rows, "w").select("id", F.size("embedding_vector").alias("width"), F.round(F.aggregate("embedding_vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
