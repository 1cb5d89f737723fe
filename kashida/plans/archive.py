"""Queries on the archive: counts, pages, search, hashes, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as t
from ..operators import catalogue, ingest, search
from ..sources.files import blocks
from ..sources.tables import Tables, get_or_create, insert_missing, latest
from . import sql as q

SQL: dict[str, str] = {}
GHAZAL = "form = 'ghazal'"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).texts.where("text_urdu IS NOT NULL")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return catalogue.totals(a.poets, a.texts, a.verses, ["ghazal"])


SQL["corpus_stats"] = f"SELECT (SELECT count(*) FROM poets) AS poets, (SELECT count(*) FROM texts WHERE {GHAZAL}) AS texts, (SELECT count(*) FROM verses) AS verses"


def form_filtered_stats(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return catalogue.totals(a.poets, a.texts, a.verses, ["ghazal", "nazm"])


SQL["form_filtered_stats"] = "SELECT (SELECT count(*) FROM poets) AS poets, (SELECT count(*) FROM texts WHERE form IN ('ghazal', 'nazm')) AS texts, (SELECT count(*) FROM verses) AS verses"


def poet_directory_counts(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return catalogue.directory(a.poets, a.texts, "ghazal").orderBy("name", "id")


SQL["poet_directory_counts"] = "SELECT p.id, p.name, p.name_urdu, p.birth_year, p.death_year, count(t.id) AS n FROM poets p LEFT JOIN texts t ON t.poet_id = p.id AND t.form = 'ghazal' GROUP BY ALL ORDER BY p.name, p.id"


def poet_detail_page(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return catalogue.poet_page(a.texts, a.verses, 1, 2)


_PAIR = ", ".join(f"max(CASE WHEN rk = {k} THEN misra{m}_urdu END) AS c{k}_m{m}" for k in (1, 2) for m in (1, 2))
_OPEN = f"{q.VERSES}, o AS (SELECT text_id, {_PAIR} FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY couplet_index NULLS LAST) AS rk FROM v) WHERE rk <= 2 GROUP BY text_id)"
SQL["poet_detail_page"] = f"""WITH {_OPEN}, own AS (SELECT id, title_urdu, title_english FROM texts WHERE poet_id = 1 AND {GHAZAL}), n AS (SELECT count(*) AS total FROM own)
SELECT p.*, o.c1_m1, o.c1_m2, o.c2_m1, o.c2_m2, n.total, CAST(ceil(n.total / 12) AS BIGINT) AS pages, 1 AS previous, CASE WHEN 2 < ceil(n.total / 12) THEN 3 END AS next
FROM (SELECT * FROM own ORDER BY id LIMIT 12 OFFSET 12) p LEFT JOIN o ON o.text_id = p.id, n"""


def first_two_couplets(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.opening(Tables(spark, d).verses)


SQL["first_two_couplets"] = f"WITH {_OPEN} SELECT * FROM o"


def sample_couplet_per_poet(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return catalogue.sample_couplets(a.poets, a.texts, a.verses)


SQL["sample_couplet_per_poet"] = f"""WITH {q.VERSES}, x AS (SELECT t.poet_id, CASE WHEN misra2_urdu <> '' THEN misra1_urdu || chr(10) || misra2_urdu ELSE misra1_urdu END AS c
FROM v JOIN texts t ON t.id = v.text_id AND t.form = 'ghazal' QUALIFY row_number() OVER (PARTITION BY t.poet_id ORDER BY text_id, couplet_index, misra1_urdu, misra2_urdu) = 1)
SELECT p.id, p.name, coalesce(x.c, '{fixed.NO_COUPLET}') AS couplet FROM poets p LEFT JOIN x ON x.poet_id = p.id"""


def navigation_prev_next(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.navigation(Tables(spark, d).texts)


SQL["navigation_prev_next"] = f"SELECT id, poet_id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, count(*) OVER (PARTITION BY poet_id) AS total FROM texts WHERE {GHAZAL} WINDOW w AS (PARTITION BY poet_id ORDER BY id)"


def first_last_flags(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.first_and_last(Tables(spark, d).verses)


SQL["first_last_flags"] = "SELECT DISTINCT text_id, couplet_index, couplet_index = min(couplet_index) OVER (PARTITION BY text_id) AS is_first, couplet_index = max(couplet_index) OVER (PARTITION BY text_id) AS is_last FROM verses"


def recent_items(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return catalogue.recent(a.texts, a.poets, a.verses)


SQL["recent_items"] = f"WITH {q.VERSES} SELECT t.id, t.title_urdu, p.name AS poet_name, t.created_at, v.misra1_urdu, v.misra2_urdu FROM texts t JOIN poets p ON p.id = t.poet_id JOIN v ON v.text_id = t.id AND v.couplet_index = 1 WHERE t.{GHAZAL} ORDER BY t.created_at DESC NULLS LAST, t.id DESC LIMIT 10"


def books_by_poet(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return a.books.where("poet_id IS NOT NULL").select("id", "poet_id", "name", "name_urdu").orderBy("poet_id", F.col("name").asc_nulls_last(), "id")


SQL["books_by_poet"] = "SELECT id, poet_id, name, name_urdu FROM books WHERE poet_id IS NOT NULL ORDER BY poet_id, name NULLS LAST, id"


def keyword_search_page(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return search.search(a.texts, a.poets, a.verses, keyword="dil", offset=20)


_HIT = "(t.title_urdu ILIKE '%dil%' OR t.title_english ILIKE '%dil%' OR t.title_urdu ILIKE '%دل%' OR EXISTS (SELECT 1 FROM verses x WHERE x.text_id = t.id AND (x.misra1_urdu ILIKE '%dil%' OR x.misra2_urdu ILIKE '%dil%' OR x.misra1_urdu ILIKE '%دل%' OR x.misra2_urdu ILIKE '%دل%')))"
SQL["keyword_search_page"] = f"""WITH {q.VERSES} SELECT t.id AS text_id, t.title_urdu, t.title_english, p.name AS poet_name, CASE WHEN v.misra2_urdu <> '' THEN v.misra1_urdu || chr(10) || v.misra2_urdu ELSE v.misra1_urdu END AS first_verse
FROM texts t JOIN poets p ON p.id = t.poet_id LEFT JOIN v ON v.text_id = t.id AND v.couplet_index = 1 WHERE t.{GHAZAL} AND {_HIT} ORDER BY t.id DESC LIMIT 20 OFFSET 20"""


def keyword_search_total(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return search.total(a.texts, a.verses, keyword="dil")


SQL["keyword_search_total"] = f"SELECT count(DISTINCT t.id) AS total FROM texts t WHERE t.{GHAZAL} AND {_HIT}"


def suggest_union(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return search.suggestions(a.texts, a.verses, "dil")


_LIKE_DIL = q.jaccard("g", q.trigrams("'دل'"))
SQL["suggest_union"] = f"""WITH l AS (SELECT DISTINCT misra1_urdu AS s, {q.trigrams('misra1_urdu')} AS g FROM verses WHERE misra1_urdu IS NOT NULL)
SELECT DISTINCT s AS suggestion FROM (SELECT title_urdu AS s FROM texts WHERE title_urdu ILIKE '%دل%' UNION SELECT s FROM l WHERE s ILIKE '%دل%' OR {_LIKE_DIL} > 0.2) ORDER BY 1 LIMIT 10"""


def fuzzy_trigram_suggest(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(Tables(spark, d).verses, "دل میں خواب")


SQL["fuzzy_trigram_suggest"] = f"""WITH l AS (SELECT DISTINCT misra1_urdu AS line FROM verses WHERE misra1_urdu IS NOT NULL), g AS (SELECT line, {q.trigrams('line')} AS g FROM l)
SELECT line, round({q.jaccard('g', q.trigrams("'دل میں خواب'"))}, 6) AS similarity FROM g WHERE round({q.jaccard('g', q.trigrams("'دل میں خواب'"))}, 6) > 0.2"""


def _features(a: Tables) -> DataFrame:
    return latest(a.poetic_features, ["text_id"], ["created_at"])


def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return search.faceted(a.texts, a.poets, _features(a), theme="time", metre="Khafif", limit=1000)


_FACET = "t.id, t.title_urdu, p.name AS poet_name, f.radif, array_to_string(f.qaafiya, ',') AS qaafiya, f.meter_name, f.theme"
SQL["faceted_search"] = f"WITH {q.FEATURES} SELECT {_FACET}, 0.0::DOUBLE AS rank FROM texts t JOIN poets p ON p.id = t.poet_id LEFT JOIN f ON f.text_id = t.id WHERE f.theme = 'time' AND f.meter_name = 'Khafif' ORDER BY t.id LIMIT 1000"


def ranked_fulltext(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return search.faceted(a.texts, a.poets, _features(a), keyword="دل خواب")


SQL["ranked_fulltext"] = f"""WITH {q.FEATURES}, b AS (SELECT *, {q.words('lower(text_urdu)')} AS w FROM texts)
SELECT {_FACET}, round(len([x for x in t.w if x IN ('دل', 'خواب')]) / (1 + ln(len(t.w))), 6) AS rank FROM b t JOIN poets p ON p.id = t.poet_id LEFT JOIN f ON f.text_id = t.id
WHERE list_contains(t.w, 'دل') AND list_contains(t.w, 'خواب') ORDER BY rank DESC, t.id LIMIT 50"""


def transliterate_query(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).documents
    return rows.select("doc_id", t.to_urdu(F.col("text")).alias("urdu"), t.to_urdu(F.col("text"), fold_keys=False).alias("urdu_plain_keys"))


def _roman(x: str) -> str:
    s = f"regexp_replace({q.strip(f'lower({x})')}, '[^a-z{q.BLANK}]', '', 'g')"
    return f"regexp_replace(replace(replace(replace({s}, 'aa', 'a'), 'ee', 'i'), 'oo', 'u'), '[{q.BLANK}]+', ' ', 'g')"


def _urdu(table: dict[str, str]) -> str:
    return f"array_to_string([coalesce({q.lookup(_roman('w'), table)}, w) for w in {q.words('text')}], ' ')"


SQL["transliterate_query"] = f"SELECT doc_id, {_urdu({t._fold_key(k): v for k, v in fixed.ROMAN.items()})} AS urdu, {_urdu(fixed.ROMAN)} AS urdu_plain_keys FROM documents"


def letter_transliteration(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).poets.select("id", t.letters_to_urdu(F.col("name")).alias("by_length"), t.letters_to_urdu(F.col("name"), longest_first=False).alias("in_order"))


def _replaced(x: str, keys: list[str], table: dict[str, str]) -> str:
    for k in keys:
        x = f"replace({x}, '{k}', '{table[k]}')"
    return x


SQL["letter_transliteration"] = f"SELECT id, {_replaced('lower(name)', sorted(fixed.LATIN_LETTERS, key=len, reverse=True), fixed.LATIN_LETTERS)} AS by_length, {_replaced(q.squeeze('lower(name)'), list(fixed.LATIN_IN_ORDER), fixed.LATIN_IN_ORDER)} AS in_order FROM poets"


def normalize_text_variants(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text_urdu")
    return _texts(spark, d).select("id", t.letters(c).alias("letters"), t.bulk_form(c).alias("bulk"), t.squeeze(c).alias("squeezed"), t.text_form(c).alias("form"), t.line_form(c).alias("line"))


SQL["normalize_text_variants"] = f"SELECT id, {q.letters('text_urdu')} AS letters, {q.bulk_form('text_urdu')} AS bulk, {q.squeeze('text_urdu')} AS squeezed, {q.text_form('text_urdu')} AS form, translate({q.strip('text_urdu')}, '،۔!?', '') AS line FROM texts WHERE text_urdu IS NOT NULL"


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.text_hashes(Tables(spark, d).texts)


_COUPLET = q.first_couplet("text_urdu")
SQL["content_hashes"] = f"SELECT id, md5({q.bulk_form('text_urdu')}) AS content_md5, md5({q.bulk_form(_COUPLET)}) AS couplet_md5, sha256(text_urdu) AS raw_sha256, sha256({q.text_form('text_urdu')}) AS form_sha256, md5({q.letters('lower(text_urdu)')}) AS letters_md5, md5({_COUPLET}) AS opening_md5 FROM texts WHERE text_urdu IS NOT NULL"


def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ingest.copies(Tables(spark, d).texts)


SQL["exact_dedupe"] = f"WITH h AS (SELECT id, md5({q.bulk_form('text_urdu')}) AS h FROM texts WHERE text_urdu IS NOT NULL), g AS (SELECT h, min(id) AS first_id, count(*) AS n FROM h GROUP BY h HAVING count(*) > 1) SELECT id, first_id, n FROM h JOIN g USING (h)"


def bulk_dup_flags(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    items = latest(a.bulk_preview.where("full_text IS NOT NULL").select("item_id", "full_text", "arrived_at"), ["item_id"], ["arrived_at"])
    return ingest.flagged(ingest.hashed(items, "full_text"), a.texts, "item_id").select("item_id", "dup_content", "dup_couplet", "dup_in_batch")


SQL["bulk_dup_flags"] = f"""WITH i AS (SELECT item_id, full_text FROM bulk_preview WHERE full_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY arrived_at DESC, full_text DESC) = 1),
h AS (SELECT item_id, md5({q.bulk_form('full_text')}) AS c, md5({q.bulk_form(q.first_couplet('full_text'))}) AS k FROM i)
SELECT item_id, c IN (SELECT content_hash FROM texts WHERE content_hash IS NOT NULL) AS dup_content, k IN (SELECT first_couplet_hash FROM texts WHERE first_couplet_hash IS NOT NULL) AS dup_couplet, item_id > min(item_id) OVER (PARTITION BY c) AS dup_in_batch FROM h"""


def bulk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken as uploads: a separator where a page has one, else blank lines."""
    rows = Tables(spark, d).documents
    return rows.select("doc_id", F.posexplode(blocks(F.col("text"), blank_lines=True)).alias("block", "text")).select("doc_id", F.col("block").cast("long").alias("block"), F.length("text").cast("long").alias("chars"), F.size(t.lines(F.col("text"))).cast("long").alias("lines"), F.md5("text").alias("hash"))


_PARTS = f"[b for b in [{q.strip('p')} for p in string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\s*\\n')] if b <> '']"
SQL["bulk_blocks"] = f"WITH b AS (SELECT doc_id, {_PARTS} AS bs FROM documents), x AS (SELECT doc_id, unnest(range(len(bs))) AS block, unnest(bs) AS text FROM b) SELECT doc_id, block, length(text) AS chars, len({q.lines('text')}) AS lines, md5(text) AS hash FROM x"


def couplet_parsing(spark: SparkSession, d: str) -> DataFrame:
    """All ways of pairing a text's lines: odd tails kept or dropped, and as typed in by blocks."""
    rows = _texts(spark, d).select("id", t.lines(F.col("text_urdu")).alias("l"))  # a column: inside a lambda it would be split anew for every line
    both = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["couplet_index"].cast("string"), F.lit(":"), x["m1"], F.lit("|"), x["m2"])), "\n")
    return rows.select("id", both(t.couplets(F.col("l"))).alias("kept"), both(t.couplets(F.col("l"), keep_odd=False)).alias("dropped"), F.array_join(F.slice("l", 1, 2), " ").alias("first_couplet"))


_KEPT = "array_to_string([CAST(i AS VARCHAR) || ':' || l[2 * i - 1] || '|' || coalesce(l[2 * i], '') for i in range(1, (len(l) + {0}) // 2 + 1)], chr(10))"
SQL["couplet_parsing"] = f"WITH x AS (SELECT id, {q.lines('text_urdu')} AS l FROM texts WHERE text_urdu IS NOT NULL) SELECT id, {_KEPT.format(1)} AS kept, {_KEPT.format(0)} AS dropped, array_to_string(l[1:2], ' ') AS first_couplet FROM x"


def slugify_names(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).poets.select("id", t.slug(F.col("name")).alias("slug_of_name"))


SQL["slugify_names"] = f"SELECT id, regexp_replace(regexp_replace({q.strip('lower(name)')}, '[^a-z0-9{q.BLANK}-]', '', 'g'), '[{q.BLANK}-]+', '-', 'g') AS slug_of_name FROM poets"


def detect_language_script(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return Tables(spark, d).documents.select("doc_id", t.language(c).alias("language"), t.mostly_urdu(c).alias("mostly_urdu"), F.round(t.arabic_share(c), 6).alias("share"))


def _n(cls: str) -> str:
    return f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"


_SHARE = f"CASE WHEN length(text) > 0 THEN {_n(q.ARABIC)} / length(text) ELSE 0.0 END"
SQL["detect_language_script"] = f"SELECT doc_id, CASE WHEN {_n('\\p{L}')} = 0 THEN 'unknown' WHEN {_n(q.ARABIC)} / {_n('\\p{L}')} > 0.3 THEN 'urdu' WHEN {_n('a-zA-Z')} / {_n('\\p{L}')} > 0.5 THEN 'roman' ELSE 'mixed' END AS language, {_SHARE} > 0.3 AS mostly_urdu, round({_SHARE}, 6) AS share FROM documents"


def dictionary_translate(spark: SparkSession, d: str) -> DataFrame:
    c = t.translate_words(F.col("misra1_urdu"))
    return catalogue.distinct_verses(Tables(spark, d).verses).select("text_id", "couplet_index", c.alias("english"), t.tidy_english(c).alias("tidy"))


_WORDWISE = f"array_to_string([coalesce({q.lookup('w', fixed.URDU_ENGLISH)}, w) for w in {q.words('m')}], ' ')"
SQL["dictionary_translate"] = f"""WITH {q.VERSES}, s AS (SELECT text_id, couplet_index, {q.squeeze('misra1_urdu')} AS m FROM v), e AS (SELECT text_id, couplet_index, coalesce({q.lookup('m', fixed.PHRASES)}, {_WORDWISE}) AS english FROM s),
x AS (SELECT *, replace(replace(replace({q.strip('english')}, ' is of', ''), ' of is', ''), '  ', ' ') AS y FROM e) SELECT text_id, couplet_index, english, CASE WHEN length(y) > 1 THEN upper(y[1]) || y[2:] ELSE y END AS tidy FROM x"""


def share_text_render(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return catalogue.share_texts(a.texts, a.poets, a.verses, giver="A", receiver="B")


SQL["share_text_render"] = f"""WITH {q.VERSES}, b AS (SELECT text_id, string_agg(misra1_urdu || chr(10) || misra2_urdu || chr(10) || chr(10), '' ORDER BY couplet_index) AS body FROM v GROUP BY text_id)
SELECT t.id AS text_id, upper(coalesce(p.name, '')) || chr(10) || repeat('-', length(upper(coalesce(p.name, '')))) || chr(10) || chr(10) || 'From: A' || chr(10) || 'To: B' || chr(10) || chr(10) || coalesce(b.body, '') AS share FROM texts t JOIN poets p ON p.id = t.poet_id LEFT JOIN b ON b.text_id = t.id"""


def top_words_by_poet(spark: SparkSession, d: str) -> DataFrame:
    return search.top_words(_texts(spark, d).where("poet_id IS NOT NULL").select("poet_id", "text_urdu"), ["poet_id"], 20)


_COUNT = f"c AS (SELECT poet_id, w AS word, count(*) AS n FROM (SELECT poet_id, unnest({q.tokens('text_urdu')}) AS w FROM texts WHERE text_urdu IS NOT NULL AND poet_id IS NOT NULL) GROUP BY ALL)"
SQL["top_words_by_poet"] = f"WITH {_COUNT}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY poet_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM c) SELECT poet_id, word, n, rank, CAST(round(n / max(n) OVER (PARTITION BY poet_id) * 100) AS BIGINT) AS share FROM r WHERE rank <= 20"


def compare_poets(spark: SparkSession, d: str) -> DataFrame:
    """Words, refrains and emotions of two poets side by side."""
    from ..functions.verse import emotions

    a = Tables(spark, d)
    own = _texts(spark, d).where("poet_id IN (1, 2)")
    w = search.top_words(own.select("poet_id", "text_urdu"), ["poet_id"], 10).select("poet_id", F.lit("word").alias("what"), F.col("word").alias("value"), "n")
    f = _features(a).where("radif IS NOT NULL").join(a.texts.where("poet_id IN (1, 2)").select(F.col("id").alias("text_id"), "poet_id"), "text_id").groupBy("poet_id", "radif").agg(F.count("*").alias("n"))
    r = search.ranked(f, ["poet_id"], "radif", 5).select("poet_id", F.lit("radif").alias("what"), F.col("radif").alias("value"), "n")
    e = own.groupBy("poet_id").agg(*(F.count_if(c).alias(k) for k, c in emotions(F.col("text_urdu")).items())).unpivot("poet_id", list(fixed.EMOTIONS), "value", "n").select("poet_id", F.lit("emotion").alias("what"), "value", "n")
    return w.unionByName(r).unionByName(e)


SQL["compare_poets"] = f"""WITH {q.FEATURES}, {_COUNT}, w AS (SELECT poet_id, 'word' AS what, word AS value, n FROM c WHERE poet_id IN (1, 2) QUALIFY row_number() OVER (PARTITION BY poet_id ORDER BY n DESC, word) <= 10),
g AS (SELECT t.poet_id, f.radif, count(*) AS n FROM f JOIN texts t ON t.id = f.text_id WHERE f.radif IS NOT NULL AND t.poet_id IN (1, 2) GROUP BY ALL), r AS (SELECT poet_id, 'radif' AS what, radif AS value, n FROM g QUALIFY row_number() OVER (PARTITION BY poet_id ORDER BY n DESC, radif) <= 5)
SELECT * FROM w UNION ALL SELECT * FROM r """ + " ".join(f"UNION ALL SELECT poet_id, 'emotion', '{k}', count(*) FILTER ({q.any_of('text_urdu', keys)}) FROM texts WHERE text_urdu IS NOT NULL AND poet_id IN (1, 2) GROUP BY poet_id" for k, keys in fixed.EMOTIONS.items())


def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return _features(Tables(spark, d)).select("text_id", "radif", F.array_join("qaafiya", ",").alias("qaafiya"), "theme", "meter_name", "created_at")


SQL["upsert_latest_wins"] = f"WITH {q.FEATURES} SELECT text_id, radif, array_to_string(qaafiya, ',') AS qaafiya, theme, meter_name, created_at FROM f"


def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of typists, and of others where they are not yet there, each (text, contributor) once."""
    c = Tables(spark, d).contributions
    old = c.where("role = 'typist'").select("text_id", "contributor_id").distinct()
    return insert_missing(old, c.select("text_id", "contributor_id"), ["text_id", "contributor_id"])


SQL["insert_or_ignore"] = "SELECT DISTINCT text_id, contributor_id FROM contributions"


def get_or_create_contributors(spark: SparkSession, d: str) -> DataFrame:
    """Every (name, email) with one id: those of the first 20 ids are known, the others are numbered after them."""
    a = Tables(spark, d).contributors
    known = a.where("id <= 20").select("id", "name", "email")
    table, facts = get_or_create(known, a.where("id > 20").select("name", "email"), ["name", "email"])
    return facts.groupBy("name", "email").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


SQL["get_or_create_contributors"] = "SELECT name, email, count(*) AS n, CAST(1 AS BIGINT) AS ids FROM contributors WHERE id > 20 GROUP BY ALL"


def random_item(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.random_text(Tables(spark, d).texts, 7)


def event_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, as the stream would count them."""
    from ..streaming.ingest import activity

    return activity(Tables(spark, d).events, "1 day")


SQL["event_activity"] = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
