"""Queries on verse, similarity and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import verse as fv
from ..functions.vectors import rounded
from ..lineage import cut
from ..operators import catalogue, learning, likeness, verse
from ..sources.tables import Tables, latest
from . import sql as q

SQL: dict[str, str] = {}


def _verses(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.distinct_verses(Tables(spark, d).verses)


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The latest features of each text. Equal versions are compared as in the SQL, lists of rhyme words by their joined words."""
    joined = F.when((F.size("qaafiya") == 0) | F.exists("qaafiya", F.isnotnull), F.array_join("qaafiya", ","))
    order = ["created_at", "radif", "radif_confidence", "_joined", "qaafiya_pattern", "theme", "maqta_detected", "meter_name", "meter_pattern", "meter_confidence"]
    return latest(Tables(spark, d).poetic_features.withColumn("_joined", joined), ["text_id"], order).drop("_joined")


def radif_by_text(spark: SparkSession, d: str) -> DataFrame:
    return verse.refrains(verse.seconds(_verses(spark, d)))


_R = f"WITH {q.VERSES}, {q.SECONDS}, {q.REFRAINS}"
SQL["radif_by_text"] = f"{_R} SELECT * FROM r"


def radif_variants(spark: SparkSession, d: str) -> DataFrame:
    """The refrain as the first repeated last word, and of several words."""
    s = verse.seconds(_verses(spark, d))
    return verse.refrains_repeated(s).join(verse.refrains_of_words(s).withColumnRenamed("radif", "long_radif"), "text_id")


SQL["radif_variants"] = f"""{_R}, rep AS (SELECT text_id, CASE WHEN max(n) >= 2 THEN arg_min(word, first_k) FILTER (n >= 2) END AS radif FROM c GROUP BY text_id HAVING sum(n) >= 2),
g AS (SELECT text_id, k, {q.words('line')} AS w FROM s), e AS (SELECT text_id, k, array_to_string(w[len(w) - i + 1:], ' ') AS radif FROM (SELECT *, unnest(range(1, least(len(w), 4) + 1)) AS i FROM g)),
m AS (SELECT text_id, radif, count(*) AS n, min(k) AS at_k FROM e GROUP BY ALL), x AS (SELECT text_id, radif AS long_radif, n FROM m QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY n DESC, length(radif) DESC, at_k) = 1)
SELECT rep.text_id, rep.radif, x.long_radif, x.n FROM rep JOIN x USING (text_id)"""


def top_radif(spark: SparkSession, d: str) -> DataFrame:
    return verse.frequencies(_features(spark, d), 20)


SQL["top_radif"] = rf"""WITH {q.FEATURES}, c AS (SELECT regexp_replace(radif, '^\s+|\s+$', '', 'g') AS radif, count(*) AS n FROM f WHERE radif IS NOT NULL AND radif <> '' GROUP BY 1 ORDER BY n DESC, radif LIMIT 20)
SELECT radif, n, CAST(row_number() OVER (ORDER BY n DESC, radif) AS INTEGER) AS rank, CAST(round(n / max(n) OVER () * 100) AS BIGINT) AS share FROM c"""


def qaafiya_by_text(spark: SparkSession, d: str) -> DataFrame:
    s = verse.seconds(_verses(spark, d))
    r = verse.refrains(s)
    return verse.rhymes(s, r).join(verse.rhyme_single(s, r).withColumnRenamed("qaafiya", "single"), "text_id", "left").select("text_id", F.array_join("qaafiya", ",").alias("qaafiya"), "qaafiya_pattern", "single")


SQL["qaafiya_by_text"] = f"""{_R}, b AS (SELECT s.text_id, ({q.words('substring(line, 1, length(line) - length(radif))')})[-1] AS word FROM s JOIN r USING (text_id) WHERE ends_with(line, radif)),
n AS (SELECT text_id, word, count(*) AS n, CASE WHEN length(word) > 3 THEN right(word, 3) ELSE word END AS tail FROM b WHERE word IS NOT NULL GROUP BY ALL),
t AS (SELECT text_id, tail, sum(n) AS n FROM n GROUP BY ALL), p AS (SELECT text_id, tail FROM t QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY n DESC, tail) = 1),
l AS (SELECT text_id, string_agg(word, ',' ORDER BY word) AS qaafiya FROM n GROUP BY text_id),
o AS (SELECT s.text_id, k, {q.words('line')} AS ws, radif FROM s JOIN r USING (text_id)), y AS (SELECT text_id, ws[-2] AS single, count(*) AS n, min(k) AS k FROM o WHERE len(ws) >= 2 AND ws[-1] = radif GROUP BY ALL),
z AS (SELECT text_id, single FROM y QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY n DESC, k) = 1)
SELECT l.text_id, l.qaafiya, p.tail AS qaafiya_pattern, z.single FROM l JOIN p USING (text_id) LEFT JOIN z USING (text_id)"""


def matla_maqta_flags(spark: SparkSession, d: str) -> DataFrame:
    v = _verses(spark, d)
    a = Tables(spark, d)
    names = a.texts.select(F.col("id").alias("text_id"), "poet_id").join(a.poets.select(F.col("id").alias("poet_id"), F.col("name_urdu").alias("name")), "poet_id")
    return verse.openings_and_closings(v, verse.refrains(verse.seconds(v)), names)


SQL["matla_maqta_flags"] = f"""{_R}, a AS (SELECT text_id, couplet_index, {q.letters('misra1_urdu')} AS a, {q.letters('misra2_urdu')} AS b FROM v),
x AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY couplet_index) = 1), y AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY couplet_index DESC) = 1),
n AS (SELECT t.id AS text_id, {q.letters("coalesce(p.name_urdu, '')")} AS name FROM texts t JOIN poets p ON p.id = t.poet_id)
SELECT x.text_id, coalesce(r.radif <> '' AND ends_with(x.a, r.radif) AND ends_with(x.b, r.radif), false) AS matla, coalesce(n.name <> '' AND contains(y.a || ' ' || y.b, n.name), false) AS maqta FROM x JOIN y USING (text_id) LEFT JOIN r USING (text_id) LEFT JOIN n USING (text_id)"""


def theme_cascade(spark: SparkSession, d: str) -> DataFrame:
    return verse.themes(_verses(spark, d))


_THEME = q.case([(f"bool_or({q.any_of('l', keys)})", f"'{n}'") for n, keys in fixed.THEMES.items()], "'general'")
SQL["theme_cascade"] = f"WITH {q.VERSES}, x AS (SELECT text_id, misra1_urdu || ' ' || misra2_urdu AS l FROM v) SELECT text_id, {_THEME} AS theme FROM x GROUP BY text_id"


def emotion_counts(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d).texts.where("text_urdu IS NOT NULL")
    return t.groupBy("poet_id").agg(*(F.count_if(c).alias(n) for n, c in fv.emotions(F.col("text_urdu")).items()))


SQL["emotion_counts"] = "SELECT poet_id, " + ", ".join(f"count(*) FILTER ({q.any_of('text_urdu', keys)}) AS {n}" for n, keys in fixed.EMOTIONS.items()) + " FROM texts WHERE text_urdu IS NOT NULL GROUP BY poet_id"


def meter_pattern_by_text(spark: SparkSession, d: str) -> DataFrame:
    return verse.metres(_verses(spark, d))


_NAME, _SURE = q.metre_class("pattern")
SQL["meter_pattern_by_text"] = f"WITH {q.VERSES}, p AS (SELECT text_id, {q.metre_pattern('misra1_urdu')} AS pattern FROM v QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY couplet_index, misra1_urdu) = 1) SELECT text_id, pattern, {_NAME} AS name, {_SURE} AS confidence FROM p"


def meter_clusters(spark: SparkSession, d: str) -> DataFrame:
    return verse.metre_mining(_verses(spark, d)).orderBy(F.desc("frequency"), "pattern")


SQL["meter_clusters"] = f"WITH {q.VERSES}, p AS (SELECT text_id, {q.metre_pattern('misra1_urdu')} AS pattern FROM v) SELECT pattern, count(*) AS frequency, min(text_id) AS example_text_id FROM p WHERE pattern <> '' GROUP BY pattern ORDER BY frequency DESC, pattern"


def length_meter(spark: SparkSession, d: str) -> DataFrame:
    return verse.lengths(_verses(spark, d))


def _vowels(x: str, more: str = "") -> str:
    return f"length(regexp_replace({x}, '[^{fixed.VOWELS}{more}]', '', 'g'))"


_OPENING = f"array_to_string([CAST(greatest({_vowels('w')}, 1) AS VARCHAR) for w in ({q.words('m')})[1:3]], '-')"
SQL["length_meter"] = f"""WITH {q.VERSES}, a AS (SELECT text_id, sum(length(misra1_urdu) + length(misra2_urdu)) AS total, sum(CASE WHEN misra1_urdu <> '' THEN {_vowels('misra1_urdu', ' ')} ELSE 0 END + CASE WHEN misra2_urdu <> '' THEN {_vowels('misra2_urdu', ' ')} ELSE 0 END) / nullif(sum((misra1_urdu <> '')::INT + (misra2_urdu <> '')::INT), 0) AS mean FROM v GROUP BY text_id),
t AS (SELECT text_id, misra2_urdu AS m FROM v QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY couplet_index) <= 3), p AS (SELECT text_id, list({_OPENING}) FILTER (m <> '' AND {_OPENING} <> '') AS p FROM t GROUP BY text_id)
SELECT text_id, CASE WHEN total < 120 THEN 'short' WHEN total < 250 THEN 'medium' ELSE 'long' END AS length, CASE WHEN mean IS NULL THEN 'unknown' WHEN mean < 5 THEN 'short (khafif)' WHEN mean < 9 THEN 'medium (hazaj)' ELSE 'long (muzari)' END AS vowels, CASE WHEN len(p) >= 2 AND len(list_distinct(p)) = 1 THEN 'regular_' || p[1] ELSE 'irregular' END AS regularity FROM a JOIN p USING (text_id)"""


def text_outline(spark: SparkSession, d: str) -> DataFrame:
    return verse.outline(Tables(spark, d).texts.where("text_urdu IS NOT NULL").select("id", "text_urdu"), "text_urdu")


_LF = "translate({0}, '،۔!?', '')".format(q.strip("m"))
SQL["text_outline"] = f"""WITH x AS (SELECT id, {q.lines('text_urdu')} AS l FROM texts WHERE text_urdu IS NOT NULL), b AS (SELECT id AS text_id, i AS k, {_LF} AS line FROM (SELECT id, i, coalesce(l[2 * i], '') AS m FROM (SELECT id, l, unnest(range(1, (len(l) + 1) // 2 + 1)) AS i FROM x))), s AS (SELECT * FROM b WHERE line <> ''),
w AS (SELECT text_id, k, {q.words('line')} AS ws FROM s), c AS (SELECT text_id, ws[-1] AS word, count(*) AS n, min(k) AS first_k FROM w GROUP BY ALL), r AS (SELECT text_id, CASE WHEN max(n) >= 2 THEN arg_min(word, first_k) FILTER (n >= 2) END AS radif FROM c GROUP BY text_id HAVING sum(n) >= 2),
y AS (SELECT w.text_id, string_agg(DISTINCT ws[-2], ',' ORDER BY ws[-2]) AS rhymes FROM w JOIN r USING (text_id) WHERE len(ws) >= 2 AND ws[-1] = radif GROUP BY ALL)
SELECT x.id, x.l[1] AS first_line, (len(x.l) + 1) // 2 AS couplets, r.radif, y.rhymes FROM x LEFT JOIN r ON r.text_id = x.id LEFT JOIN y ON y.text_id = x.id"""


def text_analysis(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return verse.analysis(a.texts, a.poets, _verses(spark, d)).withColumn("qaafiya", F.array_join("qaafiya", ","))


SQL["text_analysis"] = f"""SELECT a.text_id, a.radif, a.confidence AS radif_confidence, b.qaafiya, b.qaafiya_pattern, c.theme, d.matla, d.maqta AS maqta_detected, e.name AS meter_name, e.pattern AS meter_pattern, e.confidence AS meter_confidence
FROM ({SQL['radif_by_text']}) a LEFT JOIN ({SQL['qaafiya_by_text']}) b USING (text_id) JOIN ({SQL['theme_cascade']}) c USING (text_id) JOIN ({SQL['matla_maqta_flags']}) d USING (text_id) JOIN ({SQL['meter_pattern_by_text']}) e USING (text_id)"""


#: Searches are asked for every text whose id is divisible by this, against all texts.
ASKED = 20


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).texts.where(F.col("id") % ASKED == 0).select("id")


def keyword_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return likeness.by_words(a.texts, a.poets, _asked(spark, d))


SQL["keyword_similarity_topk"] = f"""WITH k AS (SELECT t.id, t.title_urdu, t.form, p.name AS poet_name, list_distinct(({q.words('t.text_urdu')})[1:50]) AS k FROM texts t JOIN poets p ON p.id = t.poet_id), g AS (SELECT id AS target, k AS tk, poet_name AS tp FROM k WHERE id % 20 = 0)
SELECT target, id, title_urdu, poet_name, round(least(0.7 * ({q.jaccard('k', 'tk')}) + CASE WHEN poet_name = tp THEN 0.15 ELSE 0.0 END, 1.0)::DOUBLE, 3) AS score FROM k, g WHERE form = 'ghazal' AND id <> target QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, id) <= 10"""


def _v(spark: SparkSession, d: str) -> DataFrame:
    return likeness.vectors(Tables(spark, d).ghazal_embeddings)


def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    return likeness.by_vectors(_v(spark, d), _asked(spark, d).withColumnRenamed("id", "text_id"), 50)


_NEAR = f"{q.VECTORS}, g AS (SELECT text_id AS a, v AS tv FROM e WHERE text_id % 20 = 0 AND text_id IN (SELECT id FROM texts)), near AS (SELECT g.a, e.text_id AS b, round(CASE WHEN true THEN {q.cosine('e.v', 'g.tv')} END, 6) AS cosine FROM e, g WHERE e.text_id <> g.a QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 50)"
SQL["cosine_knn"] = f"WITH {_NEAR} SELECT a, b, cosine FROM near"


def explainable_similarity(spark: SparkSession, d: str) -> DataFrame:
    return likeness.explained(cosine_knn(spark, d), _features(spark, d))


_OVER = "CASE WHEN coalesce(len(fa.qaafiya), 0) = 0 OR coalesce(len(fb.qaafiya), 0) = 0 THEN 0.0 ELSE len(list_intersect(fa.qaafiya, fb.qaafiya)) / greatest(len(fa.qaafiya), len(fb.qaafiya)) END"
_SAME = "CASE WHEN fa.{0} <> '' AND fa.{0} = fb.{0} THEN 1.0 ELSE 0.0 END"
_EXPLAINED = f"""{_NEAR}, {q.FEATURES}, parts AS (SELECT near.a, near.b, cosine, fa.radif AS ra, fa.theme AS ta, (cosine * 0.5)::DOUBLE AS semantic, (({_SAME.format('radif')}) * 0.2)::DOUBLE AS radif, (({_OVER}) * 0.2)::DOUBLE AS qaafiya, (({_SAME.format('theme')}) * 0.1)::DOUBLE AS theme
FROM near LEFT JOIN f fa ON fa.text_id = near.a LEFT JOIN f fb ON fb.text_id = near.b), x AS (SELECT *, semantic + radif + qaafiya + theme AS total FROM parts)"""
_WHY = "concat_ws(chr(10), printf('Semantic similarity (%.2f) → %.1f%%', round(cosine, 2), round(semantic * 100, 1)), CASE WHEN radif > 0 THEN 'Same radif ' || chr(39) || ra || chr(39) || ' → 20%' ELSE 'Different radif → 0%' END, CASE WHEN qaafiya > 0 THEN printf('Qaafiya overlap (%.2f) → %.1f%%', round(qaafiya / 0.2, 2), round(qaafiya * 100, 1)) ELSE 'No qaafiya overlap → 0%' END, CASE WHEN theme > 0 THEN 'Same theme ' || chr(39) || ta || chr(39) || ' → 10%' ELSE 'Different theme → 0%' END)"
SQL["explainable_similarity"] = f"WITH {_EXPLAINED} SELECT a, b, round(total, 3) AS score, round(total * 100, 2) AS percentage, round(semantic, 3) AS semantic, round(radif, 3) AS radif, round(qaafiya, 3) AS qaafiya, round(theme, 3) AS theme, {_WHY} AS explanation FROM x"


def knn_attribution(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return likeness.poet_by_neighbours(_v(spark, d), a.texts, a.poets, _features(spark, d), _asked(spark, d).withColumnRenamed("id", "text_id"))


SQL["knn_attribution"] = f"""WITH {_EXPLAINED}, s AS (SELECT a, t.poet_id, p.name AS poet_name, b, round(total, 3) AS score FROM x JOIN texts t ON t.id = x.b JOIN poets p ON p.id = t.poet_id WHERE round(total, 3) > 0),
m AS (SELECT a, poet_id, poet_name, round(avg(score), 3) AS score FROM s GROUP BY ALL), top AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, poet_id) <= 3), two AS (SELECT a, poet_id, b, row_number() OVER (PARTITION BY a, poet_id ORDER BY score DESC, b) AS rk FROM s)
SELECT top.a, top.poet_id, top.poet_name, top.score, string_agg(CAST(two.b AS VARCHAR), ',' ORDER BY rk) AS examples FROM top JOIN two ON two.a = top.a AND two.poet_id = top.poet_id AND rk <= 2 GROUP BY ALL"""


def poet_centroids(spark: SparkSession, d: str) -> DataFrame:
    own = Tables(spark, d).texts.select(F.col("id").alias("text_id"), "poet_id")
    m = likeness.centroids(_v(spark, d).join(own, "text_id"), "poet_id")
    return m.select("poet_id", F.posexplode("centroid").alias("place", "mean")).select("poet_id", F.col("place").cast("long").alias("place"), (F.floor(F.col("mean") * 1000000 + 0.5) / 1000000).alias("mean"))  # ties are frequent here, and the engines round them differently


SQL["poet_centroids"] = f"WITH {q.VECTORS} SELECT t.poet_id, i - 1 AS place, floor(avg(e.v[i]) * 1000000 + 0.5) / 1000000 AS mean FROM e JOIN texts t ON t.id = e.text_id, range(1, 385) r(i) WHERE t.poet_id IS NOT NULL GROUP BY ALL"


def poet_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    p = likeness.fingerprints(_v(spark, d), Tables(spark, d).texts, _features(spark, d))
    return p.select("poet_id", F.array_join(F.transform("common_radif", lambda x: F.concat(x["radif"], F.lit("="), x["n"].cast("string"))), "|").alias("radifs"), F.array_join(F.transform(F.array_sort(F.map_entries("metres")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), "|").alias("metres"), F.size("centroid").cast("long").alias("width"))


SQL["poet_fingerprints"] = f"""WITH {q.VECTORS}, {q.FEATURES}, o AS (SELECT DISTINCT t.poet_id FROM e JOIN texts t ON t.id = e.text_id WHERE t.poet_id IS NOT NULL), j AS (SELECT t.poet_id, f.radif, f.meter_name FROM f JOIN texts t ON t.id = f.text_id WHERE t.poet_id IS NOT NULL),
rc AS (SELECT poet_id, radif, count(*) AS n FROM j WHERE radif IS NOT NULL AND radif <> '' GROUP BY ALL), r AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY poet_id ORDER BY n DESC, radif) <= 5), rr AS (SELECT poet_id, string_agg(radif || '=' || n, '|' ORDER BY n DESC, radif) AS radifs FROM r GROUP BY poet_id),
m AS (SELECT poet_id, meter_name, count(*) AS n FROM j WHERE meter_name IS NOT NULL GROUP BY ALL), mm AS (SELECT poet_id, string_agg(meter_name || '=' || n, '|' ORDER BY meter_name) AS metres FROM m GROUP BY poet_id)
SELECT o.poet_id, rr.radifs, mm.metres, CAST(384 AS BIGINT) AS width FROM o LEFT JOIN rr USING (poet_id) LEFT JOIN mm USING (poet_id)"""


def fingerprint_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest poets of every text with a vector."""
    v, f = _v(spark, d), _features(spark, d)
    return likeness.by_fingerprint(v, f, likeness.fingerprints(v, Tables(spark, d).texts, f))


_PRINTS = f"""WITH {q.VECTORS}, {q.FEATURES}, d AS (SELECT t.poet_id, i, avg(e.v[i]) AS x FROM e JOIN texts t ON t.id = e.text_id, range(1, 385) r(i) WHERE t.poet_id IS NOT NULL GROUP BY ALL), m AS (SELECT poet_id, list(x ORDER BY i) AS c FROM d GROUP BY poet_id),
j AS (SELECT t.poet_id, f.radif, count(*) AS n FROM f JOIN texts t ON t.id = f.text_id WHERE t.poet_id IS NOT NULL AND f.radif IS NOT NULL AND f.radif <> '' GROUP BY ALL), r AS (SELECT poet_id, radif FROM j QUALIFY row_number() OVER (PARTITION BY poet_id ORDER BY n DESC, radif) <= 5)"""
SQL["fingerprint_attribution"] = f"""{_PRINTS}, s AS (SELECT e.text_id, m.poet_id, round(0.6 * ({q.cosine('e.v', 'm.c')}) + CASE WHEN r.radif IS NOT NULL THEN 0.2 ELSE 0.0 END + 0.1 * 0.5, 6)::DOUBLE AS score FROM e CROSS JOIN m LEFT JOIN f ON f.text_id = e.text_id LEFT JOIN r ON r.poet_id = m.poet_id AND r.radif = f.radif)
SELECT text_id, poet_id, score, CAST(row_number() OVER (PARTITION BY text_id ORDER BY score DESC, poet_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3"""


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All 391 places, those of the vector to six decimals."""
    rows = learning.feature_vectors(Tables(spark, d).texts, _features(spark, d), _v(spark, d))
    return rows.select("text_id", "poet_id", F.transform("features", lambda x: rounded(x, 6)).alias("features"))


def _bucket(x: str, bins: int) -> str:
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE ('0x' || substring(md5({x}), 1, 7))::BIGINT % {bins} END)::DOUBLE"


SQL["feature_vectors"] = f"WITH {q.VECTORS}, {q.FEATURES} SELECT t.id AS text_id, t.poet_id, list_concat(coalesce([round(x, 6) for x in e.v], list_resize([]::DOUBLE[], 384, 0.0)), [{_bucket('f.radif', 100)}, " + ", ".join(_bucket(f"f.qaafiya[{i}]", 100) for i in (1, 2, 3)) + f", {_bucket('f.meter_name', 50)}, {_bucket('f.theme', 10)}, coalesce(len(f.qaafiya), 0)::DOUBLE]) AS features FROM texts t LEFT JOIN f ON f.text_id = t.id LEFT JOIN e ON e.text_id = t.id WHERE t.poet_id IS NOT NULL"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return learning.split(_rows(spark, d).select("vec_id", "label"), "vec_id", "label")


_SPLIT = "s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) <= count(*) OVER (PARTITION BY label) // 5 AS test FROM embeddings)"
SQL["stratified_split"] = f"WITH {_SPLIT} SELECT vec_id, label, test FROM s"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    s = learning.split(_rows(spark, d), "vec_id", "label")
    means = likeness.centroids(s.where("NOT test"), "label")
    return learning.nearest_centroid(s.where("test"), means, "vec_id", "label", "v")


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return learning.measures(_predicted(spark, d), "label")


_MEANS = "a AS (SELECT label, i, avg(v[i]) AS x FROM s, range(1, 65) r(i) WHERE NOT test GROUP BY ALL), m AS (SELECT label AS l, list(x ORDER BY i) AS c FROM a GROUP BY label)"
_RANKED = f"k AS (SELECT s.vec_id, s.label, m.l, row_number() OVER (PARTITION BY s.vec_id ORDER BY round({q.cosine('s.v', 'm.c')}, 9) DESC, m.l) AS rk FROM s, m WHERE s.test), p AS (SELECT vec_id, label, max(CASE WHEN rk = 1 THEN l END) AS predicted, max(CASE WHEN rk = 2 THEN l END) AS second, max(CASE WHEN rk = 3 THEN l END) AS third FROM k GROUP BY ALL)"
_P = f"WITH {_SPLIT}, {_MEANS}, {_RANKED}"
SQL["eval_metrics"] = f"""{_P}, h AS (SELECT label AS l, count(*) AS support, count(*) FILTER (label = predicted) AS hit FROM p GROUP BY label), g AS (SELECT predicted AS l, count(*) AS said FROM p GROUP BY predicted),
x AS (SELECT coalesce(h.l, g.l) AS label, coalesce(support, 0) AS support, coalesce(hit / nullif(said, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM h FULL JOIN g ON g.l = h.l)
SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM x"""


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return learning.accuracy(_predicted(spark, d), "label")


SQL["accuracy"] = f"{_P} SELECT count(*) AS n, round(avg((label = predicted)::INT), 6) AS top1, round(avg((label IN (predicted, second, third))::INT), 6) AS top3 FROM p"


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return learning.confusion(_predicted(spark, d), "label")


SQL["confusion_matrix"] = f"{_P} SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL"


def worst_labels(spark: SparkSession, d: str) -> DataFrame:
    return learning.worst(_predicted(spark, d), "label")


SQL["worst_labels"] = f"{_P} SELECT label, count(*) AS errors FROM p WHERE label <> predicted GROUP BY label ORDER BY errors DESC, label LIMIT 5"


def rf_train_predict(spark: SparkSession, d: str) -> DataFrame:
    s = cut(learning.split(_rows(spark, d), "vec_id", "label"))
    model = learning.train(s.where("NOT test"), "label", "v")
    return learning.predict(model, s.where("test"), "vec_id", "label", "v")


def missing_predictions_anti(spark: SparkSession, d: str) -> DataFrame:
    a = Tables(spark, d)
    return learning.missing(a.texts, a.poetic_features)


SQL["missing_predictions_anti"] = "SELECT id AS text_id FROM texts WHERE id NOT IN (SELECT text_id FROM poetic_features WHERE text_id IS NOT NULL)"


def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each text with a vector against the text after it."""
    v = _v(spark, d)
    pairs = v.select(F.col("text_id").alias("a"), (F.col("text_id") + 1).alias("b"))
    return likeness.pair_similarity(pairs, v)


SQL["pair_similarity"] = f"WITH {q.VECTORS} SELECT a.text_id AS a, a.text_id + 1 AS b, coalesce(round({q.cosine('a.v', 'b.v')}, 6), 0.0) AS cosine FROM e a LEFT JOIN e b ON b.text_id = a.text_id + 1"
