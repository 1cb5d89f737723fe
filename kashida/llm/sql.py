"""The problems' statements in DuckDB's SQL, as brute force over whole tables, where SQL can express them."""

from __future__ import annotations

from .copies import LABELS

# White space as Unicode defines it, in RE2's notation.
BLANK = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def _table(name: str, rules: dict[str, str]) -> str:
    return f"{name} AS MATERIALIZED (SELECT {_list(rules)} AS k, {_list(rules.values())} AS v)"


# The characters of the test tables that look like others, written out here apart from the operators' own mapping:
# Arabic presentation forms, after the letter they are forms of.
FORMS = """
آ ﺁﺂ
ئ ﺉﺊﺋﺌ
ا ﺍﺎ
ب ﺏﺐﺑﺒ
پ ﭖﭗﭘﭙ
ت ﺕﺖﺗﺘ
ٹ ﭦﭧﭨﭩ
ث ﺙﺚﺛﺜ
ج ﺝﺞﺟﺠ
چ ﭺﭻﭼﭽ
ح ﺡﺢﺣﺤ
خ ﺥﺦﺧﺨ
د ﺩﺪ
ڈ ﮈﮉ
ذ ﺫﺬ
ر ﺭﺮ
ڑ ﮌﮍ
ز ﺯﺰ
ژ ﮊﮋ
س ﺱﺲﺳﺴ
ش ﺵﺶﺷﺸ
ص ﺹﺺﺻﺼ
ض ﺽﺾﺿﻀ
ط ﻁﻂﻃﻄ
ظ ﻅﻆﻇﻈ
ع ﻉﻊﻋﻌ
غ ﻍﻎﻏﻐ
ف ﻑﻒﻓﻔ
ق ﻕﻖﻗﻘ
ک ﮎﮏﮐﮑﻙﻚﻛﻜ
گ ﮒﮓﮔﮕ
ل ﻝﻞﻟﻠ
م ﻡﻢﻣﻤ
ن ﻥﻦﻧﻨ
ں ﮞﮟ
و ﻭﻮ
ہ ﮦﮧﮨﮩﻩﻪﻫﻬ
ھ ﮪﮫﮬﮭ
ے ﮮﮯ
ی ﯨﯩﯼﯽﯾﯿﻯﻰﻱﻲﻳﻴ
لا ﻻﻼ
ئا ﯪﯫ
"""
# Letters of other scripts, and the letters that they look like.
ALIKE = ("ΑΒΕΗΙΚΜΝΟΡΤΥΧΖναιορυАВЕКМНОРСТХІЈЅаеорсухіјѕيىكهەة", "ABEHIKMNOPTYXZvaiopuABEKMHOPCTXIJSaeopcyxijsییکہہۃ")
# Invisible characters, and blanks.
UNSEEN, WIDE_BLANKS = "\u00ad\u061c\u200b\u200c\u200d\u200e\u200f\u2060\ufeff", "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f\u3000"


def _maps() -> tuple[dict[str, str], dict[str, str]]:
    bare = {c: "" for c in UNSEEN} | {c: " " for c in WIDE_BLANKS}
    wide = {chr(x + 0xFEE0): chr(x) for x in range(0x21, 0x7F)}
    forms = {c: k for k, v in map(str.split, FORMS.strip().split("\n")) for c in v}
    digits = {chr(0x660 + i): chr(0x6F0 + i) for i in range(10)}
    return bare | forms | wide | digits | dict(zip(*ALIKE)), bare | {k: v for k, v in wide.items() if not v.isalnum()}


def _mapped(text: str, name: str) -> str:
    """The characters of a text by a table of single ones."""
    return f"array_to_string([coalesce({name}.v[list_position({name}.k, c)], c) for c in string_split({text}, '')], '')"


def _fold(text: str) -> str:
    """The consistent form: single characters by the table, then marks composed; two letters have no composed form of their own."""
    return f"replace(nfc_normalize({_mapped(text, 'full_map')}), 'ی' || chr(1620), 'ئ')"


MAPS = ", ".join(map(_table, ("full_map", "bare_map"), _maps()))
WORDS = r"'\p{L}[\p{L}\p{M}]*'"
BODIES = r"""own AS (SELECT id, text_urdu AS body FROM texts WHERE text_urdu IS NOT NULL),
vs AS (SELECT DISTINCT text_id, couplet_index, misra1_urdu AS a, misra2_urdu AS b FROM verses WHERE text_id IN (SELECT id FROM texts WHERE text_urdu IS NULL)),
ls AS (SELECT text_id, couplet_index, i, CASE i WHEN 1 THEN a ELSE b END AS l FROM vs, (VALUES (1), (2)) n(i)),
bodies AS (SELECT id, body FROM own UNION ALL SELECT text_id, string_agg(l, chr(10) ORDER BY couplet_index, i) FROM ls WHERE regexp_matches(l, '[^""" + BLANK + r"""]') GROUP BY text_id)"""

def _tokens(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[\p{{P}}\p{{Sm}}\p{{Sc}}\p{{So}}{BLANK}]+', ' ', 'g'))"


_FIELD = f"contains(x, ':') AND list_contains({_list(sorted(LABELS))}, lower(trim(split_part(x, ':', 1))))"
_HEAD = f"(l NOT SIMILAR TO '[{BLANK}]*' AND len([x for x in string_split(l, '|') if NOT ({_FIELD})]) > 0)"

_KEYS = rf"""WITH {BODIES}, s AS (SELECT id, body, string_split_regex(body, '\r\n|\n|\r') AS ln FROM bodies WHERE regexp_matches(body, '\p{{L}}')),
h AS (SELECT id, body, ln, coalesce(list_position([{_HEAD} for l in ln], true), len(ln) + 1) AS p FROM s),
f AS (SELECT id, body, list_sort(flatten([[{_tokens('x')} for x in string_split(l, '|')] for l in ln[1:p - 1] if l SIMILAR TO '.*[^{BLANK}].*'])) AS fields, array_to_string(ln[p:], chr(10)) AS rest FROM h),
c AS (SELECT id, array_to_string(fields, chr(30)) || chr(30) || CASE WHEN len(fields) > 0 THEN {_tokens('rest')} ELSE {_tokens('body')} END AS k FROM f)"""
_TERMS = f"""WITH {MAPS}, t AS (SELECT id, regexp_extract_all(lower({_fold('text_urdu')}), {WORDS}) AS w FROM texts, full_map WHERE text_urdu IS NOT NULL),
r AS (SELECT text_id, radif FROM poetic_features QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY created_at DESC NULLS LAST, radif DESC NULLS LAST) = 1), rw AS (SELECT text_id, array_to_string(regexp_extract_all(lower({_fold('radif')}), {WORDS}), ' ') AS term FROM r, full_map WHERE radif IS NOT NULL),
x AS (SELECT 'text_urdu' AS field_name, id, unnest(w) AS term, 0.2 AS share FROM t UNION ALL SELECT 'radif', text_id, term, 0.02 FROM rw WHERE term <> ''),
n AS (SELECT field_name, count(DISTINCT id) AS total FROM x GROUP BY ALL), c AS (SELECT field_name, term, share, count(*) AS occurrences, count(DISTINCT id) AS held FROM x GROUP BY ALL)"""
_NEAR = """WITH l AS (SELECT text_id, embedding_vector AS e FROM ghazal_embeddings QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY updated_at DESC NULLS LAST, embedding_vector DESC NULLS LAST) = 1),
u AS (SELECT text_id AS id, e::DOUBLE[] AS v FROM l WHERE len(e) = 384 AND len([x for x in e if x IS NOT NULL AND isfinite(x)]) = 384 AND len([x for x in e if x <> 0]) > 0), m AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS s FROM u),
p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (a.s * b.s), 6) AS cosine FROM m a JOIN m b ON a.id <> b.id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS INTEGER) AS rank FROM p QUALIFY rank <= 5)"""

_GRAMS = "list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END)"
_LINES = f"array_to_string([l for l in string_split_regex(f, '\\r\\n|\\n|\\r') if l NOT SIMILAR TO '[{BLANK}]*'][1:2], chr(10))"
# items are decided one by one, in a list of those accepted so far
_ITEMS = f"""WITH RECURSIVE {MAPS}, {BODIES}, one AS (SELECT item_id AS id, full_text AS f, coalesce(full_text, normalized_text) AS t FROM bulk_preview QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY arrived_at NULLS LAST, full_text) = 1),
iw AS (SELECT id, regexp_extract_all(lower({_fold('t')}), {WORDS}) AS w, array_to_string(regexp_extract_all(lower({_fold(_LINES)}), {WORDS}), ' ') AS c FROM one, full_map), bw AS (SELECT id, regexp_extract_all(lower({_fold('body')}), {WORDS}) AS w FROM bodies, full_map),
ig AS (SELECT id, {_GRAMS} AS g FROM iw WHERE len(w) > 0), bg AS (SELECT id, {_GRAMS} AS g FROM bw WHERE len(w) > 0), ix AS (SELECT id, len(g) AS n, unnest(g) AS g FROM ig), bx AS (SELECT id, len(g) AS n, unnest(g) AS g FROM bg),
old AS (SELECT ix.id FROM ix JOIN bx USING (g) GROUP BY ix.id, bx.id HAVING count(*) / (any_value(ix.n) + any_value(bx.n) - count(*)) >= 0.6),
cw AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower({_fold("concat_ws(chr(10), misra1_urdu, misra2_urdu)")}), {WORDS}), ' ') AS c FROM verses, full_map WHERE couplet_index = 1),
near AS (SELECT b.id, a.id AS o FROM ix a JOIN ix b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6 UNION SELECT b.id, a.id FROM iw a JOIN iw b ON a.c = b.c AND a.c <> '' AND a.id < b.id),
it AS (SELECT iw.id, row_number() OVER (ORDER BY iw.id) AS k, len(w) > 0 AND (iw.id IN (SELECT id FROM old) OR (c <> '' AND c IN (SELECT c FROM cw))) AS known, coalesce((SELECT list(o) FROM near WHERE near.id = iw.id), []) AS ahead FROM iw),
s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS acc UNION ALL SELECT it.k, CASE WHEN it.known OR list_has_any(it.ahead, s.acc) THEN s.acc ELSE list_append(s.acc, it.id) END FROM s JOIN it ON it.k = s.k + 1)
SELECT id AS item_id FROM it WHERE NOT list_contains((SELECT acc FROM s ORDER BY k DESC LIMIT 1), id)"""

_DIAGONALS = f"""WITH {MAPS}, d AS (SELECT doc_id, regexp_extract_all(lower({_fold('text')}), {WORDS}) AS w FROM documents, full_map), i AS (SELECT item_id, regexp_extract_all(lower({_fold('text')}), {WORDS}) AS w FROM eval_items, full_map),
dp AS (SELECT doc_id, len(w) AS nd, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d), ip AS (SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM i),
g AS (SELECT doc_id, item_id, dp.p - ip.p AS shift, any_value(nd) AS nd, any_value(n) AS n, list(ip.p) AS ps FROM dp JOIN ip USING (w) GROUP BY ALL HAVING 20 * count(*) >= 9 * any_value(n)),
"""

SQL = {
    "p1_found": _ITEMS,
    "p1_batches": _ITEMS,
    "p5_ngrams": f"""WITH {MAPS}, t AS (SELECT id, regexp_extract_all(lower({_fold('text_urdu')}), {WORDS}) AS w FROM texts, full_map WHERE text_urdu IS NOT NULL), x AS (SELECT id, n, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS term FROM t, range(1, 6) r(n))
SELECT CAST(n AS INTEGER) AS n, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM x GROUP BY ALL""",
    "p2_found": f"{_KEYS}, g AS (SELECT id, min(id) OVER (PARTITION BY k) AS group_id FROM c) SELECT group_id, id AS text_id FROM g WHERE id <> group_id",
    "p2_copies": f"{_KEYS} SELECT min(id) AS text_id, count(*) AS copies FROM c GROUP BY k",
    "p3_verses": f"WITH {MAPS} SELECT text_id, couplet_index, {_fold('misra1_urdu')} AS misra1_urdu, {_fold('misra2_urdu')} AS misra2_urdu FROM verses, full_map",
    "p5_counts": f"{_TERMS} SELECT field_name, term, occurrences, held AS records, concat_ws(',', CASE WHEN held <= 2 THEN 'rare' END, CASE WHEN held >= share * total THEN 'common' END) AS marks FROM c JOIN n USING (field_name)",
    "p6_neighbours": f"{_NEAR} SELECT a AS text_id, b AS neighbour, cosine, rank FROM k",
    "p3_found": rf"""WITH {MAPS}, {BODIES}, f AS (SELECT id, {_fold('body')} AS look, {_mapped('body', 'bare_map')} AS bare FROM bodies, full_map, bare_map WHERE regexp_matches(body, '\p{{L}}'))
SELECT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.look = b.look AND a.id < b.id AND a.bare <> b.bare""",
    "p3_classes": rf"""WITH {MAPS}, {BODIES}, f AS (SELECT id, {_fold('body')} AS look, {_mapped('body', 'bare_map')} AS bare FROM bodies, full_map, bare_map WHERE regexp_matches(body, '\p{{L}}'))
SELECT id AS text_id, min(id) OVER (PARTITION BY look) AS class_id, min(id) OVER (PARTITION BY look, bare) AS spelling_id, k AS spellings FROM f JOIN (SELECT look, count(DISTINCT bare) AS k FROM f GROUP BY look HAVING k > 1) USING (look)""",
    "p4_found": f"""WITH {MAPS}, {BODIES}, w AS (SELECT id, regexp_extract_all(lower({_fold('body')}), {WORDS}) AS w FROM bodies, full_map),
s AS (SELECT id, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS g FROM w WHERE len(w) > 0),
x AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s), c AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM c WHERE c / (na + nb - c) >= 0.6""",
    # the smallest id reached through links between different texts, step by step
    "p4_classes": f"""WITH RECURSIVE {MAPS}, {BODIES}, w AS (SELECT id, regexp_extract_all(lower({_fold('body')}), {WORDS}) AS w FROM bodies, full_map), m AS (SELECT id, w, min(id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS copies FROM w WHERE len(w) > 0),
s AS (SELECT id, {_GRAMS} AS g FROM m WHERE id = rep), x AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s), l AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6),
reach AS (SELECT DISTINCT a AS id, a AS other FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.other), c AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id), k AS (SELECT a AS id, count(*) AS links FROM l GROUP BY a)
SELECT m.id AS text_id, coalesce(c.class_id, m.rep) AS class_id, coalesce(k.links, 0) AS links FROM m LEFT JOIN c ON c.id = m.rep LEFT JOIN k ON k.id = m.rep WHERE m.copies > 1 OR k.links IS NOT NULL""",
    "p5_found": f"{_TERMS} SELECT field_name, term, 'rare' AS mark FROM c WHERE held <= 2 UNION ALL SELECT field_name, term, 'common' FROM c JOIN n USING (field_name) WHERE held >= share * total",
    "p6_found": f"{_NEAR} SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k",
    # a stretch from one equal word to another may take in changed words at its ends, as far as nine in ten stay equal
    "p8_found": f"""{_DIAGONALS}m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS k FROM (SELECT doc_id, item_id, shift, nd, n, unnest(ps) AS p FROM g)),
r AS (SELECT a.doc_id, a.item_id, a.n, b.p - a.p + 1 AS span, least(least(a.n, a.nd - a.shift) - greatest(1, 1 - a.shift) + 1, 10 * (b.k - a.k + 1) // 9) AS most FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.shift = b.shift AND a.p <= b.p)
SELECT DISTINCT doc_id, item_id FROM r WHERE most >= span AND 2 * most >= n""",
    # every stretch of a diagonal; of those long enough the longest, then the first
    "p8_spans": f"""{_DIAGONALS}h AS (SELECT doc_id, item_id, shift, n, greatest(1, 1 - shift) AS lo, least(n, nd - shift) AS hi, [len([x for x in ps if x <= k]) for k in range(0, n + 1)] AS c FROM g),
a AS (SELECT *, unnest(range(lo, hi + 1)) AS a FROM h), b AS (SELECT *, unnest(range(a + (n + 1) // 2 - 1, hi + 1)) AS b FROM a), s AS (SELECT doc_id, item_id, n, a + shift - 1 AS first, b + shift AS last FROM b WHERE 10 * (b - a + 1 - c[b + 1] + c[a]) <= b - a + 1)
SELECT doc_id, item_id, CAST(first AS INTEGER) AS "begin", CAST(last AS INTEGER) AS "end", CAST(n AS INTEGER) AS item_words, round((last - first) / n, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY last - first DESC, first) = 1""",
}
