"""Pieces of SQL, in DuckDB's dialect, from which the registered statements are put together."""

from __future__ import annotations

from ..functions import fixed
from ..functions.fixed import ARABIC, BLANK


def text(s: str) -> str:
    """A literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '[{BLANK}]+', ' ', 'g')")


def letters(x: str) -> str:
    return strip(f"translate({x}, '{fixed.LETTERS_FROM}', '{fixed.LETTERS_TO}')")


def words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[^{BLANK}]+')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[{ARABIC}]+')"


def lines(x: str) -> str:
    return f"[l for l in [{strip('r')} for r in string_split(coalesce({x}, ''), chr(10))] if l <> '']"


def bulk_form(x: str) -> str:
    return f"lower(replace(translate(replace({strip(x)}, '  ', ' '), '،۔', ''), chr(10), ' '))"


def text_form(x: str) -> str:
    return f"lower(translate({squeeze(x)}, '،.!', ''))"


def first_couplet(x: str) -> str:
    return f"array_to_string(({lines(x)})[1:2], ' ')"


def any_of(x: str, keys: list[str]) -> str:
    return "(" + " OR ".join(f"contains(coalesce({x}, ''), {text(k)})" for k in keys) + ")"


def case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


def lookup(word: str, table: dict[str, str]) -> str:
    """The value of a word in a table, or null."""
    keys, values = ("[" + ", ".join(map(text, x)) + "]" for x in (table, table.values()))
    return f"({values})[list_position({keys}, {word})]"


def metre_pattern(x: str) -> str:
    n = f"length(regexp_replace(w, '[^{fixed.LONG_VOWELS}]', '', 'g'))"
    return f"array_to_string([CASE WHEN {n} >= 2 THEN 'L' ELSE 'S' END for w in {tokens(letters(f'''coalesce({x}, '')'''))}][1:12], '')"


def metre_class(p: str) -> tuple[str, str]:
    """Name and confidence."""
    names = [(f"{p} = ''", "'Unknown'"), *((f"{p} = '{k}'", f"'{n}'") for k, n in fixed.METRES.items()), *((f"starts_with({p}, '{k[:4]}')", f"'{n}'") for k, n in fixed.METRES.items())]
    sure = [(f"{p} = ''", "0.0"), *((f"{p} = '{k}'", "0.8") for k in fixed.METRES), *((f"starts_with({p}, '{k[:4]}')", "0.5") for k in fixed.METRES)]
    return case(names, "'Unknown'"), f"CAST({case(sure, '0.3')} AS DOUBLE)"


def trigrams(x: str) -> str:
    word = "regexp_extract_all(lower(coalesce(" + x + r", '')), '[\p{L}\p{N}]+')"
    return f"list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in {word}]))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both} / (len(list_distinct({a})) + len(list_distinct({b})) - {both}) END"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}) + 1e-8)"


#: Each (text_id, couplet_index) once; of differing rows the smallest.
VERSES = """v AS (
    SELECT text_id, couplet_index, coalesce(misra1_urdu, '') AS misra1_urdu, coalesce(misra2_urdu, '') AS misra2_urdu FROM verses
    QUALIFY row_number() OVER (PARTITION BY text_id, couplet_index ORDER BY coalesce(misra1_urdu, ''), coalesce(misra2_urdu, ''), coalesce(misra1_english, ''), coalesce(misra2_english, '')) = 1)"""
#: The latest features of each text.
FEATURES = """f AS (
    SELECT * FROM poetic_features WHERE text_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY created_at DESC NULLS LAST, radif DESC NULLS LAST, radif_confidence DESC NULLS LAST, array_to_string(qaafiya, ',') DESC NULLS LAST, qaafiya_pattern DESC NULLS LAST, theme DESC NULLS LAST, maqta_detected DESC NULLS LAST, meter_name DESC NULLS LAST, meter_pattern DESC NULLS LAST, meter_confidence DESC NULLS LAST) = 1)"""
#: The latest vector of each text, if it has the right width and is finite.
VECTORS = """latest AS (
    SELECT text_id, embedding_vector FROM ghazal_embeddings WHERE text_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY updated_at DESC NULLS LAST, embedding_vector DESC NULLS LAST) = 1),
e AS (SELECT text_id, embedding_vector::DOUBLE[] AS v FROM latest WHERE len(embedding_vector) = 384 AND len([x for x in embedding_vector if x IS NOT NULL AND isfinite(x)]) = 384)"""
#: The lines that rhyme: second lines in one form of letters.
SECONDS = f"s AS (SELECT text_id, couplet_index AS k, {letters('misra2_urdu')} AS line FROM v WHERE {letters('misra2_urdu')} <> '')"
#: The refrain of each text.
REFRAINS = f"""w AS (SELECT text_id, k, line, ({words('line')})[-1] AS word FROM s),
c AS (SELECT text_id, word, count(*) AS n, min(k) AS first_k FROM w GROUP BY ALL),
r AS (SELECT text_id, word AS radif, round(n / sum(n) OVER (PARTITION BY text_id), 6) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY n DESC, first_k) = 1)"""
