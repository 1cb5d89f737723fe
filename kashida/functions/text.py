"""Text functions: every one takes and gives Columns, and stays in the JVM. Null in, null out, unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .fixed import ARABIC, BLANK


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, f"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(s: Column) -> Column:
    """Stripped, every run of white space one blank."""
    return strip(F.regexp_replace(s, f"[{BLANK}]+", " "))


def letters(s: Column) -> Column:
    """Arabic letters as their Urdu ones, stripped."""
    return strip(F.translate(s, fixed.LETTERS_FROM, fixed.LETTERS_TO))


def bulk_form(s: Column) -> Column:
    """The form hashed on upload: stripped, double blanks made single once, without the comma and full stop, line ends as blanks, lower case."""
    s = F.replace(strip(s), F.lit("  "), F.lit(" "))
    return F.lower(F.replace(F.translate(s, "،۔", ""), F.lit("\n"), F.lit(" ")))


def text_form(s: Column) -> Column:
    """Squeezed, without comma, full stop and exclamation mark, lower case."""
    return F.lower(F.translate(squeeze(s), "،.!", ""))


def line_form(s: Column) -> Column:
    """A line stripped, without full stop, comma, exclamation and question mark."""
    return F.translate(strip(s), "،۔!?", "")


def tokens(s: Column) -> Column:
    """Maximal runs of characters of the Arabic block, its punctuation included. Null: none."""
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(f"[{ARABIC}]+"), F.lit(0))


def words(s: Column) -> Column:
    """What stands between white space. Null: none."""
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(f"[^{BLANK}]+"), F.lit(0))


def lines(s: Column) -> Column:
    """The lines, stripped, without blank ones. Null: none."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), "\n"), strip), lambda x: x != "")


def couplets(parts: Column, keep_odd: bool = True) -> Column:
    """Array of (couplet_index, m1, m2) from an array of lines; an odd last line gets an empty second one, or is dropped."""
    n = F.floor((F.size(parts) + (1 if keep_odd else 0)) / 2).cast("int")
    of = lambda i: F.struct(i.alias("couplet_index"), F.get(parts, i * 2 - 2).alias("m1"), F.coalesce(F.get(parts, i * 2 - 1), F.lit("")).alias("m2"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), of)).otherwise(F.array().cast("array<struct<couplet_index:int,m1:string,m2:string>>"))


def stanza_couplets(s: Column) -> Column:
    """Couplets of a text as it is typed in: blocks between blank lines, the first two lines of each; a single block is paired line by line,
    lines as they are."""
    blocks = F.filter(F.split(F.coalesce(s, F.lit("")), r"\n\s*\n"), lambda b: strip(b) != "")
    one = F.split(F.coalesce(s, F.lit("")), "\n")
    pair = lambda b, i: F.struct((i + 1).alias("couplet_index"), F.get(F.split(b, "\n"), F.lit(0)).alias("m1"), F.coalesce(F.get(F.split(b, "\n"), F.lit(1)), F.lit("")).alias("m2"))
    return F.when(F.size(blocks) > 1, F.transform(F.transform(blocks, strip), pair)).otherwise(couplets(one))


def first_couplet(s: Column) -> Column:
    """The first two lines joined by a blank; the only line; or an empty text."""
    return F.array_join(F.slice(lines(s), 1, 2), " ")


def digests(s: Column) -> dict[str, Column]:
    """The hashes in use for one text, by name."""
    return {
        "content_md5": F.md5(bulk_form(s)),
        "couplet_md5": F.md5(bulk_form(first_couplet(s))),
        "raw_sha256": F.sha2(s, 256),
        "form_sha256": F.sha2(text_form(s), 256),
        "letters_md5": F.md5(letters(F.lower(s))),
    }


def slug(s: Column) -> Column:
    s = F.regexp_replace(strip(F.lower(s)), rf"[^a-z0-9{BLANK}-]", "")
    return F.regexp_replace(s, rf"[{BLANK}-]+", "-")


def _count(s: Column, cls: str) -> Column:
    """How many characters are of a class."""
    return F.length(F.regexp_replace(s, f"[^{cls}]", ""))


def arabic_share(s: Column) -> Column:
    """Characters of the Arabic block among all; 0 for empty or null."""
    s = F.coalesce(s, F.lit(""))
    return F.coalesce(F.try_divide(_count(s, ARABIC), F.length(s)), F.lit(0.0))


def mostly_urdu(s: Column) -> Column:
    return arabic_share(s) > 0.3


def language(s: Column) -> Column:
    """urdu, roman, mixed, or unknown where there is no letter."""
    s = F.coalesce(s, F.lit(""))
    n = _count(s, r"\p{L}")
    return F.when(n == 0, "unknown").when(_count(s, ARABIC) / n > 0.3, "urdu").when(_count(s, "a-zA-Z") / n > 0.5, "roman").otherwise("mixed")


def is_urdu(s: Column) -> Column:
    return language(s) == "urdu"


def is_roman_urdu(s: Column) -> Column:
    return language(s) == "roman"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def translate_words(s: Column) -> Column:
    """English by whole phrase, else word by word; unknown words stay. Null: empty."""
    s = F.coalesce(squeeze(s), F.lit(""))
    each = F.array_join(F.transform(words(s), lambda w: F.coalesce(F.try_element_at(_map(fixed.URDU_ENGLISH), w), w)), " ")
    return F.coalesce(F.try_element_at(_map(fixed.PHRASES), s), each)


def tidy_english(s: Column) -> Column:
    """Without doubled "is of", double blanks made single once, the first letter large."""
    s = strip(s)
    for a, b in ((" is of", ""), (" of is", ""), ("  ", " ")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.when(F.length(s) > 1, F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000_000))).otherwise(s)


def _vowels(s: Column) -> Column:
    for a, b in (("aa", "a"), ("ee", "i"), ("oo", "u")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def roman_form(s: Column) -> Column:
    """Latin spelling in one form: lower case, letters and blanks only, long vowels short, single blanks."""
    s = F.regexp_replace(strip(F.lower(s)), rf"[^a-z{BLANK}]", "")
    return F.regexp_replace(_vowels(s), f"[{BLANK}]+", " ")


def _fold_key(k: str) -> str:
    return reduce(lambda s, ab: s.replace(*ab), (("aa", "a"), ("ee", "i"), ("oo", "u")), k)


def to_urdu(s: Column, fold_keys: bool = True, table: dict[str, str] | None = None) -> Column:
    """Latin words by dictionary; unknown ones stay. fold_keys: long vowels of the keys are shortened as those of the words are; without
    it, keys with long vowels never match."""
    table = table or fixed.ROMAN
    if fold_keys:
        table = {_fold_key(k): v for k, v in table.items()}
    return F.array_join(F.transform(words(s), lambda w: F.coalesce(F.try_element_at(_map(table), roman_form(w)), w)), " ")


def to_urdu_wide(s: Column) -> Column:
    """As to_urdu, with English words too; words with Arabic letters are left alone."""
    table = {_fold_key(k): v for k, v in (fixed.ROMAN | fixed.ENGLISH).items()}
    one = lambda w: F.when(w.rlike(f"[{ARABIC}]"), w).otherwise(F.coalesce(F.try_element_at(_map(table), _vowels(strip(F.lower(w)))), w))
    return F.array_join(F.transform(words(s), one), " ")


def letters_to_urdu(s: Column, longest_first: bool = True) -> Column:
    """Latin letters by table, one after the other: the longest groups first, or in the table's order (single letters first)."""
    keys = sorted(fixed.LATIN_LETTERS, key=len, reverse=True) if longest_first else list(fixed.LATIN_IN_ORDER)
    table = fixed.LATIN_LETTERS if longest_first else fixed.LATIN_IN_ORDER
    return reduce(lambda c, k: F.replace(c, F.lit(k), F.lit(table[k])), keys, F.lower(s) if longest_first else squeeze(F.lower(s)))


def ending(w: Column) -> Column:
    """The last three characters."""
    return F.when(F.length(w) > 3, F.right(w, F.lit(3))).otherwise(w)


def verse_text(m1: Column, m2: Column) -> Column:
    """Both lines, or the first where the second is empty or null."""
    return F.when(F.coalesce(m2, F.lit("")) != "", F.concat_ws("\n", m1, m2)).otherwise(m1)


def contains_any(s: Column, keys: list[str]) -> Column:
    return F.coalesce(s, F.lit("")).rlike("|".join(map(re.escape, keys)))


def like(s: Column, key: str) -> Column:
    """Case-insensitive substring; % and _ in the key are wild, as they are passed on."""
    return F.coalesce(s.ilike(f"%{key}%"), F.lit(False))
