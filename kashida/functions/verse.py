"""Functions on lines of verse: syllables, metre, theme, emotion, vowel counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import contains_any, letters, tokens, words


def syllables(w: Column) -> Column:
    """Long vowels of a word, at least 1; 0 for an empty word."""
    return F.when(w == "", 0).otherwise(F.greatest(F.length(F.regexp_replace(w, f"[^{fixed.LONG_VOWELS}]", "")), F.lit(1)))


def metre_pattern(line: Column) -> Column:
    """One letter per word, L for two syllables or more, S for fewer, at most 12. Null: empty."""
    marks = F.transform(tokens(letters(F.coalesce(line, F.lit("")))), lambda w: F.when(syllables(w) >= 2, "L").otherwise("S"))
    return F.substring(F.array_join(marks, ""), 1, 12)


def metre_class(pattern: Column) -> Column:
    """struct(name, confidence): a known pattern 0.8, one that begins with a known pattern's first four 0.5, else Unknown 0.3; empty 0."""
    of = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(c).alias("confidence"))
    out = F.when(pattern == "", of("Unknown", 0.0))
    for k, n in fixed.METRES.items():
        out = out.when(pattern == k, of(n, 0.8))
    for k, n in fixed.METRES.items():
        out = out.when(pattern.startswith(k[:4]), of(n, 0.5))
    return out.otherwise(of("Unknown", 0.3))


def theme(s: Column) -> Column:
    """The first theme of which a word stands in the text, else general."""
    out = F
    for name, keys in fixed.THEMES.items():
        out = out.when(contains_any(s, keys), name)
    return out.otherwise("general")


def emotions(s: Column) -> dict[str, Column]:
    """Whether each emotion shows; a text may show several."""
    return {name: contains_any(s, keys) for name, keys in fixed.EMOTIONS.items()}


def vowel_count(s: Column, blanks: bool = False) -> Column:
    """Characters that are vowel letters; blanks: blanks count with them."""
    return F.length(F.regexp_replace(s, f"[^{fixed.VOWELS}{' ' if blanks else ''}]", ""))


def length_class(total: Column) -> Column:
    """A metre by the number of characters of a text's lines."""
    return F.when(total < 120, "short").when(total < 250, "medium").otherwise("long")


def vowel_class(mean: Column) -> Column:
    return F.when(mean.isNull(), "unknown").when(mean < 5, "short (khafif)").when(mean < 9, "medium (hazaj)").otherwise("long (muzari)")


def opening_pattern(m2: Column) -> Column:
    """Vowels of the first three words of a line, at least 1 each, joined by hyphens."""
    return F.array_join(F.transform(F.slice(words(m2), 1, 3), lambda w: F.greatest(vowel_count(w), F.lit(1)).cast("string")), "-")


def regularity(second: Column) -> Column:
    """From the array of the first three second lines: regular with their pattern if two or more have the same, else irregular."""
    p = F.transform(F.filter(second, lambda m: F.coalesce(m, F.lit("")) != ""), opening_pattern)
    p = F.filter(p, lambda x: x != "")
    same = (F.size(p) >= 2) & (F.size(F.array_distinct(p)) == 1)
    return F.when(same, F.concat(F.lit("regular_"), F.get(p, F.lit(0)))).otherwise("irregular")
