"""Similarity of vectors, sets and short strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """dot / (norms + 1e-8); 0 if either is null or empty."""
    c = dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + 1e-8)
    return F.when((F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0), 0.0).otherwise(c)


def cosine_exact(a: Column, b: Column) -> Column:
    """dot / norms; 0 if either norm is."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(all_, F.lit(1)))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as binary arithmetic does it, halves away from zero: 4.015, which is stored a little smaller, becomes 4.01. Spark's
    own round takes the shortest decimal spelling for the number, and gives 4.02. The sign of zero stays, and what is not finite or too
    large to be scaled."""
    scaled = x * float(10**digits)
    near = F.rint(scaled)
    near = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / float(10**digits)
    return F.when(F.abs(near) < float("inf"), near).otherwise(x)


def rhyme_overlap(a: Column, b: Column) -> Column:
    """Common rhyme words by the longer list; 0 if either is empty or null."""
    return F.when((F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def trigrams(s: Column) -> Column:
    """The set of three-letter sequences of the words, each with two blanks before and one after it."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), of)))


def may_share_trigrams(s: Column, query: str) -> Column:
    """Whether a string has any trigram of the query: true where it has one, and a match of a pattern instead of sets of trigrams."""
    parts = set()
    for w in re.findall(r"[^\W_]+", query.lower()):
        padded = f"  {w} "
        for i in range(len(w) + 1):
            g = padded[i : i + 3]
            parts.add((r"(?<![\p{L}\p{N}])" if g[0] == " " else "") + re.escape(g.strip()) + (r"(?![\p{L}\p{N}])" if g[-1] == " " else ""))
    return F.lower(F.coalesce(s, F.lit(""))).rlike("|".join(sorted(parts))) if parts else F.lit(False)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))
