"""Keyword search, suggestions, faceted search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import like, tokens, verse_text, words
from ..functions.vectors import may_share_trigrams, trigram_similarity
from .catalogue import distinct_verses


def process_query(keyword: str) -> str:
    """A query's Latin words in Urdu, by dictionary; the few words of a query are turned on the driver."""
    table = {_short(k): v for k, v in fixed.ROMAN.items()}
    only = lambda w: "".join(c for c in w.lower() if "a" <= c <= "z")
    return " ".join(table.get(_short(only(w)), w) for w in keyword.split())


def _short(w: str) -> str:
    return reduce(lambda s, ab: s.replace(*ab), (("aa", "a"), ("ee", "i"), ("oo", "u")), w)


def matching(texts: DataFrame, verses: DataFrame, keyword: str = "", poet_id: int | None = None, contributor_id: int | None = None, form: str = "ghazal") -> DataFrame:
    """Texts of the form whose titles or any verse hold the keyword, as typed or turned to Urdu, and of the poet and contributor if given.

    The verses are read once for both spellings, and joined as a semi-join, so no text comes twice and verses never multiply rows.
    """
    rows = texts.where(F.col("form") == form)
    for c, x in (("poet_id", poet_id), ("contributor_id", contributor_id)):
        rows = rows.where(F.col(c) == x) if x is not None else rows
    keyword = keyword.strip()
    if not keyword:
        return rows
    keys = list(dict.fromkeys([keyword, process_query(keyword)]))
    any_of = lambda cols: reduce(lambda a, b: a | b, (like(F.col(c), k) for k in keys for c in cols))
    hits = verses.where(any_of(["misra1_urdu", "misra2_urdu"])).select(F.col("text_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    title: Column = any_of(["title_urdu"]) | like(F.col("title_english"), keyword)
    return rows.join(hits, "id", "left").where(title | F.col("hit").isNotNull()).drop("hit")


def search(texts: DataFrame, poets: DataFrame, verses: DataFrame, keyword: str = "", poet_id: int | None = None, contributor_id: int | None = None, offset: int = 0, limit: int = 20, form: str = "ghazal") -> DataFrame:
    """One page of matches, latest id first, with poet and first verse. Without any condition the result is empty."""
    found = matching(texts, verses, keyword, poet_id, contributor_id, form)
    if not keyword.strip() and poet_id is None and contributor_id is None:
        found = found.where("false")
    rows = found.select(F.col("id").alias("text_id"), "title_urdu", "title_english", "poet_id").join(poets.select(F.col("id").alias("poet_id"), F.col("name").alias("poet_name")), "poet_id")
    rows = rows.orderBy(F.desc("text_id")).offset(offset).limit(limit)
    # only the page's verses are joined
    first = distinct_verses(verses.where(F.col("couplet_index") == 1).join(rows.select("text_id"), "text_id", "left_semi"))
    return rows.join(first, "text_id", "left").select("text_id", "title_urdu", "title_english", "poet_name", verse_text(F.col("misra1_urdu"), F.col("misra2_urdu")).alias("first_verse"))


def total(texts: DataFrame, verses: DataFrame, **conditions) -> DataFrame:  # noqa: ANN003
    """The number of matches, those of unknown poets included."""
    return matching(texts, verses, **conditions).agg(F.count_distinct("id").alias("total"))


def suggestions(texts: DataFrame, verses: DataFrame, query: str, limit: int = 10, threshold: float = 0.2) -> DataFrame:
    """Distinct titles and first lines that hold the query, and first lines whose trigrams are like it, in order."""
    q = process_query(query)
    titles = texts.where(like(F.col("title_urdu"), q)).select(F.col("title_urdu").alias("suggestion"))
    lines = verses.select("misra1_urdu").where("misra1_urdu IS NOT NULL").distinct()
    lines = lines.where(like(F.col("misra1_urdu"), q) | (may_share_trigrams(F.col("misra1_urdu"), q) & (trigram_similarity(F.col("misra1_urdu"), F.lit(q)) > threshold)))
    return titles.unionByName(lines.select(F.col("misra1_urdu").alias("suggestion"))).distinct().orderBy("suggestion").limit(limit)


def fuzzy(verses: DataFrame, query: str, threshold: float = 0.2) -> DataFrame:
    """Distinct first lines whose trigrams are like the query, with the similarity."""
    lines = verses.select(F.col("misra1_urdu").alias("line")).where("misra1_urdu IS NOT NULL").distinct()
    lines = lines.where(may_share_trigrams(F.col("line"), query)) if threshold >= 0 else lines
    return lines.withColumn("similarity", F.round(trigram_similarity(F.col("line"), F.lit(query)), 6)).where(F.col("similarity") > threshold)


def faceted(texts: DataFrame, poets: DataFrame, features: DataFrame, keyword: str = "", radif: str = "", qaafiya: str = "", metre: str = "", theme: str = "", poet_id: int | None = None, limit: int = 50) -> DataFrame:
    """Texts by words of their body and by features; with a keyword by rank, else by id.

    features: one row per text. All words of the keyword must occur. The rank is the number of occurrences over 1 + ln of the length in
    words: an order of its own, not that of any database.
    """
    asked = list(dict.fromkeys(keyword.lower().split()))
    rows = texts.join(poets.select(F.col("id").alias("poet_id"), F.col("name").alias("poet_name")), "poet_id").join(features.select(F.col("text_id").alias("id"), "radif", "qaafiya", "meter_name", "theme"), "id", "left")
    if poet_id is not None:
        rows = rows.where(F.col("poet_id") == poet_id)
    for c, x in (("radif", radif), ("meter_name", metre), ("theme", theme)):
        rows = rows.where(F.col(c) == x) if x else rows
    if qaafiya:
        rows = rows.where(F.array_contains("qaafiya", qaafiya))
    rank: Column = F.lit(0.0)
    if asked:
        have = words(F.lower(F.col("text_urdu")))
        rows = rows.withColumn("_words", have).where(F.size(F.array_except(F.array(*map(F.lit, asked)), F.col("_words"))) == 0)
        rank = F.size(F.filter("_words", lambda w: w.isin(asked))) / (1 + F.log(F.size("_words").cast("double")))
    rows = rows.select(F.col("id"), "title_urdu", "poet_name", "radif", F.array_join("qaafiya", ",").alias("qaafiya"), "meter_name", "theme", F.round(rank, 6).alias("rank"))
    return rows.orderBy(F.desc("rank"), "id").limit(limit) if asked else rows.orderBy("id").limit(limit)


def top_words(texts: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n most frequent words of each key, ties by word, with their share of the most frequent one in per cent.

    Words are counted before the shuffle and again by (key, word), so a key with a third of all texts is spread over its words.
    """
    count = texts.select(*key, F.explode(tokens(F.col("text_urdu"))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))
    return ranked(count, key, "word", n)


def ranked(count: DataFrame, key: list[str], value: str, n: int) -> DataFrame:
    """Of counts (key, value, n) the first n of each key by number, then value, with rank and share of the first in per cent."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    top = count.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy(*key)) * 100).cast("long"))
