"""Counts, pages, navigation and first verses of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import verse_text
from ..sources.tables import first_per


def of_form(texts: DataFrame, forms: list[str]) -> DataFrame:
    """Texts of these forms; all where the table has no such column."""
    return texts.where(F.col("form").isin(forms)) if "form" in texts.columns else texts


def totals(poets: DataFrame, texts: DataFrame, verses: DataFrame, forms: list[str]) -> DataFrame:
    """One row: poets, texts of the forms, verses. Each is counted for itself; the three single rows are put side by side."""
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(poets, "poets").crossJoin(count(of_form(texts, forms), "texts")).crossJoin(count(verses, "verses"))


def directory(poets: DataFrame, texts: DataFrame, form: str) -> DataFrame:
    """Every poet with the number of texts of the form, none included. Texts are counted before the join."""
    n = texts.where(F.col("form") == form).groupBy(F.col("poet_id").alias("id")).agg(F.count("id").alias("n"))
    return poets.select("id", "name", "name_urdu", "birth_year", "death_year").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distinct_verses(verses: DataFrame) -> DataFrame:
    """Each (text_id, couplet_index) once; of differing rows the smallest."""
    cols = ["misra1_urdu", "misra2_urdu", "misra1_english", "misra2_english"]
    return verses.groupBy("text_id", "couplet_index").agg(F.min(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in cols))).alias("v")).select("text_id", "couplet_index", *(f"v.{c}" for c in cols))


def opening(verses: DataFrame, n: int = 2) -> DataFrame:
    """(text_id, c1_m1, c1_m2, c2_m1, ...): the first n couplets of each text, missing ones null."""
    rows = first_per(distinct_verses(verses).drop("misra1_english", "misra2_english"), ["text_id"], [F.col("couplet_index").asc_nulls_last()], n)
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return rows.groupBy("text_id").agg(*(pick(k, f"misra{m}_urdu").alias(f"c{k}_m{m}") for k in range(1, n + 1) for m in (1, 2)))


def page(rows: DataFrame, order: list[Column], number: int, per: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * per).limit(per)


def page_numbers(total: Column, number: int, per: int) -> dict[str, Column]:
    """Number of pages, the previous and the next one (null at the ends)."""
    pages = F.ceil(total / per)
    return {"pages": pages, "previous": F.when(F.lit(number) > 1, F.lit(number - 1)), "next": F.when(F.lit(number) < pages, F.lit(number + 1))}


def poet_page(texts: DataFrame, verses: DataFrame, poet_id: int, number: int, per: int = 12, form: str = "ghazal") -> DataFrame:
    """One page of a poet's texts by id, each with its first two couplets and the page numbers."""
    own = texts.where((F.col("poet_id") == poet_id) & (F.col("form") == form)).select("id", "title_urdu", "title_english")
    total = own.agg(F.count("*").alias("total"))
    rows = page(own, [F.col("id")], number, per).join(opening(verses.join(page(own, [F.col("id")], number, per).select(F.col("id").alias("text_id")), "text_id", "left_semi")), F.col("id") == F.col("text_id"), "left").drop("text_id")
    return rows.crossJoin(F.broadcast(total)).select("*", *(c.alias(n) for n, c in page_numbers(F.col("total"), number, per).items()))


def sample_couplets(poets: DataFrame, texts: DataFrame, verses: DataFrame, form: str = "ghazal") -> DataFrame:
    """Every poet with the first verse of their first text of the form, or a sign where there is none."""
    firsts = distinct_verses(verses).join(texts.where(F.col("form") == form).select(F.col("id").alias("text_id"), "poet_id"), "text_id")
    low = firsts.groupBy("poet_id").agg(F.min(F.struct("text_id", "couplet_index", "misra1_urdu", "misra2_urdu")).alias("v"))
    return poets.select("id", "name").join(low, F.col("id") == F.col("poet_id"), "left").select("id", "name", F.coalesce(F.when(F.col("v").isNotNull(), verse_text(F.col("v.misra1_urdu"), F.col("v.misra2_urdu"))), F.lit(fixed.NO_COUPLET)).alias("couplet"))


def navigation(texts: DataFrame, form: str = "ghazal", width: int = 65_536) -> DataFrame:
    """Of every text the previous and next one of its poet by id, and how many the poet has.

    Neighbours are looked up within ranges of `width` ids, so a poet with a third of all texts is spread over many tasks; only the ends
    of the ranges, one row each, are then put in order within a poet.
    """
    t = texts.where(F.col("form") == form).select("id", "poet_id", F.floor(F.col("id") / width).alias("_r"))
    poet = Window.partitionBy("poet_id")
    ends = t.groupBy("poet_id", "_r").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    ends = ends.select("poet_id", "_r", F.lag("hi").over(poet.orderBy("_r")).alias("before"), F.lead("lo").over(poet.orderBy("_r")).alias("after"), F.sum("n").over(poet).alias("total"))
    near = Window.partitionBy("poet_id", "_r").orderBy("id")
    e = ends.select(F.col("poet_id").alias("_p"), F.col("_r").alias("_e"), "before", "after", "total")
    j = t.withColumn("a", F.lag("id").over(near)).withColumn("b", F.lead("id").over(near)).join(e, F.col("poet_id").eqNullSafe(F.col("_p")) & (F.col("_r") == F.col("_e")))
    return j.select("id", "poet_id", F.coalesce("a", "before").alias("previous_id"), F.coalesce("b", "after").alias("next_id"), "total")


def first_and_last(verses: DataFrame) -> DataFrame:
    """(text_id, couplet_index, is_first, is_last): ends are found by pre-aggregated minima and maxima, not by sorting a text's verses."""
    v = verses.select("text_id", "couplet_index").distinct()
    ends = v.groupBy("text_id").agg(F.min("couplet_index").alias("lo"), F.max("couplet_index").alias("hi"))
    return v.join(ends, "text_id").select("text_id", "couplet_index", (F.col("couplet_index") == F.col("lo")).alias("is_first"), (F.col("couplet_index") == F.col("hi")).alias("is_last"))


def recent(texts: DataFrame, poets: DataFrame, verses: DataFrame, n: int = 10, form: str = "ghazal") -> DataFrame:
    """The latest texts that have a first couplet, with it. The verses of other couplets are not read on."""
    first = distinct_verses(verses.where(F.col("couplet_index") == 1))
    rows = texts.where(F.col("form") == form).select("id", "poet_id", "title_urdu", "created_at").join(first, F.col("id") == F.col("text_id")).join(poets.select(F.col("id").alias("poet_id"), F.col("name").alias("poet_name")), "poet_id")
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(n).select("id", "title_urdu", "poet_name", "created_at", "misra1_urdu", "misra2_urdu")


def in_order(verses: DataFrame, line: Column, between: str, as_: str, piece: int = 4096) -> DataFrame:
    """(text_id, as_): the lines of each text put together in the order of couplet_index. Pieces of `piece` couplet numbers are put
    together first, so that no task sorts the couplets of a text that holds a third of all."""
    rows = verses.select("text_id", "couplet_index", F.floor(F.col("couplet_index") / piece).alias("_p"), line.alias("_l"))
    of = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_l"))), lambda x: x["_l"]), between)
    return rows.groupBy("text_id", "_p").agg(of("couplet_index").alias("_l")).groupBy("text_id").agg(of("_p").alias(as_))


def share_texts(texts: DataFrame, poets: DataFrame, verses: DataFrame, giver: str = "", receiver: str = "", closing: str = "") -> DataFrame:
    """(text_id, share): the poet's name in capitals, underlined, an optional dedication, and the couplets."""
    v = in_order(distinct_verses(verses), F.concat("misra1_urdu", F.lit("\n"), "misra2_urdu", F.lit("\n\n")), "", "body")
    name = F.upper(F.coalesce("name", F.lit("")))
    to = (f"From: {giver}\n" if giver else "") + (f"To: {receiver}\n" if receiver else "") + "\n"
    rows = texts.select(F.col("id").alias("text_id"), "poet_id").join(poets.select(F.col("id").alias("poet_id"), "name"), "poet_id").join(v, "text_id", "left")
    return rows.select("text_id", F.concat(name, F.lit("\n"), F.repeat(F.lit("-"), F.length(name)), F.lit("\n\n" + to), F.coalesce("body", F.lit("")), F.lit(closing)).alias("share"))


def random_text(texts: DataFrame, seed: int) -> DataFrame:
    """One text that is not deleted, by a seeded hash: the smallest of all, so nothing is sorted."""
    return texts.where("is_deleted IS NULL OR NOT is_deleted").agg(F.min_by("id", F.struct(F.xxhash64(F.lit(seed), "id"), "id")).alias("id"))
