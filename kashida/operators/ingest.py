"""Uploads to texts: blocks, hashes, duplicate flags, rows of texts and verses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import couplets, digests, first_couplet, letters, lines
from ..sources.files import blocks
from ..sources.tables import number


def read_blocks(uploads: DataFrame, blank_lines: bool = False) -> DataFrame:
    """(upload_id, block, text) of uploads (upload_id, text): every text of two lines or more."""
    b = uploads.select("upload_id", F.posexplode(blocks(F.col("text"), blank_lines)).alias("block", "text"))
    return b.where(F.size(lines(F.col("text"))) >= 2)


def hashed(items: DataFrame, text: str) -> DataFrame:
    """items with content_md5 and couplet_md5 of a text column."""
    d = digests(F.col(text))
    return items.withColumns({c: d[c] for c in ("content_md5", "couplet_md5")})


def flagged(items: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """items (key, content_md5, couplet_md5) with dup_content, dup_couplet and dup_in_batch.

    The two hashes are looked up by two equi-joins, each against the distinct hashes of texts: a condition with OR would compare all rows
    with all. dup_in_batch marks items whose content an earlier item of the batch has; first items come from a pre-aggregated minimum.
    """
    have = lambda c, as_: texts.where(F.col(c).isNotNull()).select(F.col(c).alias(as_)).distinct().withColumn(f"_{as_}", F.lit(True))
    first = items.groupBy("content_md5").agg(F.min(key).alias("_first"))
    j = items.join(have("content_hash", "content_md5"), "content_md5", "left").join(have("first_couplet_hash", "couplet_md5"), "couplet_md5", "left").join(first, "content_md5", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.withColumn("dup_content", yes("_content_md5")).withColumn("dup_couplet", yes("_couplet_md5")).withColumn("dup_in_batch", F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_content_md5", "_couplet_md5", "_first")


def accept(items: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The items whose content and first couplet no text has, each content once."""
    return flagged(items, texts, key).where("NOT dup_content AND NOT dup_couplet AND NOT dup_in_batch")


def new_rows(items: DataFrame, texts: DataFrame, text: str, key: str, form: str = "ghazal") -> tuple[DataFrame, DataFrame]:
    """(texts, verses) rows of accepted items (poet_id, contributor_id and the text): ids follow the greatest one; the public id is derived
    from the content, so a repeated run gives the same rows."""
    start = texts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    t = number(items, start, [key]).withColumn("_lines", lines(F.col(text)))
    rows = t.select("id", F.substring(F.sha2(F.col(text), 256), 1, 8).alias("public_id"), "poet_id", "contributor_id", F.substring(F.get("_lines", F.lit(0)), 1, 100).alias("title_urdu"), F.col(text).alias("text_urdu"), F.lit(form).alias("form"), F.ceil(F.size("_lines") / 2).cast("int").alias("verse_count"), F.col("content_md5").alias("content_hash"), F.col("couplet_md5").alias("first_couplet_hash"), letters(F.col(text)).alias("normalized_text"), F.lit(False).alias("nlp_processed"))
    v = t.select(F.col("id").alias("text_id"), F.explode(couplets(F.col("_lines"))).alias("c")).select("text_id", F.col("c.couplet_index").alias("couplet_index"), F.col("c.m1").alias("misra1_urdu"), F.col("c.m2").alias("misra2_urdu"))
    return rows, v


def copies(texts: DataFrame) -> DataFrame:
    """(id, first_id, n) of texts whose upload form has the same hash: the smallest id and how many; n is pre-aggregated."""
    h = texts.where("text_urdu IS NOT NULL").select("id", digests(F.col("text_urdu"))["content_md5"].alias("h"))
    g = h.groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return h.join(g, "h").select("id", "first_id", "n")


def text_hashes(texts: DataFrame) -> DataFrame:
    return texts.where("text_urdu IS NOT NULL").select("id", *(c.alias(n) for n, c in digests(F.col("text_urdu")).items()), F.md5(first_couplet(F.col("text_urdu"))).alias("opening_md5"))

