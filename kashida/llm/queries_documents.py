"""Queries on documents (problems 8 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, mixing, quality
from .frames import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each leaked item lies in its document, and the share of the item that is there."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumn("share", F.round((F.col("end") - F.col("begin")) / F.col("item_words"), 6))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents that items leaked into, without what leaked."""
    docs = table(spark, d, "documents")
    return leaks.cleaned(docs, leaks.leaks(docs, table(spark, d, "eval_items"))).where("removed > 0")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents"), table(spark, d, "common_words")).where("junk > 0.5").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their numbers of copies."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, by source."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
