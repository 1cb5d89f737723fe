"""Queries on texts and verses (problems 1 to 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copies, history, neardup, terms
from .frames import bodies, table


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return bodies(table(spark, d, "texts"), table(spark, d, "verses"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_bodies(spark, d)).select("group_id", F.col("id").alias("text_id"))


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.representatives(_bodies(spark, d)).select(F.col("id").alias("text_id"), "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.look_alikes(_bodies(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return copies.look_classes(_bodies(spark, d)).withColumnRenamed("id", "text_id")


def p3_verses(spark: SparkSession, d: str) -> DataFrame:
    """Every verse row with its misras in the consistent form."""
    v = table(spark, d, "verses").select("text_id", "couplet_index", "misra1_urdu", "misra2_urdu")
    return copies.consistent(v, ["misra1_urdu", "misra2_urdu"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions of one poem: three-word sequences and a likeness of 0.6, as TESTDATA.md states."""
    return neardup.all_pairs(*neardup.near_duplicates(_bodies(spark, d), n=3, threshold=0.6))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.classes(*neardup.near_duplicates(_bodies(spark, d), n=3, threshold=0.6)).withColumnRenamed("id", "text_id")


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words = terms.term_counts(table(spark, d, "texts"), "text_urdu")
    radif = terms.term_counts(terms.latest(table(spark, d, "poetic_features"), "text_id", "created_at", "radif"), "radif", whole=True)
    return terms.marked(words, 2, 0.2), terms.marked(radif, 2, 0.02)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    both = [x.select(F.lit(f).alias("field_name"), "term", F.explode("marks").alias("mark")) for f, x in zip(("text_urdu", "radif"), _terms(spark, d))]
    return both[0].unionByName(both[1])


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    both = [x.select(F.lit(f).alias("field_name"), "term", "occurrences", "records", F.concat_ws(",", "marks").alias("marks")) for f, x in zip(("text_urdu", "radif"), _terms(spark, d))]
    return both[0].unionByName(both[1])


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Terms of one to five words of the texts."""
    return terms.term_counts(table(spark, d, "texts"), "text_urdu", most=5).where("n > 0")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that bring nothing new: three-word sequences and a likeness of 0.6, as TESTDATA.md states."""
    status, _ = history.new_items(table(spark, d, "bulk_preview"), _bodies(spark, d), table(spark, d, "verses"), n=3, threshold=0.6)
    return status.where("status = 'case'").select(F.col("id").alias("item_id"))


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same, the items coming as two batches, the lower half of their ids first: the second is held against the table that the first
    left, and no text of the history is read for it."""
    items = table(spark, d, "bulk_preview")
    half = items.agg(F.percentile_approx("item_id", 0.5)).first()[0]
    later = F.col("item_id") > F.lit(half)
    one, kept = history.new_items(items.where(~later), _bodies(spark, d), table(spark, d, "verses"), n=3, threshold=0.6)
    two, _ = history.new_items(items.where(later), None, None, n=3, threshold=0.6, table=kept)
    return one.unionByName(two).where("status = 'case'").select(F.col("id").alias("item_id"))
