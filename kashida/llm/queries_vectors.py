"""Queries on vectors and names (problems 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import names, neighbours
from .frames import table


def _near(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ghazal_embeddings").select(F.col("text_id").alias("id"), F.col("embedding_vector").alias("vector"), "updated_at")
    return neighbours.nearest(rows, k=5, width=384)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).withColumnRenamed("id", "text_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.entities(table(spark, d, "contributors")))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "contributors")).withColumnRenamed("id", "contributor_id")
