"""Tables in a folder of Parquet files: scans, lookups, and writes that keep keys unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..schema import SCHEMAS


class Tables:
    """The tables of a folder, by attribute: Tables(spark, folder).texts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def from_database(spark: SparkSession, url: str, table: str, key: str, parts: int = 64, **options: str) -> DataFrame:
    """A table of a database, read in `parts` ranges of its key at once."""
    low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({key}), max({key}) FROM {table}", **options).load().first()
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of greatest version of each key (nulls first); of equal versions the greatest row, so repeated rows collapse.

    Maxima are combined before the shuffle: a key with any number of versions sends one row from each task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*version, *(c for c in rest if c not in version))
    return df.groupBy(*keys).agg(F.max(order).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Last write wins: new rows stand above old ones of the same version."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*version, "_new"]).drop("_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the distinct rows of new whose keys it lacks; null keys equal null."""
    on: Column = F.lit(True)
    marked = old.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    fresh = new.dropDuplicates(keys)
    for k in keys:
        on = on & fresh[k].eqNullSafe(F.col(f"_{k}"))
    return old.unionByName(fresh.join(marked, on, "left_anti"))


def number(rows: DataFrame, start: int, order: list[str], key: str = "id") -> DataFrame:
    """rows with ids from start + 1 on, in order. Ranges are numbered one by one after their sizes are known, so no task sees all rows.
    The ranges are stored first: drawn anew after a loss, they might differ, and ids clash."""
    spark = rows.sparkSession
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()  # a row a partition
    at, table = start, []
    for r in sizes:
        table.append((r["_part"], at + 1 - r["first"]))
        at += r["n"]
    shift = spark.createDataFrame(table, "_part int, _shift long")
    return parts.join(F.broadcast(shift), "_part").withColumn(key, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def get_or_create(dimension: DataFrame, facts: DataFrame, natural: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(dimension with a row for every natural key in facts, facts with the key). New keys follow the greatest old one, in natural order."""
    known = insert_missing(dimension.select(*natural), facts.select(*natural), natural).exceptAll(dimension.select(*natural))
    start = dimension.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    fresh = number(known, start, natural, key)
    table = dimension.unionByName(fresh, allowMissingColumns=True)
    on: Column = F.lit(True)
    ids = table.groupBy(*natural).agg(F.min(key).alias(key)).select(F.col(key), *(F.col(c).alias(f"_{c}") for c in natural))
    for c in natural:
        on = on & facts[c].eqNullSafe(F.col(f"_{c}"))
    return table, facts.join(ids, on, "left").drop(*(f"_{c}" for c in natural))


def rewrite(df: DataFrame, path: str) -> None:
    """Replaces a table by one built from it: written beside it first, so a failed job leaves the old one. Between the two renames the
    table is absent for a moment; where others read meanwhile, use store.Store, whose changes are atomic."""
    sc = df.sparkSession.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    target, fresh, old = (hadoop.Path(path + x) for x in ("", ".new", ".old"))
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank. Spark cuts each task's rows to n before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
