"""What the operators share: reading tables, cutting lineage, assembling the bodies of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, shared  # noqa: F401

#: Couplets in one piece of a body that only verses hold. A text of more couplets comes in several pieces, so that no task has
#: to hold a text of any length.
PIECE = 4096
#: Couplets that a piece sees of the next one.
OVERLAP = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder for written tables beside the checkpoints."""
    return shared(spark, name)


def holds(text: Column | str) -> Column:
    """Whether a text holds a letter at all (null: no)."""
    return F.coalesce(F.col(text).rlike(r"\p{L}") if isinstance(text, str) else text.rlike(r"\p{L}"), F.lit(False))


def bodies(texts: DataFrame, verses: DataFrame, piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, part, body, tail): the body of every text that has one.

    texts: id, text_urdu; verses: text_id, couplet_index, misra1_urdu, misra2_urdu; further columns are ignored. The body is
    text_urdu; where that is null, the verse rows, each (text_id, couplet_index) once (of differing rows the smallest), in couplet
    order, every non-blank misra on its own line. Texts with neither, and rows without id, give no row. A text of verses that reaches
    over several pieces of `piece` couplet numbers comes in these, part being true and tail the beginning of the next piece; all others
    are one row with an empty tail.
    """
    own = texts.where(F.col("id").isNotNull() & F.col("text_urdu").isNotNull()).select(F.col("id").cast("long").alias("id"), F.lit(0).alias("piece"), F.lit(False).alias("part"), F.col("text_urdu").alias("body"), F.lit("").alias("tail"))
    need = texts.where(F.col("id").isNotNull() & F.col("text_urdu").isNull()).select(F.col("id").cast("long").alias("id")).distinct()
    rows = verses.select(F.col("text_id").cast("long").alias("id"), F.coalesce(F.col("couplet_index"), F.lit(0)).alias("k"), F.col("misra1_urdu").alias("a"), F.col("misra2_urdu").alias("b"))
    n = F.greatest(F.floor(F.col("k") / piece), F.lit(0)).cast("int")
    both = F.when((n > 0) & (F.col("k") % piece < overlap), F.array(F.struct(n.alias("p"), F.lit(False).alias("t")), F.struct((n - 1).alias("p"), F.lit(True).alias("t")))).otherwise(F.array(F.struct(n.alias("p"), F.lit(False).alias("t"))))
    rows = rows.join(need, "id", "left_semi")
    reach = rows.groupBy("id").agg((F.min(n) < F.max(n)).alias("part"))
    rows = rows.withColumn("at", F.explode(both))
    # a set: repeated rows collapse before the shuffle, so a group is bounded by the couplets of its piece
    got = rows.groupBy("id", F.col("at.p").alias("piece")).agg(F.array_sort(F.collect_set(F.struct(F.col("at.t").alias("t"), "k", "a", "b"))).alias("v"))
    once = "filter(v, (x, i) -> i = 0 OR x.t <> v[i - 1].t OR x.k <> v[i - 1].k)"

    def lines(tail: str) -> Column:
        return F.expr(rf"array_join(filter(flatten(transform(filter({once}, x -> x.t = {tail}), x -> array(x.a, x.b))), l -> l IS NOT NULL AND l RLIKE '\\S'), '\n')")

    return own.unionByName(got.select("id", "piece", lines("false").alias("body"), lines("true").alias("tail")).join(reach, "id").where("NOT part OR body <> ''").select("id", "piece", "part", "body", "tail"))
