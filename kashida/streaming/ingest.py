"""Uploads as a stream: each content once, then the same set-based steps as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import couplets, lines
from ..operators import keeping
from ..operators.ingest import hashed
from ..operators.verse import metres, refrains, seconds
from ..sources.files import blocks
from ..sources.store import Store


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(upload_id, text, arrived_at): text files as they come in, each whole."""
    return spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("upload_id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived_at"))


def fresh_blocks(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Blocks of uploads with hashes, each content once within the lateness; state older than that is dropped."""
    b = _blocks(stream)
    return hashed(b, "text").withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["content_md5"])


def _blocks(stream: DataFrame) -> DataFrame:
    return stream.select("arrived_at", "upload_id", F.posexplode(blocks(F.col("text"))).alias("block", "text")).where(F.size(lines(F.col("text"))) >= 2)


def each_batch(stream: DataFrame, store: Callable[[DataFrame, DataFrame, int], None]) -> DataStreamWriter:
    """Hands every micro-batch's items and their features to `store`, which must be safe to repeat for one batch number."""
    def run(items: DataFrame, number: int) -> None:
        items = items.persist()
        try:
            rows = items.select(F.col("content_md5").alias("text_id"), lines(F.col("text")).alias("l"))
            v = rows.select("text_id", F.explode(couplets(F.col("l"))).alias("c")).select("text_id", F.col("c.couplet_index").alias("couplet_index"), F.col("c.m1").alias("misra1_urdu"), F.col("c.m2").alias("misra2_urdu"))
            store(items, refrains(seconds(v)).join(metres(v), "text_id"), number)
        finally:
            items.unpersist()

    return stream.writeStream.foreachBatch(run)


def into_store(stream: DataFrame, store: Store) -> DataStreamWriter:
    """Appends every micro-batch's new texts to a store and analyses them, by the same steps as in batch: duplicates are told from all
    stored texts, not only from late ones. A batch that comes twice finds its texts stored, so nothing is appended anew."""
    def run(items: DataFrame, number: int) -> None:  # noqa: ARG001
        given = items.withColumns({c: F.lit(None).cast("long") for c in ("poet_id", "contributor_id") if c not in items.columns})
        keeping.accept(store, given.withColumn("key", F.struct("arrived_at", "upload_id", "block")), "text", "key")
        keeping.analyse(store)

    return stream.writeStream.foreachBatch(run)


def activity(events: DataFrame, length: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes", on: str = "ts") -> DataFrame:
    """Events per window and type; windows close when the watermark passes them."""
    w = F.window(on, length, slide) if slide else F.window(on, length)
    return events.withWatermark(on, lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes", on: str = "ts") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return events.withWatermark(on, lateness).groupBy(F.session_window(on, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
