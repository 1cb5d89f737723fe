"""Mixing sources to target shares of the total size in tokens (problem 9): capped water-filling and seeded repetition."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

#: The folder of the public tokenizers' files, and the file used unless another is named.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before byte-pair merges in this family of vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Sources in a table of targets, at most: it is held on the driver.
MOST_SOURCES = 100_000
#: Parts of a source, by a seeded hash; all but one of them are taken or left whole.
PARTS = 1024

_encoders: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, source, tokens) of documents (doc_id, text, source); null texts have none. path: a vocabulary of byte-pair ranks that
    the driver can read; it is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(SparkFiles.get(name)).encode_ordinary
        for b in it:
            n = [len(count(x)) if x else 0 for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(of, "doc_id long, source string, tokens long")


def water_fill(targets: list[tuple[str, float, int, int]], total: float | None = None) -> dict[str, float]:
    """The tokens that each source gives. targets: (source, share, most repeats, available tokens).

    Shares are made to sum to 1. A source whose share of the total is more than available * repeats is clamped there, and what it cannot
    give is spread over the others in proportion to their shares, until all fit. total: the wanted size; unless given, the available
    size of the sources, so that the mix is about as large as they are. Sources without share, tokens or repeats give nothing; if all
    are clamped, the mix is smaller than wanted.
    """
    live = {s: (w, m * n) for s, w, m, n in targets if w and w > 0 and m and m > 0 and n and n > 0}
    out = {s: 0.0 for s, *_ in targets}
    left = float(sum(n for s, _, _, n in targets if s in live) if total is None else total)
    while live and left > 0:
        weight = sum(w for w, _ in live.values())
        over = [s for s, (w, cap) in live.items() if left * w / weight > cap]
        if not over:
            return out | {s: left * w / weight for s, (w, _) in live.items()}
        # all clamped sources of a round go out together: what they leave only raises the others' parts
        for s in over:
            out[s] = float(live.pop(s)[1])
        left -= sum(out[s] for s in over)
    return out


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, tokens, copies) of every document that is used, the report by source).

    documents: doc_id, text, source; targets: source, target_share, max_repeats, one row per source (of several the first in order
    counts). Every document of a source is repeated as many whole times as its allotment holds the source; for the rest, documents are
    taken in the order of a seeded hash, until the tokens are as near to the allotment as whole documents allow. No document is used
    more than max_repeats times. Documents without source, or of one that is not in targets, belong to none.

    The report has, for every source in targets: documents and tokens available, tokens allotted and used, and the shares.
    """
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = documents.sparkSession
    docs = cut(token_counts(documents, path).where("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0").withColumn("order", F.xxhash64(F.lit(seed), "doc_id")))
    parts = cut(docs.groupBy("source", F.pmod("order", F.lit(PARTS)).cast("int").alias("part")).agg(F.sum("tokens").alias("size"), F.count("*").alias("n")))
    known = spark.createDataFrame([(r.source, r.target_share, r.max_repeats) for r in rows], "source string, target_share double, max_repeats int")
    sizes = {r.source: (r.size, r.n) for r in parts.join(F.broadcast(known), "source", "left_semi").groupBy("source").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()}
    fill = water_fill([(r.source, r.target_share, r.max_repeats, sizes.get(r.source, (0, 0))[0]) for r in rows], total)
    plan = []
    for r in rows:
        n = sizes.get(r.source, (0, 0))[0]
        times = min(int(fill[r.source] // n), r.max_repeats) if n else 0
        plan.append((r.source, times, fill[r.source] - times * n if n and times < r.max_repeats else 0.0, fill[r.source]))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, times int, rest double, allotted double"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of each source, the parts below the rest whole, one in part; at most PARTS rows a source
    cuts = parts.withColumn("before", before).join(plan_df, "source").withColumn("state", F.when(F.col("before") + F.col("size") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    docs = docs.withColumn("part", F.pmod("order", F.lit(PARTS)).cast("int")).join(cuts.select("source", "part", "before", "state", "times", "rest"), ["source", "part"])
    whole: Column = F.col("times") + F.when(F.col("state") == 2, 1).otherwise(0)
    easy = docs.where("state <> 1").select("doc_id", "source", "tokens", whole.alias("copies"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("order", "doc_id"))
    edge = docs.where("state = 1").withColumn("upto", F.col("before") + upto)
    edge = edge.select("doc_id", "source", "tokens", (F.col("times") + (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int")).alias("copies"))
    used = easy.unionByName(edge).where("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    have = spark.createDataFrame([(r.source, float(r.target_share) if r.target_share is not None else None, r.max_repeats, *sizes.get(r.source, (0, 0)), float(fill[r.source])) for r in rows], "source string, target_share double, max_repeats int, tokens long, documents long, allotted double")
    all_used = got.agg(F.sum("used_tokens").alias("all"))  # one row
    report = have.join(got, "source", "left").crossJoin(F.broadcast(all_used)).select("source", "target_share", "max_repeats", "documents", "tokens", F.round("allotted", 3).alias("allotted"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.try_divide("used_tokens", "all"), F.lit(0.0)), 6).alias("share"))
    return used, report
