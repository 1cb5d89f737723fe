"""Near-duplicate texts (problem 4): a signature-coordinate inverted join, then an exact check on word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut
from .shingles import Batch, likeness, signatures
from .textforms import words

_WORDS = "id long, piece int, part boolean, n int, digest binary, words string, sig array<long>"


def read_words(pieces: DataFrame, n: int, coordinates: int = 0) -> DataFrame:
    """(id, piece, part, n, digest, words, sig) of (id, piece, part, body, tail): the words of each body in one string, the digest of that
    string, the number of distinct n-word sequences, and their signature. part marks texts in several pieces. Bodies without a word
    give no row; null bodies neither."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(i, p, part, w, words(tail)) for i, p, part, body, tail in zip(*(b.column(c).to_pylist() for c in ("id", "piece", "part", "body", "tail"))) if (w := words(body))]
            batch = Batch([r[3] for r in rows], [r[4] for r in rows], n)
            doc, s = batch.shingles()
            size = [0] * len(rows)
            sig: list = [None] * len(rows)
            for d, k in zip(*(x.tolist() for x in np.unique(doc, return_counts=True))):
                size[d] = k
            if coordinates:
                for d, x in zip(*(y.tolist() for y in signatures(doc, s, coordinates))):
                    sig[d] = x
            text = [" ".join(r[3]) for r in rows]
            digest = [xxhash.xxh3_128_digest(t.encode()) for t in text]
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], size, digest, text, sig]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int64())))], names=["id", "piece", "part", "n", "digest", "words", "sig"])

    return pieces.select("id", "piece", "part", "body", "tail").where("id IS NOT NULL AND body IS NOT NULL").mapInArrow(of, _WORDS)


@dataclass
class Texts:
    """Distinct word sequences. reps: (id, n, words, sig, copies), id the smallest of its copies, words null for texts in several
    pieces; members: (rep, id) of the sequences that several texts have; giants: (id, piece, words) of texts in several pieces."""

    reps: DataFrame
    members: DataFrame
    giants: DataFrame


def distinct_texts(rows: DataFrame, n: int, coordinates: int = 0) -> Texts:
    """Collapses equal word sequences. rows: as of read_words, computed once (see cut). A text in several pieces stays as it is; its
    n-word sequences are counted row by row, since pieces share some."""
    one = rows.where(~F.col("part"))
    # copies of a third of all rows are one row a task before the shuffle
    reps = one.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("words").alias("words"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    giants = rows.where("part")
    sig = F.array(*(F.min(F.col("sig")[i]) for i in range(coordinates))) if coordinates else F.lit(None).cast("array<bigint>")
    size = exploded(giants, True, n).groupBy("id").agg(F.count("*").cast("int").alias("n"))
    huge = giants.groupBy("id").agg(sig.alias("sig")).join(size, "id").select(F.lit(None).cast("binary").alias("digest"), "id", "n", F.lit(None).cast("string").alias("words"), "sig", F.lit(1).cast("long").alias("copies"))
    reps = cut(reps.unionByName(huge))
    members = one.select("digest", "id").join(reps.where("copies > 1").select("digest", F.col("id").alias("rep")), "digest").select("rep", "id").distinct()
    return Texts(reps.drop("digest"), members, giants.select("id", "piece", "words"))


def collisions(reps: DataFrame, threshold: float, coordinates: int, matches: int, hot: int = 256) -> DataFrame:
    """(a, b), a < b: pairs of reps (id, n, sig) that agree on at least `matches` coordinates and may be alike by their sizes.

    Documents are posted under each (coordinate, value), and the lists are merged: a pair is counted once in every list that holds both.
    Lists of over `hot` documents are skipped there. A pair with `matches` agreements of which one of the first coordinates - matches + 1
    is in a skipped list is found by posting that list's documents anew under each further coordinate, with both values as key, and so on
    until the keys have `matches` coordinates: documents of one such list agree on that many, so all its pairs of fitting size are
    wanted, and lists of over `hot` are joined in blocks, each pair of blocks under a key of its own. What is found in shorter keys, or
    counted too seldom while a document is in a skipped list, is decided by its signatures. No list is capped.
    """
    fit = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) if threshold > 0 else F.lit(True)

    def join(p: DataFrame) -> DataFrame:
        return p.select("key", F.col("id").alias("a"), F.col("n").alias("na")).join(p.select("key", F.col("id").alias("b"), F.col("n").alias("nb")), "key").where(F.col("a") < F.col("b")).where(fit).select("a", "b")

    def sizes(p: DataFrame) -> DataFrame:
        return cut(p.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot))

    posted = reps.select("id", "n", F.posexplode("sig").alias("c", "v")).select("id", "n", "c", F.xxhash64("c", "v").alias("key"))
    long = sizes(posted)
    if long.isEmpty():
        return join(posted).groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= matches).select("a", "b")
    counted = cut(join(posted.join(long, "key", "left_anti")).groupBy("a", "b").agg(F.count("*").alias("k")))
    busy = cut(posted.join(long, "key", "left_semi").select("id").distinct())
    sure = counted.where(F.col("k") >= matches).select("a", "b")
    doubtful = counted.where(F.col("k") < matches).select("a", "b").join(busy.select(F.col("id").alias("a")), "a", "left_semi").join(busy.select(F.col("id").alias("b")), "b", "left_semi")
    # agreements of a pair in order: its first is in a skipped list, or the pair is counted
    posted = posted.where(F.col("c") < coordinates - matches + 1)
    for depth in range(2, matches + 1):
        again = posted.join(long.select("key"), "key").join(reps.select("id", "sig"), "id")
        tail = F.posexplode(F.slice("sig", 1, coordinates - matches + depth)).alias("d", "v")
        posted = cut(again.select("id", "n", "c", "key", tail).where("d > c").select("id", "n", F.col("d").alias("c"), F.xxhash64("key", "d", "v").alias("key")))
        long = sizes(posted)
        short = join(posted.join(long.select("key"), "key", "left_anti"))
        if depth < matches:
            doubtful = doubtful.unionByName(short)
        else:
            blocks = F.ceil(F.col("size") / hot).cast("int")
            many = posted.join(long, "key").withColumn("x", F.pmod(F.xxhash64("id"), blocks)).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
            sure = sure.unionByName(short).unionByName(join(many.select("id", "n", F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"))))
    sig = reps.select("id", "sig")
    agree = F.size(F.filter(F.arrays_zip("sa", "sb"), lambda x: x["sa"] == x["sb"]))
    doubtful = doubtful.distinct().join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").where(agree >= matches).select("a", "b")
    return sure.unionByName(doubtful).distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose likeness, on the words themselves, is at least threshold. left and right: (id, words)."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list = [[], [], []]
            for x, y, u, v in zip(*(b.column(c).to_pylist() for c in ("a", "b", "u", "v"))):
                if (j := likeness(u.split(" "), v.split(" "), n)) >= threshold:
                    for o, z in zip(out, (x, y, j)):
                        o.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "likeness"])

    rows = pairs.join(left.select(F.col("id").alias("a"), F.col("words").alias("u")), "a").join(right.select(F.col("id").alias("b"), F.col("words").alias("v")), "b")
    return rows.where("u IS NOT NULL AND v IS NOT NULL").select("a", "b", "u", "v").mapInArrow(of, "a long, b long, likeness double")


def exploded(docs: DataFrame, tails: bool, n: int, whole: bool = False) -> DataFrame:
    """(id, s): the distinct n-word sequences, as hashes, of texts (id, piece, words), a row each: for texts of any length.
    whole: every text is one row, so that nothing is left to be made distinct."""
    if tails:
        head = F.lead(F.array_join(F.slice(F.split("words", " "), 1, n - 1), " ")).over(Window.partitionBy("id").orderBy("piece"))
        docs = docs.withColumn("tail", F.coalesce(head, F.lit("")))
    else:
        docs = docs.withColumn("tail", F.lit(""))

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, w, t = (b.column(c).to_pylist() for c in ("id", "words", "tail"))
            doc, s = Batch([x.split(" ") for x in w], [x.split() for x in t], n).shingles()
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(s.view("int64"))], names=["id", "s"])

    rows = docs.select("id", "words", "tail").mapInArrow(of, "id long, s long")
    return rows if whole else rows.distinct()


def verified_giants(pairs: DataFrame, texts: Texts, others: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, likeness) like verified, for pairs with a text in several pieces: sequences are joined row by row, no text is collected."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = others.where("words IS NOT NULL").join(ids, "id", "left_semi").select("id", F.lit(0).alias("piece"), "words")
    s = cut(exploded(texts.giants, True, n).unionByName(exploded(some, False, n)))
    size = s.groupBy("id").agg(F.count("*").alias("k"))
    both = pairs.join(s.withColumnRenamed("id", "a"), "a").join(s.withColumnRenamed("id", "b"), ["b", "s"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    j = F.col("both") / (F.col("ka") + F.col("kb") - F.col("both"))
    return both.join(size.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b").select("a", "b", j.alias("likeness")).where(F.col("likeness") >= threshold)


def near_duplicates(pieces: DataFrame, n: int = 5, threshold: float = 0.8, coordinates: int = 20, matches: int = 3) -> tuple[Texts, DataFrame]:
    """The distinct texts, and the links (a, b, likeness) between representatives of likeness >= threshold.

    pieces: as of frames.bodies. The likeness of two texts is the Jaccard index of their sets of n-word sequences. A pair of
    likeness 0.6 agrees on 12 of 20 coordinates on average; fewer than 3 agree once in 200,000 pairs. Signatures decide which pairs
    are held against each other, the words decide the result. Empty tables give empty results.
    """
    texts = distinct_texts(cut(read_words(pieces, n, coordinates)), n, coordinates)
    reps = texts.reps
    pairs = cut(collisions(reps, threshold, coordinates, matches))
    links = verified(pairs, reps, reps, n, threshold)
    if not texts.giants.isEmpty():
        huge = texts.giants.select(F.col("id").alias("g")).distinct()
        some = cut(_with_giants(pairs, huge))
        links = links.unionByName(verified_giants(some, texts, reps, n, threshold))
    return texts, cut(links)


def _with_giants(pairs: DataFrame, huge: DataFrame) -> DataFrame:
    return pairs.join(huge, pairs.a == F.col("g"), "left_semi").unionByName(pairs.join(huge, pairs.b == F.col("g"), "left_semi")).distinct()


def all_pairs(texts: Texts, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links between all texts, copies included."""
    m = cut(texts.members)

    def members(side: str) -> DataFrame:
        return m.select(F.col("rep").alias(side), F.col("id").alias(f"id_{side}"))

    wide = links.select("a", "b").join(members("a"), "a", "left").join(members("b"), "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"))
    same = members("a").join(m.select(F.col("rep").alias("a"), F.col("id").alias("id_b")), "a").where("id_a < id_b").select("id_a", "id_b")
    return wide.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(same)


def classes(texts: Texts, links: DataFrame) -> DataFrame:
    """(id, class_id, links): every text that has a near duplicate or a copy, the smallest id it is connected with, and the number of
    different texts it is linked with."""
    from .graph import components

    of = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    reps = texts.reps.select(F.col("id").alias("rep"), "copies").join(degree, "rep", "left").join(of.select(F.col("id").alias("rep"), "component"), "rep", "left").where("copies > 1 OR links IS NOT NULL")
    rows = reps.join(texts.members.select("rep", "id"), "rep", "left")
    cls: Column = F.coalesce("component", "rep")
    return rows.select(F.coalesce("id", "rep").alias("id"), cls.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
