"""Holding a new batch against everything accepted before (problem 1), by content-defined chunks in a persistent table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import cut, shared_folder
from .graph import components
from .shingles import Batch
from .textforms import FOLD, WORD, words

#: A chunk ends after one word in so many, on average.
DIVISOR = 6
#: Share of an item's characters in chunks that another record has too, from which that record is held against it. It decides only
#: which cases are found cheaply: what chunks leave open is looked up by its word sequences, without loss (see by_sequences).
COVERAGE = 0.4
#: Share of an item's characters in its most frequent chunks, which are not looked up, so formulas of up to this share cost nothing.
SKIPPED = 0.25
#: Folders of the table, by key: a batch reads only those that its keys are in. A larger table needs more (a constructor's argument).
BUCKETS = 64
#: Rows of 64 bits, at most, as a power of two, that are broadcast as a bitmap of the keys by which rows are sifted before a shuffle.
_WORDS = 18
#: Words that are turned into rows at once.
_AT_ONCE = 500_000
#: Records whose digests a task remembers, to write copies once.
_SEEN = 1_000_000
#: Rounds after which items that wait for others are decided group by group, and links, at most, in a group that one task decides.
ROUNDS, GROUP = 12, 200_000

#: Kinds of rows. SEQUENCE: key the hash of an n-word sequence, id the record, size its number of distinct sequences. CHUNK: key the
#: hash of a chunk, size its characters. COUPLET: key and id the two halves of the digest of a first couplet's words. RECORD: key the
#: digest of all words, size as for SEQUENCE, 0 without words; the table keeps it for texts in several pieces only, whose other rows have
#: size -1. OTHER_HALF: of an item, whose COUPLET row has its own id.
SEQUENCE, CHUNK, COUPLET, RECORD, OTHER_HALF = range(5)
_ROWS = "kind int, key long, id long, size int"


def profiles(pieces: DataFrame, n: int, divisor: int = DIVISOR, own: bool = False) -> DataFrame:
    """(kind, key, id, size): SEQUENCE, CHUNK and RECORD rows of bodies (id, piece, part, body, tail), each key once per record.

    A record's id is a digest of its words, so that copies are one record however often they come; a task writes them once. own: the
    id is that of the row, every row has a RECORD, and the first couplet of full_text is read too. A text in several pieces has an id of
    its own, no RECORD row, and sequences of size -1: pieces share some. Null bodies and bodies without a word give no other row.
    """
    columns = ["id", "piece", "part", "body", "tail", *(["full_text"] if own else [])]

    def plain(got: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=["kind", "key", "id", "size"])

    def rows(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        batch = Batch([g[1] for g in got], [g[2] for g in got], n)
        doc, s = batch.shingles()
        ids = np.array([g[0] for g in got], np.int64)
        part = np.array([g[3] for g in got], bool)
        count = np.bincount(doc, minlength=len(got)).astype(np.int32)
        count[part] = -1
        cdoc, chunk, size = batch.chunks(divisor)
        order = np.lexsort((chunk, cdoc))
        cdoc, chunk, size = cdoc[order], chunk[order], size[order]
        once = np.ones(len(chunk), bool)
        once[1:] = (cdoc[1:] != cdoc[:-1]) | (chunk[1:] != chunk[:-1])
        whole = np.flatnonzero(~part)
        digest = np.array([got[i][4] for i in whole], np.int64)
        parts = ((SEQUENCE, s.view(np.int64), ids[doc], count[doc]), (CHUNK, chunk[once].view(np.int64), ids[cdoc[once]], size[once].astype(np.int32)), (RECORD, digest, ids[whole], count[whole]))
        for kind, key, rid, size in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(rid), pa.array(size)], names=["kind", "key", "id", "size"])

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        got: list[tuple] = []
        held = 0
        for b in it:
            if own and (more := [x for i, full, body in zip(*(b.column(c).to_pylist() for c in ("id", "full_text", "body"))) for x in _item(i, full, body)]):
                yield plain(more)
            for i, part, body, tail in zip(*(b.column(c).to_pylist() for c in ("id", "part", "body", "tail"))):
                if not body or not (w := words(body)):
                    continue
                digest = xxhash.xxh3_64_intdigest(" ".join(w)) - (1 << 63)
                if part:
                    got.append((i if own else xxhash.xxh3_64_intdigest(f"part {i}") - (1 << 63), w, words(tail), True, 0))
                elif own or digest not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(digest)
                    got.append((i if own else digest, w, [], False, digest))
                else:
                    continue
                held += len(w)
                if held > _AT_ONCE:
                    yield from rows(got)
                    got, held = [], 0
        if got:
            yield from rows(got)

    return pieces.select(columns).where("id IS NOT NULL" if own else "id IS NOT NULL AND body IS NOT NULL").mapInArrow(of, _ROWS)


def _item(i: int, full_text: str | None, body: str | None) -> list[tuple[int, int, int, int]]:
    """The rows that an item has for its first couplet, and its RECORD if it has no words."""
    out = [] if body and WORD.search(FOLD(body)) else [(RECORD, 0, i, 0)]
    if w := first_lines(full_text):
        hi, lo = _halves(w)
        out += [(COUPLET, hi, i, 0), (OTHER_HALF, lo, i, 0)]
    return out


def _halves(w: list[str]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(" ".join(w))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class ChunkTable:
    """The persistent chunk-to-record table, in a folder that all executors share.

    Its rows (kind, key, id, size) lie in folders by key. A batch reads the folders of its own keys, sifts their rows by a bitmap of
    these keys, and shuffles what is left; what it accepts is appended. Texts accepted before are never read, cut or hashed again:
    likeness is computed from the hashes of their word sequences, which the table holds whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def append(self, rows: DataFrame) -> ChunkTable:
        """Adds rows (kind, key, id, size). They are balanced by folder, so that a key of very many records is written by several tasks."""
        rows = rows.select("kind", "key", "id", "size", F.pmod("key", F.lit(self.buckets)).cast("int").alias("bucket"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").mode("append").parquet(self.path)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROWS + ", bucket int").parquet(self.path)

    def having(self, keys: DataFrame) -> DataFrame:
        """The rows of the table whose (kind, key) is in keys, each once, with the sizes of records."""
        buckets = [r.b for r in keys.select(F.pmod("key", F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # at most self.buckets
        some = sifted(self.rows().where(F.col("bucket").isin(buckets)).select("kind", "key", "id", "size"), "key", keys.select("key"))
        # an inner join stays above the sieve; a semi-join would be pushed below it, and shuffle the whole table
        some = some.join(keys.select("kind", "key").distinct(), ["kind", "key"]).select("kind", "key", "id", "size").distinct()
        whole = self.rows().where(F.col("kind") == RECORD).select("id", F.col("size").alias("whole"))
        return some.join(whole, "id", "left").select("kind", "key", "id", F.coalesce("whole", "size").alias("size"))


def sifted(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose column may be among the values of wanted, of one column: all that are, and few others unless these are very many.
    The values are told by a bitmap of bounded size, so that rows are dropped before they are shuffled."""
    h = F.xxhash64(F.col(column))
    word, bit = F.shiftrightunsigned(h, 64 - _WORDS).cast("int"), F.shiftrightunsigned(h, 58 - _WORDS).bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.toDF(column).groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    have = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word").where(have).select(rows.columns)  # at most 2 ** _WORDS rows


def stored(spark: SparkSession, path: str, history: DataFrame, verses: DataFrame, n: int, divisor: int = DIVISOR, buckets: int = BUCKETS) -> ChunkTable:
    """A new table of the texts (bodies, see frames) and the first couplets of verse rows (text_id, couplet_index, misra1_urdu,
    misra2_urdu)."""
    opening = couplets(verses.where("couplet_index = 1").select(F.concat_ws("\n", "misra1_urdu", "misra2_urdu").alias("m"))).distinct()
    opening = opening.select(F.lit(COUPLET).alias("kind"), F.col("hi").alias("key"), F.col("lo").alias("id"), F.lit(0).alias("size"))
    table = ChunkTable(spark, path, buckets).append(profiles(history, n, divisor).where(F.col("kind") != RECORD).unionByName(opening))
    parts = table.rows().where((F.col("kind") == SEQUENCE) & (F.col("size") < 0)).select("id", "key").distinct().groupBy("id").agg(F.count("*").cast("int").alias("size"))
    return table.append(parts.select(F.lit(RECORD).alias("kind"), F.col("id").alias("key"), "id", "size"))


def by_chunks(items: DataFrame, known: DataFrame, coverage: float = COVERAGE, skipped: float = SKIPPED) -> DataFrame:
    """(item, id): records that share chunks of at least `coverage` of an item's characters.

    items, known: CHUNK rows of the batch and of the table. Every chunk counts once. Of each item the most frequent chunks, up to the
    share `skipped` of its characters, are not looked up; what they might add is counted in, so no record above the bound is lost.
    """
    skipped = min(skipped, coverage)
    often = known.groupBy("key").agg(F.count("*").alias("often"))
    of = Window.partitionBy("id")
    rows = items.select("key", "id", "size").join(often, "key", "left").withColumn("total", F.sum("size").over(of)).withColumn("below", F.sum("size").over(of.orderBy(F.desc_nulls_last("often"), "key")))
    rows = rows.withColumn("skipped", F.max(F.when(F.col("below") < skipped * F.col("total"), F.col("below")).otherwise(0)).over(of))
    asked = rows.where((F.col("below") >= skipped * F.col("total")) & F.col("often").isNotNull()).select(F.col("id").alias("item"), "key", "size", "total", "skipped")
    shared = asked.join(known.select("key", "id"), "key").groupBy("item", "id").agg(F.sum("size").alias("shared"), F.first("total").alias("total"), F.first("skipped").alias("skipped"))
    return shared.where(F.col("shared") + F.col("skipped") >= coverage * F.col("total")).select("item", "id")


def by_sequences(items: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(item, batch, id): every record whose likeness with an item may be `threshold`; none that has it is left out.

    items and known: SEQUENCE rows, known with a column batch: true if the record is an item too; then only pairs with an earlier
    item are given. A record of that likeness has at least threshold * n of an item's n sequences, so it has one of any n -
    ceil(threshold * n) + 1 of them: these, the rarest, are looked up, so sequences that many records have cost nothing unless an item
    has hardly any other, and then only records of fitting size count. What the others might add is counted in.
    """
    often = known.groupBy("key").agg(F.count("*").alias("often"))
    of = Window.partitionBy("id")
    rows = items.select("key", "id", "size").join(often, "key").withColumn("at", F.row_number().over(of.orderBy("often", "key")))
    # likeness is compared in floating point, so a bound that is whole must not be rounded up
    rows = rows.withColumn("skipped", F.greatest(F.ceil(threshold * F.col("size") - 1e-6) - 1, F.lit(0))).withColumn("found", F.count("*").over(of))
    # sequences that no record has come first, but are not in `rows`
    asked = rows.where((F.col("at") + F.col("size") - F.col("found") <= F.col("size") - F.col("skipped"))).select(F.col("id").alias("item"), "key", F.col("size").alias("ni"), "skipped")
    fit = (F.least("size", "ni") >= threshold * F.greatest("size", "ni") - 1e-6) & (~F.col("batch") | (F.col("id") < F.col("item")))
    shared = asked.join(known.select("key", "id", "size", "batch"), "key").where(fit).groupBy("item", "batch", "id").agg(F.count("*").alias("shared"), F.first("size").alias("n"), F.first("ni").alias("ni"), F.first("skipped").alias("skipped"))
    need = threshold / (1 + threshold) * (F.col("n") + F.col("ni")) - 1e-6
    return shared.where(F.col("shared") + F.col("skipped") >= need).select("item", "batch", "id")


def alike(pairs: DataFrame, items: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(item, id) of the pairs whose likeness is at least threshold, counted on all their sequences. items, known: SEQUENCE rows."""
    theirs = sifted(known, "id", pairs.select("id")).select("id", "key", F.col("size").alias("n"))
    own = sifted(items, "id", pairs.select("item")).select(F.col("id").alias("item"), "key", F.col("size").alias("ni"))
    both = pairs.join(theirs, "id").join(own, ["item", "key"])
    both = both.groupBy("item", "id").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("ni").alias("ni"))
    return both.where(F.col("both") / (F.col("n") + F.col("ni") - F.col("both")) >= threshold).select("item", "id")


def first_lines(text: str | None) -> list[str]:
    """The words of the first two non-blank lines."""
    return words("\n".join([x for x in text.splitlines() if x.strip()][:2])) if text else []


def read_items(items: DataFrame) -> DataFrame:
    """(id, piece, part, body, tail, full_text) of items (item_id, arrived_at, full_text, normalized_text): of an item sent several
    times, the first; body is full_text, or normalized_text where that is null."""
    one = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("id")).agg(F.min_by(F.struct("full_text", "normalized_text"), F.struct(F.col("arrived_at").isNull(), "arrived_at", F.coalesce("full_text", F.lit("")))).alias("v"))
    return one.select("id", F.lit(0).alias("piece"), F.lit(False).alias("part"), F.coalesce("v.full_text", "v.normalized_text").alias("body"), F.lit("").alias("tail"), F.col("v.full_text").alias("full_text"))


def couplets(rows: DataFrame) -> DataFrame:
    """(hi, lo): the digests of the words of a column m, in two halves; none without a word."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [_halves(w) for x in b.column("m").to_pylist() if (w := words(x))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["hi", "lo"])

    return rows.select("m").mapInArrow(of, "hi long, lo long")


def new_items(items: DataFrame, history: DataFrame, verses: DataFrame, n: int = 5, threshold: float = 0.8, coverage: float = COVERAGE, table: ChunkTable | None = None) -> tuple[DataFrame, ChunkTable]:
    """((id, status) of every item, the chunk table).

    items: (item_id, arrived_at, full_text, normalized_text); history: bodies (see frames) of every accepted text; verses: (text_id,
    couplet_index, misra1_urdu, misra2_urdu). Items are taken in item_id order; status is 'case' if an item is at least `threshold`
    alike (Jaccard index of n-word sequences) to a text or to an earlier accepted item, or has the words of its first couplet in common
    with one; else 'accepted'. Stored hashes are not used, for they may be wrong; words are compared by 64-bit hashes of their
    sequences. An item without words is accepted, and never matches. Null ids are left out.
    table: what an earlier call returned; then neither history nor verses are read. Accepted items are appended to it, so the next
    batch is held against them.
    """
    spark = items.sparkSession
    if table is None:
        table = stored(spark, shared_folder(spark, f"chunks-{uuid.uuid4().hex}"), history, verses, n)
    found = cut(profiles(read_items(items), n, own=True))
    each = found.where(F.col("kind") >= COUPLET).groupBy("id")
    new = each.agg(F.max(F.when((F.col("kind") == RECORD) & (F.col("size") > 0), F.col("key"))).alias("digest"), *(F.max(F.when(F.col("kind") == k, F.col("key"))).alias(c) for k, c in ((COUPLET, "hi"), (OTHER_HALF, "lo"))))
    # equal words and equal first couplets: the first stands for all, whatever is decided on it
    first = cut(new.where("digest IS NOT NULL").groupBy("digest", "hi", "lo").agg(F.min("id").alias("id")))
    mine = cut(found.where(F.col("kind") < RECORD).join(first.select("id"), "id", "left_semi").select("kind", "key", "id", "size"))
    known = cut(table.having(mine.select("kind", "key").distinct()))
    chunks, sequences = (mine.where(F.col("kind") == k) for k in (CHUNK, SEQUENCE))
    old_chunks, old = (known.where(F.col("kind") == k).select("key", "id", "size") for k in (CHUNK, SEQUENCE))
    lines = first.join(known.where(F.col("kind") == COUPLET).select(F.col("key").alias("hi"), F.col("id").alias("lo")), ["hi", "lo"], "left_semi").select("id")
    case = cut(alike(cut(by_chunks(chunks, old_chunks, coverage)), sequences, old, threshold).select(F.col("item").alias("id")).unionByName(lines).distinct())
    # what chunks left open: every record that may be alike is found by word sequences, none by chance
    left = cut(sequences.join(case, "id", "left_anti"))
    near = cut(by_sequences(left, old.withColumn("batch", F.lit(False)).unionByName(left.select("key", "id", "size", F.lit(True).alias("batch"))), threshold))
    case = cut(case.unionByName(alike(near.where("NOT batch").select("item", "id"), left, old, threshold).select(F.col("item").alias("id"))).distinct())
    rest = cut(first.join(case, "id", "left_anti").select("id", "digest", "hi", "lo"))
    ahead = near.where("batch").select("item", "id").join(rest.select(F.col("id").alias("item")), "item", "left_semi").join(rest.select("id"), "id", "left_semi")
    links = cut(alike(ahead, left, left, threshold).select(F.col("id").alias("lo"), F.col("item").alias("hi")))
    status = cut(in_order(rest.select("id", F.when(F.col("hi").isNotNull(), F.concat_ws(" ", "hi", "lo")).alias("couplet")), links))
    taken = rest.join(status.where("status = 'accepted'").select("id"), "id", "left_semi")
    kept = mine.where(F.col("kind") != COUPLET).join(taken.select("id", "digest"), "id").select("kind", "key", F.col("digest").alias("id"), "size")
    table.append(kept.unionByName(taken.where("hi IS NOT NULL").select(F.lit(COUPLET).alias("kind"), F.col("hi").alias("key"), F.col("lo").alias("id"), F.lit(0).alias("size")).distinct()))
    status = status.unionByName(case.select("id", F.lit("case").alias("status")))
    same = F.struct("digest", "hi", "lo")
    stands = first.select(same.alias("g"), F.col("id").alias("rep"))
    out = new.withColumn("s", same).join(stands, F.col("s").eqNullSafe(F.col("g")), "left").join(status.withColumnRenamed("id", "rep"), "rep", "left")
    return cut(out.select("id", F.when(F.col("rep") < F.col("id"), "case").otherwise(F.coalesce("status", F.lit("accepted"))).alias("status"))), table


def in_order(nodes: DataFrame, links: DataFrame, rounds: int = ROUNDS, group: int = GROUP) -> DataFrame:
    """(id, status): nodes (id, couplet) decided in id order. A node is a case if a link (lo, hi) leads to it from an accepted node, or
    an accepted node of smaller id has its couplet; else it is accepted.

    Each round decides every node whose earlier neighbours are decided, or of which one is accepted; of the nodes of one couplet only
    the smallest undecided and the smallest accepted id matter, so no pairs are made within a couplet. Nodes without links or shared
    couplets are accepted at once. What is open after some rounds hangs on long chains: each connected group of up to `group` links is
    then decided by one task, in order; greater ones go on in rounds. Every round decides the smallest open node at least.
    """
    shared = nodes.where("couplet IS NOT NULL").groupBy("couplet").agg(F.count("*").alias("k")).where("k > 1").select("couplet")
    linked = links.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    busy = nodes.join(linked, "id", "left_semi").unionByName(nodes.join(shared, "couplet", "left_semi").select("id", "couplet")).distinct()
    state = cut(busy.select("id", "couplet", F.lit("open").alias("status")))
    free = nodes.join(state.select("id"), "id", "left_anti").select("id", F.lit("accepted").alias("status"))
    done = 0
    while not state.where("status = 'open'").isEmpty():
        by = links.join(state.select(F.col("id").alias("lo"), "status"), "lo").groupBy(F.col("hi").alias("id")).agg(F.max(F.col("status") == "accepted").alias("hit"), F.max(F.col("status") == "open").alias("wait"))
        low = state.where("couplet IS NOT NULL").groupBy("couplet").agg(F.min(F.when(F.col("status") == "open", F.col("id"))).alias("open"), F.min(F.when(F.col("status") == "accepted", F.col("id"))).alias("taken"))
        hit = F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("taken") < F.col("id"), F.lit(False))
        wait = F.coalesce("wait", F.lit(False)) | F.coalesce(F.col("open") < F.col("id"), F.lit(False))
        now = F.when(F.col("status") != "open", F.col("status")).when(hit, "case").when(wait, "open").otherwise("accepted")
        state = cut(state.join(by, "id", "left").join(low, "couplet", "left").select("id", "couplet", now.alias("status")))
        done += 1
        if done % rounds == 0:
            state = cut(_groups(state.select("id", "couplet", "status"), links, group))
    return free.unionByName(state.select("id", "status"))


def _groups(state: DataFrame, links: DataFrame, group: int) -> DataFrame:
    """The state, with the open nodes of all connected groups of bounded size decided."""
    taken = state.where("status = 'accepted' AND couplet IS NOT NULL").groupBy("couplet").agg(F.min("id").alias("taken"))
    hit = links.join(state.where("status = 'accepted'").select(F.col("id").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("id")).distinct().withColumn("hit", F.lit(True))
    is_open = cut(state.where("status = 'open'").join(hit, "id", "left").join(taken, "couplet", "left").select("id", "couplet", (F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("taken") < F.col("id"), F.lit(False))).alias("hit")))
    inner = cut(links.join(is_open.select(F.col("id").alias("lo")), "lo", "left_semi").join(is_open.select(F.col("id").alias("hi")), "hi", "left_semi"))
    star = is_open.where("couplet IS NOT NULL").groupBy("couplet").agg(F.min("id").alias("a"))
    of = cut(components(inner.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(is_open.join(star, "couplet").select("a", F.col("id").alias("b")))))
    rows = is_open.join(of, "id").select("component", "id", F.lit(None).cast("long").alias("lo"), "couplet", "hit")
    rows = cut(rows.unionByName(inner.join(of.withColumnRenamed("id", "hi"), "hi").select("component", F.col("hi").alias("id"), "lo", F.lit(None).cast("string").alias("couplet"), F.lit(False).alias("hit"))))
    small = rows.join(rows.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") <= group).select("component"), "component", "left_semi")

    def decide(key: tuple, t: pa.Table) -> pa.Table:
        ahead: dict[int, list[int]] = {}
        node: dict[int, tuple] = {}
        for i, lo, c, h in zip(*(t.column(x).to_pylist() for x in ("id", "lo", "couplet", "hit"))):
            if lo is None:
                node[i] = (c, h)
            else:
                ahead.setdefault(i, []).append(lo)
        accepted: set[int] = set()
        lines: set[str] = set()
        for i in sorted(node):
            c, h = node[i]
            if not (h or c in lines or any(x in accepted for x in ahead.get(i, ()))):
                accepted.add(i)
                lines |= {c} - {None}
        return pa.table({"id": pa.array(list(node), pa.int64()), "now": pa.array(["accepted" if i in accepted else "case" for i in node], pa.string())})

    now = small.groupBy("component").applyInArrow(decide, "id long, now string")
    return state.join(now, "id", "left").select("id", "couplet", F.coalesce("now", "status").alias("status"))
