"""Records that are equal up to formatting (problem 2), and texts that look the same in different characters (problem 3)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .textforms import BARE, FOLD, WORD

#: Punctuation and symbols, which count as formatting together with white space.
_PUNCT = {c: " " for c in (*range(0x30000), *range(0xE0000, 0xE0200)) if (k := unicodedata.category(chr(c)))[0] in "PS" and k != "Sk"}
#: Words and numbers, at most, of a body that is compared by its full canonical form; a longer one is compared by a digest of all of them.
LONG = 1 << 16
#: The modulus and base of digests of sequences (a Mersenne prime, and a number without pattern).
_PRIME, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D_9E3779B97F4A7C15
# The labels of header fields in their languages.
LABELS = frozenset(("عنوان", "شاعر", "بحر", "ماخذ", "title", "poet", "metre", "origin"))


def _tokens(text: str) -> str:
    return " ".join(text.translate(_PUNCT).lower().split())


def _header(text: str, labels: frozenset[str]) -> tuple[list[str], str]:
    """The header fields that a text begins with, without formatting, and the rest of it."""
    lines, fields, n = text.splitlines(), [], 0
    for line in lines:
        if line.strip():
            parts = line.split("|")
            if not all(":" in p and FOLD(p.partition(":")[0]).strip().lower() in labels for p in parts):
                break
            fields += map(_tokens, parts)
        n += 1
    return (sorted(fields), "\n".join(lines[n:])) if fields else ([], text)


def _key(fields: list[str], rest: str) -> str:
    return "\x1e".join([*fields, rest])


def canonical(text: str, labels: frozenset[str] = LABELS) -> str:
    """The text without formatting: lower-cased words and numbers in their order, header fields sorted and set off.

    Header fields are those at the beginning, `label: value` with a label of `labels`, each on a line of its own or several on a line
    between `|`. Characters are left as they are.
    """
    fields, rest = _header(text, labels)
    return _key(fields, _tokens(rest))


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def sequence(items: list[str]) -> int:
    """A digest of a sequence that those of its parts can be joined to (see joined)."""
    h = 0
    for x in items:
        h = (h * _BASE + xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) + 1) % _PRIME
    return h


def joined(parts: list[tuple[int, int]]) -> int:
    """The digest of a whole sequence from (length, digest) of its parts in order: the same however it was cut."""
    h = 0
    for n, x in parts:
        h = (h * pow(_BASE, n, _PRIME) + x) % _PRIME
    return h


def _long(fields: list[str], n: int, h: int) -> str:
    return _key(fields, f"\x00{n}:{h:032x}")


def keys(pieces: DataFrame, labels: frozenset[str] = LABELS, long: int = LONG) -> DataFrame:
    """(id, key): the canonical form of each body; of a body of more than `long` words and numbers, a digest of them after its header
    fields. The key depends on the words alone, not on whether the body came as one text or in pieces, or where pieces were cut."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list = [[], [], [], []]
            for i, p, part, body in zip(*(b.column(c).to_pylist() for c in ("id", "piece", "part", "body"))):
                row = (i, p, None, body)  # of a text in pieces
                if not part:
                    if not WORD.search(body):
                        continue
                    fields, rest = _header(body, labels)
                    w = _tokens(rest).split(" ")
                    row = (i, -1, _key(fields, " ".join(w)) if len(w) <= long else _long(fields, len(w), sequence(w)), None)
                for o, x in zip(out, row):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["id", "piece", "key", "body"])

    rows = cut(pieces.select("id", "piece", "part", "body").mapInArrow(of, "id long, piece int, key string, body string"))
    one = rows.where("piece < 0").select("id", "key")
    parts = rows.where("piece >= 0")

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece as (header fields of the first, words, number of words, digest)."""
        for b in it:
            out: list = [[], [], [], [], [], [], []]
            for i, p, low, body in zip(*(b.column(c).to_pylist() for c in ("id", "piece", "low", "body"))):
                fields, rest = _header(body, labels) if p == low else ([], body)
                w = _tokens(rest).split()
                for o, x in zip(out, (i, p, "\x1e".join([*fields, ""]), " ".join(w) if len(w) <= long else None, len(w), f"{sequence(w):032x}", WORD.search(body) is not None)):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["id", "piece", "head", "rest", "n", "h", "word"])

    low = parts.groupBy("id").agg(F.min("piece").alias("low"))
    cutup = cut(parts.join(low, "id").select("id", "piece", "low", "body").mapInArrow(first, "id long, piece int, head string, rest string, n long, h string, word boolean"))
    size = cutup.groupBy("id").agg(F.sum("n").alias("total"), F.max("word").alias("word")).where("word").drop("word")
    # the words of a body that is not long, so the list is bounded
    short = cutup.join(size.where(F.col("total") <= long), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "head", "rest"))).alias("v"))
    short = short.select("id", F.concat(F.col("v")[0]["head"], F.array_join(F.filter(F.col("v.rest"), lambda x: x != ""), " ")).alias("key"))
    huge = cutup.join(size.where(F.col("total") > long), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "head", "n", "h"))).alias("v"))

    def together(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [v[0]["head"] + f"\x00{sum(x['n'] for x in v)}:{joined([(x['n'], int(x['h'], 16)) for x in v]):032x}" for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.string())], names=["id", "key"])

    return one.unionByName(short).unionByName(huge.mapInArrow(together, "id long, key string"))


def runs(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(group_id, id): every record (id, key) whose key another record of smaller id has, with the smallest id of that key.

    Records are range-partitioned by (key, id) and sorted within the ranges (Spark spills to disk), so a key that a third of all rows
    have spreads over several ranges; each range is scanned once, comparing full keys of neighbours. What is left is to join the runs
    that ranges cut: every range reports its first and last run, at most two rows. Null keys are no copies of each other. Repeated
    (key, id) rows count once.
    """
    part = records.where(F.col("key").isNotNull() & F.col("id").isNotNull()).select("key", F.col("id").cast("long").alias("id"))
    part = part.repartitionByRange(*([partitions] if partitions else []), "key", "id").sortWithinPartitions("key", "id")

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, last, head = None, None, None, None
        edges: list = []
        for b in it:
            groups, ids = [], []
            for k, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist()):
                if k != key:
                    if head is None:
                        head = (k, i)
                    key, first = k, i
                elif i != last:
                    groups.append(first)
                    ids.append(i)
                last = i
            yield _rows(groups, ids, [None] * len(ids))
        if head is not None:
            edges = [head] if head == (key, first) else [head, (key, first)]
            yield _rows([i for _, i in edges], [TaskContext.get().partitionId()] * len(edges), [_digest(k) for k, _ in edges])

    def _rows(groups: list, ids: list, edges: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(ids, pa.int64()), pa.array(edges, pa.binary())], names=["run", "id", "edge"])

    found = cut(part.mapInArrow(scan, "run long, id long, edge binary"))
    ends = found.where("edge IS NOT NULL")
    # at most two rows a partition, so small whatever the data
    first = F.broadcast(ends.groupBy("edge").agg(F.min("run").alias("group_id"), F.collect_set("run").alias("v")).select("group_id", F.explode("v").alias("run")).where("run <> group_id"))
    inner = found.where("edge IS NULL").join(first, "run", "left").select(F.coalesce("group_id", "run").alias("group_id"), "id")
    return inner.unionByName(first.select("group_id", F.col("run").alias("id"))).where("group_id <> id")


def copies(pieces: DataFrame, labels: frozenset[str] = LABELS) -> DataFrame:
    """(group_id, id): texts equal to another up to formatting and the order of header fields. Texts without a word are none."""
    return runs(keys(pieces, labels))


def representatives(pieces: DataFrame, labels: frozenset[str] = LABELS) -> DataFrame:
    """(id, copies): each text once, with the number of texts that equal it up to formatting, itself included."""
    k = keys(pieces, labels)
    more = cut(runs(k))
    n = more.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("more"))
    return k.select("id").join(more.select("id"), "id", "left_anti").join(n, "id", "left").select("id", (F.coalesce("more", F.lit(0)) + 1).cast("long").alias("copies"))


def _looks(pieces: DataFrame) -> DataFrame:
    """(id, look, bare): digests of the lines of each body, fully mapped, and with only blanks, invisible characters and punctuation
    mapped. Digests of pieces are joined, so they depend on the lines alone."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list = [[], [], [], [], [], []]
            for i, p, part, body in zip(*(b.column(c).to_pylist() for c in ("id", "piece", "part", "body"))):
                word = WORD.search(body) is not None
                if part or word:
                    look, bare = FOLD(body).split("\n"), BARE(body).split("\n")
                    for o, x in zip(out, (i, p if part else -1, len(look), f"{sequence(look):032x}", f"{sequence(bare):032x}", word)):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["id", "piece", "n", "look", "bare", "word"])

    def together(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column("v").to_pylist()
            cols = [pa.array([f"{joined([(x['n'], int(x[c], 16)) for x in v]):032x}" for v in lists], pa.string()) for c in ("look", "bare")]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", "look", "bare"])

    rows = cut(pieces.select("id", "piece", "part", "body").mapInArrow(of, "id long, piece int, n long, look string, bare string, word boolean"))
    # a row of bounded size for each piece of a text
    parts = rows.where("piece >= 0").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "n", "look", "bare"))).alias("v"), F.max("word").alias("word")).where("word")
    return rows.where("piece < 0").select("id", "look", "bare").unionByName(parts.mapInArrow(together, "id long, look string, bare string"))


def _mixed(pieces: DataFrame) -> DataFrame:
    """(id, look, bare) of the texts whose look has several spellings."""
    rows = _looks(pieces)
    mixed = rows.groupBy("look").agg(F.min("bare").alias("lo"), F.max("bare").alias("hi")).where("lo <> hi").select("look")
    return cut(rows.join(mixed, "look", "left_semi"))


def look_alikes(pieces: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: texts that look the same while some letter or digit is written with other code points.

    Spellings of one look are paired first, then their texts, so copies of one spelling are never held against each other.
    """
    rows = _mixed(pieces)
    spelt = rows.select("look", "bare").distinct()
    two = spelt.select("look", F.col("bare").alias("x")).join(spelt.select("look", F.col("bare").alias("y")), "look").where("x < y")
    a, b = rows.select("look", F.col("bare").alias("x"), F.col("id").alias("a")), rows.select("look", F.col("bare").alias("y"), F.col("id").alias("b"))
    return two.join(a, ["look", "x"]).select("look", "y", "a").join(b, ["look", "y"]).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def look_classes(pieces: DataFrame) -> DataFrame:
    """(id, class_id, spelling_id, spellings): of every text that looks like one of other spelling the smallest id of its look, the
    smallest id of its spelling, and the number of spellings; no pairs are made."""
    rows = _mixed(pieces)
    spelt = rows.groupBy("look", "bare").agg(F.min("id").alias("spelling_id"))
    looks = spelt.groupBy("look").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("spellings"))
    return rows.join(spelt, ["look", "bare"]).join(looks, "look").select("id", "class_id", "spelling_id", "spellings")


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the text columns in the one consistent form; nulls stay, other columns are untouched."""

    @F.pandas_udf("string")
    def fold(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: None if x is None else FOLD(x))

    def of(c: str) -> Column:
        return F.when(F.col(c).isNull() | F.col(c).rlike(r"^\p{ASCII}*$"), F.col(c)).otherwise(fold(F.col(c)))

    return df.withColumns({c: of(c) for c in columns})
