"""Text statistics of documents, and text types learned from them (problem 10)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .textforms import FOLD, MARKS, WORD

# Marks that end a sentence or line of verse.
_ENDS = ".!?۔؟…،,;:؛”\")"
# Marks that running text has between words.
_PLAIN = "'\"\\-.,;:!?()،؛؟۔—…“”‘’"
_SYMBOL = re.compile(rf"[^\w\s{_PLAIN}{MARKS}]|_")
_MARKER = re.compile(r"\s*(?:[-*•–▪·]|\(?\d{1,4}[.):]|\(?[A-Za-z][.)])\s+\S")
_DELIMITERS = re.compile(r"[|;,\t]|\s{3,}")
_TAG = re.compile(r"<[^<>]*>|&\w+;")
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^\w\s'-]+|\n|\d+")
_MIXED = re.compile(r"(?:[A-Za-zÀ-ɏ](?=[؀-ۿ])|[؀-ۿ](?=[A-Za-zÀ-ɏ]))\w*")
_GARBLE = re.compile(r"[\u0080-\u009f¢-¿×-ÛÂÃâ]")

#: The statistics, in the order of the columns.
STATISTICS = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_share", "common_share", "lines", "marker_share", "delimiter_share", "distinct_share", "mixed_share", "garble_ratio", "tag_ratio", "segment_words", "title_share", "line_words")


#: Frequent words, at most, that are sent to every task.
MOST_COMMON = 100_000


def statistics(text: str, common: list[frozenset[str]]) -> tuple[float, ...]:
    """Of one text, whole: see STATISTICS.

    words; mean word length; symbols and digits per visible character; share of lines that end in punctuation; share of words that are
    frequent ones of the language they fit best; lines; share of the text in lines that begin with a list marker; share of lines with the commonest
    number of delimiters (more than one); distinct words per word; share of words in two scripts; wrongly decoded characters and
    characters in tags, per visible character; mean words between marks, digits and line ends; share of words that begin with a
    capital, among those of letters that have one; words per line.
    """
    text = FOLD(text)
    visible = len("".join(text.split())) or 1
    tokens = WORD.findall(text)
    lower = [w.lower() for w in tokens]
    n = len(tokens)
    lines = [x for x in text.splitlines() if x.strip()]
    symbols = len(_SYMBOL.findall(text))
    digits = sum(map(len, _DIGITS.findall(text)))
    counts = Counter(d for x in lines if (d := len(_DELIMITERS.findall(x.strip()))) >= 2)
    parts = [len(x.split()) for x in _SPLIT.split(text)]
    parts = [x for x in parts if x]
    cased = [w[0].isupper() for w in tokens if w[0].lower() != w[0].upper()]
    return (
        float(n),
        sum(map(len, tokens)) / n if n else 0.0,
        symbols / visible,
        digits / visible,
        sum(x.rstrip()[-1] in _ENDS for x in lines) / len(lines) if lines else 0.0,
        max((sum(map(c.__contains__, lower)) for c in common), default=0) / n if n else 0.0,
        float(len(lines)),
        sum(len(x.split()) for x in lines if _MARKER.match(x)) / (len(text.split()) or 1),
        max(counts.values(), default=0) / len(lines) if len(lines) > 2 else 0.0,
        len(set(lower)) / n if n else 0.0,
        len(_MIXED.findall(text)) / n if n else 0.0,
        len(_GARBLE.findall(text)) / visible,
        sum(map(len, _TAG.findall(text))) / visible,
        sum(parts) / len(parts) if parts else 0.0,
        sum(cased) / len(cased) if len(cased) > n / 2 else 0.0,
        n / len(lines) if lines else 0.0,
    )


#: Labelling functions, by statistic: at or below `natural_to` or `natural_from` a vote for natural text, beyond `junk` one against it,
#: between them none. (statistic, natural from, natural to, junk below, junk above)
FUNCTIONS = (
    ("common_share", 0.33, 1.0, 0.2, None),
    ("segment_words", 3.8, math.inf, 3.0, None),
    ("line_words", 4.5, math.inf, 3.6, None),
    ("digit_ratio", 0.0, 0.01, None, 0.06),
    ("symbol_ratio", 0.0, 0.01, None, 0.05),
    ("marker_share", 0.0, 0.5, None, 0.7),
    ("delimiter_share", 0.0, 0.6, None, 0.8),
    ("distinct_share", 0.4, 0.9, 0.25, None),
    ("mean_word_length", 3.0, 6.0, 2.5, 8.0),
    ("mixed_share", 0.0, 0.02, None, 0.1),
    ("garble_ratio", 0.0, 0.005, None, 0.03),
    ("tag_ratio", 0.0, 0.02, None, 0.1),
    ("title_share", 0.0, 0.3, None, 0.5),
)


def document_statistics(documents: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, *STATISTICS) of documents (doc_id, text), each text whole; null texts count as empty.

    common: (lang, word), a table of a few hundred words per language; its size is checked. The language column of documents is not
    used, for it may be wrong: the share of frequent words is that of the language with the most. Further columns are ignored.
    """
    rows = common.where("word IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), "word").distinct().limit(MOST_COMMON + 1).collect()
    if len(rows) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} frequent words")
    by: dict[str, set[str]] = {}
    for r in rows:
        by.setdefault(r.lang, set()).update(x.lower() for x in WORD.findall(FOLD(r.word)))
    sets = [frozenset(x) for x in by.values()]

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [statistics(x or "", sets) for x in b.column("text").to_pylist()]
            cols = [pa.array(x, pa.float64()) for x in zip(*got)] if got else [pa.array([], pa.float64()) for _ in STATISTICS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *cols], names=["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)
    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


def votes() -> Column:
    """The votes of all functions in one string: 1 against natural text, 0 for it, - none. A text without words is voted against."""
    parts = []
    for name, lo, hi, below, above in FUNCTIONS:
        c = F.col(name)
        junk = F.lit(False)
        junk = junk | (c < below) if below is not None else junk
        junk = junk | (c > above) if above is not None else junk
        parts.append(F.when(junk, "1").when((c >= lo) & (c <= hi), "0").otherwise("-"))
    return F.concat(*parts)


def learn(patterns: list[tuple[str, int]], rounds: int = 200) -> dict[str, float]:
    """The probability of each vote pattern that its documents are no natural text.

    patterns: (votes, documents). Two classes whose functions vote independently, each with its own chances of either vote; chances and
    class sizes are learned by expectation-maximization from how the functions agree, no labels are used. It starts from the share of
    votes against, and one document of each vote is added to every count, so that nothing is ever certain.
    """
    if not patterns:
        return {}
    names = [v for v, _ in patterns]
    votes = np.array(["01-".index(x) for v in names for x in v], np.int8).reshape(len(names), -1)
    n = np.array([k for _, k in patterns], np.float64)
    against, cast = (votes == 1).sum(1), (votes != 2).sum(1)
    p = np.minimum(1.0, 3 * against / np.maximum(1, cast))
    for _ in range(rounds):
        size, chance = [], []
        for w in ((1 - p) * n, p * n):
            size.append(1 + w.sum())
            count = np.stack([np.bincount(v, weights=w, minlength=3) for v in votes.T]) + 1
            chance.append(np.log(count / count.sum(1, keepdims=True)))
        lean = chance[1] - chance[0]
        z = np.log(size[1] / size[0]) + sum(lean[i][v] for i, v in enumerate(votes.T))
        now = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        moved = np.abs(now - p).max()
        p = now
        if moved < 1e-9:
            break
    return dict(zip(names, p.tolist()))


def text_types(documents: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, *STATISTICS, votes, junk): junk is the posterior that the document as a whole is a list, a table or rubbish.

    Only the vote patterns and their numbers go to the driver: at most 3 to the power of the functions, 1.6 million short rows, whatever
    the corpus; so is what is broadcast.
    """
    stats = cut(document_statistics(documents, common).withColumn("votes", votes()))
    posterior = learn([(r.votes, r.n) for r in stats.groupBy("votes").agg(F.count("*").alias("n")).collect()])
    if not posterior:
        return stats.withColumn("junk", F.lit(None).cast("double"))
    spark = documents.sparkSession
    table = spark.createDataFrame(list(posterior.items()), "votes string, junk double")
    return stats.join(F.broadcast(table), "votes")
