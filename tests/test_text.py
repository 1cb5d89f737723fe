from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from kashida.functions import text as t
from kashida.functions import vectors as vec
from kashida.functions import verse as fv
from kashida.operators.search import process_query
from kashida.sources.files import blocks

SAMPLE = "دل ہی تو ہے نہ سنگ و خشت\nدرد سے بھر نہ آئے کیوں\n\nروئیں گے ہم ہزار بار\nکوئی ہمیں ستائے کیوں\n###GHZ###\nہزاروں خواہشیں ایسی\nبہت نکلے مرے ارماں"


@pytest.fixture(scope="module")
def value(spark):
    """The value of a function of one text column."""

    def of(f, *texts):
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return df.select(f(*(F.col(f"c{i}") for i in range(len(texts)))).alias("x")).first().x

    return of


def plain(x):
    return [tuple(y) for y in x]


@pytest.mark.parametrize(("f", "text", "want"), [
    (t.letters, "يكهةأإؤئ", "یکہہااوی"), (t.letters, " ي ", "ی"), (t.letters, None, None), (t.strip, "　 a b\t", "a b"), (t.squeeze, " a  \n b ", "a b"),
    (t.bulk_form, " A  B،\nC۔", "a b c"), (t.text_form, "A،  b. C!", "a b c"), (t.line_form, " دل! ہے؟۔", "دل ہے؟"), (t.tokens, "دل، ہے abc", ["دل،", "ہے"]), (t.tokens, None, []), (t.tokens, "", []),
    (t.words, "a b  c\n", ["a", "b", "c"]), (t.words, "   ", []), (t.lines, "a\n\n  b \n", ["a", "b"]), (t.lines, None, []), (t.first_couplet, "a\n\nb\nc", "a b"), (t.first_couplet, "a", "a"), (t.first_couplet, "", ""),
    (t.slug, "  Mir Taqi  Mir! ", "mir-taqi-mir"), (t.language, "دل ہے", "urdu"), (t.language, "dil hai", "roman"), (t.language, "12 ;", "unknown"), (t.language, "éàü", "mixed"), (t.language, None, "unknown"),
    (t.mostly_urdu, "دل abc", True), (t.mostly_urdu, "", False), (t.translate_words, "دل ہی تو ہے", "the heart is"), (t.translate_words, "دل xyz  لب", "heart xyz lips"), (t.translate_words, None, ""),
    (t.tidy_english, " heart is of stone", "Heart stone"), (t.tidy_english, "a", "a"), (t.roman_form, "Ishq! kaa  RAAT", "ishq ka rat"), (t.to_urdu, "Ishq! ka raat xyz", "عشق کا رات xyz"), (t.to_urdu_wide, "love دل raat sky", "محبت دل رات آسمان"),
    (t.letters_to_urdu, "shaam", "شآم"), (t.ending, "ستایے", "ایے"), (t.ending, "دل", "دل"), (fv.metre_pattern, "", ""), (fv.metre_pattern, None, ""), (fv.theme, "خدا کی رحمت", "spiritual"), (fv.theme, "دل خدا", "love"), (fv.theme, None, "general"),
    (fv.syllables, "", 0), (fv.syllables, "دل", 1), (fv.syllables, "آنا", 2), (fv.opening_pattern, "آنا دل ہوا گیا", "2-1-2"),
])
def test_functions(value, f, text, want):
    assert value(f, text) == want


def test_plain_keys_miss_long_vowels(value):
    assert value(lambda c: t.to_urdu(c, fold_keys=False), "Ishq ka raat xyz") == "عشق کا raat xyz"
    assert process_query("Ishq ka raat xyz") == "عشق کا رات xyz"


def test_couplets(value):
    both = lambda keep: lambda c: t.couplets(t.lines(c), keep)
    assert plain(value(both(True), "a\nb\nc")) == [(1, "a", "b"), (2, "c", "")] and plain(value(both(False), "a\nb\nc")) == [(1, "a", "b")]
    assert value(both(True), "") == value(both(False), "a") == []
    assert plain(value(t.stanza_couplets, "a\nb\nx\n\nc\nd")) == [(1, "a", "b"), (2, "c", "d")] and plain(value(t.stanza_couplets, "a\nb\nc")) == [(1, "a", "b"), (2, "c", "")]


def test_blocks(value):
    assert len(value(blocks, SAMPLE)) == 2 and value(blocks, None) == [] and value(blocks, " \r\n") == []
    assert value(lambda c: blocks(c, blank_lines=True), "a\r\n\r\nb\n \nc") == ["a", "b", "c"] and len(value(lambda c: blocks(c, blank_lines=True), SAMPLE)) == 2


def test_digests(value):
    raw = " A  b،\nc"
    assert value(lambda c: t.digests(c)["content_md5"], raw) == hashlib.md5(b"a b c").hexdigest()
    assert value(lambda c: t.digests(c)["raw_sha256"], raw) == hashlib.sha256(raw.encode()).hexdigest()


@pytest.mark.parametrize(("pattern", "want"), [("SSSSSSSS", ("Unknown", 0.3)), ("LSLSLSLS", ("Hazaj", 0.8)), ("LSLSSS", ("Hazaj", 0.5)), ("", ("Unknown", 0.0)), ("LSLLSLL", ("Khafif", 0.8))])
def test_metre_class(value, pattern, want):
    assert tuple(value(fv.metre_class, pattern)) == want


def test_similarity(value, spark):
    assert round(value(vec.trigram_similarity, "word", "two words"), 6) == 0.363636
    assert value(vec.trigram_similarity, "", "a") == 0.0 and value(vec.trigram_similarity, "a", "a") == 1.0
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [], [0.0, 0.0], ["a", "b"], ["b", "c"], None)], "a array<double>, b array<double>, e array<double>, z array<double>, p array<string>, q array<string>, n array<string>")
    c = F.col
    got = row.select(vec.cosine(c("a"), c("b")), vec.cosine(c("a"), c("e")), vec.cosine_exact(c("a"), c("z")), vec.rhyme_overlap(c("p"), c("q")), vec.rhyme_overlap(c("p"), c("n")), vec.jaccard(c("p"), c("q"))).first()
    assert [round(x, 5) for x in got] == [0.98387, 0.0, 0.0, 0.5, 0.0, round(1 / 3, 5)]
