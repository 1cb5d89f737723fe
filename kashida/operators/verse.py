"""Rhyme, metre, theme and the whole analysis of texts, as set-based jobs over all texts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_any, ending, letters, line_form, words
from ..functions.verse import length_class, metre_class, metre_pattern, regularity, theme, vowel_class, vowel_count
from ..lineage import cut
from ..sources.tables import first_per


def last_word(s: Column) -> Column:
    w = words(s)
    return F.try_element_at(w, F.lit(-1))


def seconds(verses: DataFrame, form=letters) -> DataFrame:  # noqa: ANN001
    """(text_id, k, line): the second lines that are not blank, in one form."""
    v = verses.select("text_id", F.col("couplet_index").alias("k"), form(F.col("misra2_urdu")).alias("line"))
    return v.where(F.coalesce(F.col("line"), F.lit("")) != "")


def refrains(second: DataFrame) -> DataFrame:
    """(text_id, radif, confidence): the commonest last word of a text's second lines, the one that came first on ties, and its share.

    Longer endings are never commoner than their own last word, so only last words are counted.
    """
    w = second.select("text_id", "k", last_word(F.col("line")).alias("radif"))
    n = w.groupBy("text_id", "radif").agg(F.count("*").alias("n"), F.min("k").alias("at"))
    best = n.groupBy("text_id").agg(F.max_by("radif", F.struct("n", -F.col("at"))).alias("radif"), F.max("n").alias("n"), F.sum("n").alias("lines"))
    return best.select("text_id", "radif", F.round(F.col("n") / F.col("lines"), 6).alias("confidence"))


def refrains_of_words(second: DataFrame, most: int = 4) -> DataFrame:
    """(text_id, radif, n): as refrains, preferring the longest ending that as many lines have as the commonest last word."""
    w = second.withColumn("w", words(F.col("line"))).select("text_id", "k", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(most))), lambda i: F.array_join(F.slice("w", -i, i), " "))).alias("radif"))
    n = w.groupBy("text_id", "radif").agg(F.count("*").alias("n"), F.min("k").alias("at"))
    return n.groupBy("text_id").agg(F.max_by("radif", F.struct("n", F.length("radif"), -F.col("at"))).alias("radif"), F.max("n").alias("n"))


def refrains_repeated(second: DataFrame, least: int = 2, lines: int = 2) -> DataFrame:
    """(text_id, radif): the first last word, in order, that `least` lines share; only of texts with `lines` second lines."""
    w = second.select("text_id", "k", last_word(F.col("line")).alias("radif"))
    n = w.groupBy("text_id", "radif").agg(F.count("*").alias("n"), F.min("k").alias("at"))
    return n.groupBy("text_id").agg(F.min_by(F.when(F.col("n") >= least, F.col("radif")), F.struct(F.col("n") < least, "at")).alias("radif"), F.sum("n").alias("lines")).where(F.col("lines") >= lines).select("text_id", "radif")


def rhymes(second: DataFrame, radif: DataFrame) -> DataFrame:
    """(text_id, qaafiya, qaafiya_pattern): the distinct words before the refrain, sorted, and their commonest last three letters, the
    smallest on ties. A line counts if it ends in the refrain's letters."""
    j = second.join(radif.select("text_id", "radif"), "text_id").where("endswith(line, radif)")
    word = last_word(F.expr("substring(line, 1, length(line) - length(radif))"))
    w = j.select("text_id", word.alias("word")).where("word IS NOT NULL").groupBy("text_id", "word").agg(F.count("*").alias("n")).withColumn("tail", ending(F.col("word")))
    tails = w.groupBy("text_id", "tail").agg(F.sum("n").alias("n"))
    first = tails.groupBy("text_id").agg(F.min_by("tail", F.struct(-F.col("n"), "tail")).alias("qaafiya_pattern"))
    return w.groupBy("text_id").agg(F.array_sort(F.collect_set("word")).alias("qaafiya")).join(first, "text_id")


def rhyme_single(second: DataFrame, radif: DataFrame) -> DataFrame:
    """(text_id, qaafiya): the commonest word before the refrain, where it is the last word; ties by first occurrence."""
    j = second.join(radif.select("text_id", "radif"), "text_id").withColumn("w", words(F.col("line"))).where("size(w) >= 2 AND w[size(w) - 1] = radif")
    n = j.select("text_id", "k", F.expr("w[size(w) - 2]").alias("word")).groupBy("text_id", "word").agg(F.count("*").alias("n"), F.min("k").alias("at"))
    return n.groupBy("text_id").agg(F.max_by("word", F.struct("n", -F.col("at"))).alias("qaafiya"))


def _matla() -> Column:
    return F.expr("coalesce(radif <> '' AND endswith(x.a, radif) AND endswith(x.b, radif), false)")


def _maqta() -> Column:
    return F.expr("coalesce(name <> '' AND contains(concat(y.a, ' ', y.b), name), false)")


def openings_and_closings(verses: DataFrame, radif: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, matla, maqta): whether both lines of the first couplet end in the refrain, and whether the last couplet holds the poet's
    name. names: (text_id, name). All in one form of letters."""
    m = lambda c: letters(F.coalesce(c, F.lit("")))
    v = verses.select("text_id", "couplet_index", m(F.col("misra1_urdu")).alias("a"), m(F.col("misra2_urdu")).alias("b"))
    ends = v.groupBy("text_id").agg(F.min(F.struct("couplet_index", "a", "b")).alias("x"), F.max(F.struct("couplet_index", "a", "b")).alias("y"))
    j = ends.join(radif.select("text_id", "radif"), "text_id", "left").join(names.select("text_id", m(F.col("name")).alias("name")), "text_id", "left")
    return j.select("text_id", _matla().alias("matla"), _maqta().alias("maqta"))


def metres(verses: DataFrame) -> DataFrame:
    """(text_id, pattern, name, confidence) of each text's first line."""
    first = verses.groupBy("text_id").agg(F.min(F.struct("couplet_index", "misra1_urdu")).alias("v")).select("text_id", metre_pattern(F.col("v.misra1_urdu")).alias("pattern"))
    return first.withColumn("m", metre_class(F.col("pattern"))).select("text_id", "pattern", F.col("m.name").alias("name"), F.col("m.confidence").alias("confidence"))


def metre_mining(verses: DataFrame) -> DataFrame:
    """(pattern, frequency, example_text_id) over all first lines of couplets."""
    p = verses.select("text_id", metre_pattern(F.col("misra1_urdu")).alias("pattern")).where("pattern <> ''")
    return p.groupBy("pattern").agg(F.count("*").alias("frequency"), F.min("text_id").alias("example_text_id"))


def lengths(verses: DataFrame) -> DataFrame:
    """(text_id, length, vowels, regularity): the metre by the text's length, by vowels per line, and whether its first lines agree."""
    v = verses.select("text_id", "couplet_index", F.coalesce("misra1_urdu", F.lit("")).alias("a"), F.coalesce("misra2_urdu", F.lit("")).alias("b"))
    per = lambda c: F.when(F.col(c) != "", vowel_count(F.col(c), blanks=True))
    n = lambda c: (F.col(c) != "").cast("int")
    agg = v.groupBy("text_id").agg(F.sum(F.length("a") + F.length("b")).alias("total"), (F.sum(F.coalesce(per("a"), F.lit(0)) + F.coalesce(per("b"), F.lit(0))) / F.nullif(F.sum(n("a") + n("b")), F.lit(0))).alias("mean"))
    first = first_per(v, ["text_id"], [F.col("couplet_index")], 3)
    three = first.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("couplet_index", "b"))), lambda x: x["b"]).alias("m"))
    return agg.join(three, "text_id").select("text_id", length_class(F.col("total")).alias("length"), vowel_class(F.col("mean")).alias("vowels"), regularity(F.col("m")).alias("regularity"))


def full_texts(verses: DataFrame) -> DataFrame:
    """(text_id, text): all lines of a text in order, by blanks."""
    from .catalogue import in_order

    return in_order(verses, F.concat(F.coalesce("misra1_urdu", F.lit("")), F.lit(" "), F.coalesce("misra2_urdu", F.lit(""))), " ", "text")


def themes(verses: DataFrame) -> DataFrame:
    """(text_id, theme): by the words of all lines. The lines are not put together: a theme holds if any line has one of its words."""
    line = F.concat_ws(" ", "misra1_urdu", "misra2_urdu")
    got = verses.groupBy("text_id").agg(*(F.max(contains_any(line, keys)).alias(name) for name, keys in fixed.THEMES.items()))
    out: Column = F
    for name in fixed.THEMES:
        out = out.when(F.col(name), name)
    return got.select("text_id", out.otherwise("general").alias("theme"))


def analysis(texts: DataFrame, poets: DataFrame, verses: DataFrame) -> DataFrame:
    """Features of every text that has second lines, as stored in poetic_features. verses: each couplet once.

    Theme, ends and first line of a text come from one aggregation; only its words are grouped beside.
    """
    second = seconds(verses)
    radif = refrains(second)
    m = lambda c: letters(F.coalesce(c, F.lit("")))
    ends = F.struct("couplet_index", m(F.col("misra1_urdu")).alias("a"), m(F.col("misra2_urdu")).alias("b"))
    line = F.concat_ws(" ", "misra1_urdu", "misra2_urdu")
    each = verses.groupBy("text_id").agg(F.min(ends).alias("x"), F.max(ends).alias("y"), F.min(F.struct("couplet_index", "misra1_urdu")).alias("v"), *(F.max(contains_any(line, keys)).alias(f"_{name}") for name, keys in fixed.THEMES.items()))
    names = texts.select(F.col("id").alias("text_id"), "poet_id").join(poets.select(F.col("id").alias("poet_id"), m(F.col("name_urdu")).alias("name")), "poet_id").select("text_id", "name")
    rows = radif.withColumnRenamed("confidence", "radif_confidence").join(rhymes(second, radif), "text_id", "left").join(each, "text_id").join(names, "text_id", "left")
    theme: Column = F
    for name in fixed.THEMES:
        theme = theme.when(F.col(f"_{name}"), name)
    pattern = metre_pattern(F.col("v.misra1_urdu"))
    rows = rows.withColumn("meter_pattern", pattern).withColumn("m", metre_class(F.col("meter_pattern")))
    return rows.select("text_id", "radif", "radif_confidence", "qaafiya", "qaafiya_pattern", theme.otherwise("general").alias("theme"), _matla().alias("matla"), _maqta().alias("maqta_detected"), F.col("m.name").alias("meter_name"), "meter_pattern", F.col("m.confidence").alias("meter_confidence"))


def outline(rows: DataFrame, text: str) -> DataFrame:
    """Of every text (id, text): first line, number of couplets, repeated refrain and rhyme words, from its own lines."""
    from ..functions.text import couplets, lines

    t = rows.select("id", lines(F.col(text)).alias("l"))
    v = t.select(F.col("id").alias("text_id"), F.explode(couplets(F.col("l"))).alias("c")).select("text_id", F.col("c.couplet_index").alias("k"), line_form(F.col("c.m2")).alias("line")).where("line <> ''")
    radif = refrains_repeated(v)
    near = v.join(radif, "text_id").withColumn("w", words(F.col("line"))).where("size(w) >= 2 AND w[size(w) - 1] = radif").groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_set(F.expr("w[size(w) - 2]"))), ",").alias("rhymes"))
    return t.select("id", F.get("l", F.lit(0)).alias("first_line"), F.ceil(F.size("l") / 2).alias("couplets")).join(radif.withColumnRenamed("text_id", "id"), "id", "left").join(near.withColumnRenamed("text_id", "id"), "id", "left")


def bundle(rows: DataFrame, text: str) -> DataFrame:
    """Of every text (id, text), from its own lines: its couplets, their number, refrain and rhyme words (empty where there is none), the
    metre by length, the pattern of the first second lines, and the first line."""
    from ..functions.text import couplets, lines

    own = rows.select("id", lines(F.col(text)).alias("l")).withColumn("verses", couplets(F.col("l")))
    total = F.aggregate("l", F.lit(0), lambda n, x: n + F.length(x))
    behr = F.when(F.size("verses") == 0, "unknown").otherwise(regularity(F.transform(F.slice("verses", 1, 3), lambda c: c["m2"])))
    found = outline(rows, text).select("id", F.coalesce("radif", F.lit("")).alias("radif"), F.coalesce("rhymes", F.lit("")).alias("qafia"))
    return own.select("id", "verses", F.size("verses").alias("verse_count"), length_class(total).alias("meter"), behr.alias("behr"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first_line")).join(found, "id")


def processed(rows: DataFrame, text: str) -> DataFrame:
    """Of every text (id, text), with single blanks: couplets, the commonest last word of the second lines, the commonest word before
    it (or, without a refrain, the commonest last word), and the metre by vowels a line. Line ends are kept, so that couplets are found."""
    from ..functions.text import couplets, lines, squeeze

    # stored once: within the functions that pair lines, they would be cut and squeezed anew for every line
    own = cut(rows.select("id", F.transform(lines(F.col(text)), squeeze).alias("l"))).withColumn("verses", couplets(F.col("l")))
    v = own.select(F.col("id").alias("text_id"), F.explode("verses").alias("c")).select("text_id", F.col("c.couplet_index").alias("k"), F.col("c.m1").alias("a"), F.col("c.m2").alias("line"))
    second = v.where("line <> ''")
    radif = refrains(second).select("text_id", "radif")
    near = rhyme_single(second, radif)
    per = lambda c: F.when(F.col(c) != "", vowel_count(F.col(c), blanks=True))
    mean = v.select("text_id", F.explode(F.array(per("a"), per("line"))).alias("n")).groupBy("text_id").agg(F.avg("n").alias("mean"))
    out = own.select(F.col("id").alias("text_id"), "verses").join(radif, "text_id", "left").join(near, "text_id", "left").join(mean, "text_id", "left")
    return out.select(F.col("text_id").alias("id"), "verses", "radif", "qaafiya", vowel_class(F.col("mean")).alias("beher"))


def frequencies(features: DataFrame, n: int) -> DataFrame:
    """The n most frequent refrains with rank and share of the first in per cent; ties by refrain."""
    count = features.where("radif IS NOT NULL AND radif <> ''").groupBy(F.regexp_replace("radif", r"^\s+|\s+$", "").alias("radif")).agg(F.count("*").alias("n"))
    top = count.orderBy(F.desc("n"), "radif").limit(n)  # n rows
    w = Window.orderBy(F.desc("n"), "radif")
    return top.withColumn("rank", F.row_number().over(w)).withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy()) * 100).cast("long"))
