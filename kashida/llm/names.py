"""Variant spellings of one person or organisation (problem 7): attribution through a noisy channel whose rates are learned."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut
from .graph import components
from .textforms import FOLD

# Urdu letters and the Latin sounds they are written for, without short vowels.
SOUNDS = {
    "ا": "a", "آ": "a", "ع": "a", "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ط": "t", "ث": "s", "س": "s", "ص": "s", "ج": "j", "چ": "c", "ح": "h", "ہ": "h", "ھ": "h", "خ": "kh",
    "د": "d", "ڈ": "d", "ر": "r", "ڑ": "r", "ز": "z", "ذ": "z", "ض": "z", "ظ": "z", "ژ": "z", "ش": "sh", "غ": "gh", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l", "م": "m",
    "ن": "n", "ں": "n", "و": "w", "ی": "", "ے": "", "ئ": "", "ء": "", "ؤ": "w",
}
#: A given name is common from this share of the last names that the given name of a middling bearer goes with. Bearers are counted by
#: last names, not rows, and the middling one cannot be moved by a name that a third of all bear.
COMMON = 0.2
#: Share of the names with a word at an end that are names without it too, from which the word is a title.
TITLE = 0.2
#: Words, at most, that the own name of an organisation stands before: its kind, whole and shortened.
FEW = 3
#: Names, at least, that a title or a word for a kind of organisation must be seen in, and such words, at most, that are sent to tasks.
SEEN, MOST_WORDS = 3, 10_000
#: Least posterior of the entity that an initial, a nickname or a name in the other script is attached to: relatives may share them.
SURE = 0.8
#: Letters that a slip may put in a place.
LETTERS = 26


def plain(name: str) -> str:
    """Consistent form, no accents, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", FOLD(name)) if not unicodedata.combining(c)).lower().strip()


def sound(word: str) -> str:
    """What is left of a word in either script when short vowels are dropped and letters of one sound are one."""
    if any(c in SOUNDS for c in word):
        return re.sub(r"(.)\1+", r"\1", "".join(SOUNDS.get(c, c) for c in word))
    return re.sub(r"(.)\1+", r"\1", re.sub("[ov]", "w", re.sub("[eiuy]", "", word.replace("ch", "c"))))


def consonants(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub("[aeiouwy]", "", word))


def within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


@dataclass(frozen=True)
class Words:
    """What is learned of words from all names: titles, words for kinds of organisations, and words that stand around their names."""

    titles: frozenset[str]
    kinds: frozenset[str]
    frames: frozenset[str]

    def kind(self, word: str, last: bool) -> bool:
        """Whether a word stands for a kind, whole or, at the end of a name, shortened."""
        return word in self.kinds or (last and 3 <= len(word) <= 5 and any(len(word) < len(k) and relation(word, k) in ("start", "skeleton") for k in self.kinds))


def read_name(name: str | None) -> list[str]:
    """The words of a name in the order given name, last name: what follows a comma comes first."""
    if not name:
        return []
    split = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", FOLD(name).strip())
    head, _, tail = plain(split).partition(",")
    head, tail = (re.findall(r"[^\W\d_]+", x) for x in (head, tail))
    return [*tail, *head]


def mailbox(email: str | None) -> tuple[str, str]:
    """(mailbox, host): in lower case, without a tag; host is the first part of the mail domain."""
    box, _, domain = (email or "").strip().lower().partition("@")
    return box.partition("+")[0], domain.partition(".")[0]


def parse(name: str | None, email: str | None, known: Words) -> tuple[str, str, str, bool, str, str] | None:
    """(kind, given, last, sure of the order, mailbox, host) of a row; None if its name has no word of two letters.

    kind: p a person, o an organisation (last: its own name), 1 a person in one word. given may be an initial.
    """
    parts = read_name(name)
    box, host = mailbox(email)
    if not any(len(p) > 1 for p in parts):
        return None
    kinds = [p for i, p in enumerate(parts) if known.kind(p, i == len([q for q in parts if q not in known.titles]) - 1 or i == len(parts) - 1)]
    if kinds:
        own = [p for p in parts if p not in kinds and p not in known.frames and p not in known.titles and len(p) > 1]
        return ("o", "", max(own, key=len), True, box, host) if own else None
    own = [p for p in parts if p not in known.titles]
    if not any(len(p) > 1 for p in own):
        return None
    if len(own) == 1:
        return "1", "", own[0], True, box, host
    if name and "," in name and len(own[-1]) > 1:
        return "p", own[0], own[-1], True, box, host
    if len(own[-1]) == 1:  # last name first, then an initial
        return "p", own[-1] if len(own) == 2 else own[1], own[0], True, box, host
    return "p", own[0], own[-1], len(own[0]) == 1, box, host


def slips(word: str) -> set[str]:
    """The word, and all that is left of it without one letter: two words one slip apart have one in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def one_slip(a: str, b: str) -> bool:
    """Whether a becomes b by one letter changed, added, left out, or two neighbours exchanged."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def relation(given: str, full: str) -> str:
    """How a given name is written as `given`: same, initial, start (it shares three letters at an end), skeleton (it keeps some
    consonants, and the first letter), consonants (it keeps some), or other."""
    if given == full:
        return "same"
    if len(given) == 1:
        return "initial" if full[:1] == given else "other"
    if len(given) > len(full):
        return "other"
    if full.startswith(given[:3]) or full.endswith(given[-3:]):
        return "start"
    c = consonants(given)
    return ("skeleton" if given[0] == full[0] else "consonants") if c and within(c, consonants(full)) else "other"


#: Ways of writing a given name whose rates are learned; script: in the other script by its sounds, script_off: by most of them.
WAYS = ("same", "initial", "start", "skeleton", "consonants", "slip", "script", "script_off", "other")


def way(g: str, s: str, urdu: bool, h: str, t: str) -> str:
    """The way in which (g, s) writes (h, t), whose last name sounds the same."""
    if urdu:
        return "script" if sound(g) == sound(h) else "script_off" if relation(sound(g), sound(h)) != "other" else "other"
    if s != t:
        return "slip" if g == h and one_slip(s, t) else "other"
    r = relation(g, h)
    return "slip" if r in ("other", "start", "skeleton", "consonants") and len(g) > 3 and one_slip(g, h) else r


def _batches(df: DataFrame, columns: list[str], of: Callable, types: dict[str, pa.DataType]) -> DataFrame:
    """Rows that `of` yields from each row's values, batch by batch."""
    schema = ", ".join(f"{n} {'array<string>' if t == pa.list_(pa.string()) else {pa.int64(): 'long', pa.string(): 'string', pa.bool_(): 'boolean', pa.float64(): 'double'}[t]}" for n, t in types.items())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [r for x in zip(*(b.column(c).to_pylist() for c in columns)) for r in of(*x)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * len(types), types.values())], names=list(types))

    return df.select(*columns).mapInArrow(run, schema)


def learn_words(rows: DataFrame) -> Words:
    """What words mean, from how they stand in all different names (id, name, email).

    A title is a word at an end of names of three words or more that are, often enough, names without it. A word for a kind of
    organisation is one that ends most of its names, after words that hardly stand before any other: before a last name stand given
    names, which go with many. A frame is one that stands mostly in names with a kind, and in a tenth as many as the commonest kind.
    Copies of a name count once.
    """
    names = cut(_batches(rows, ["name"], lambda n: [(" ".join(w), w)] if (w := read_name(n)) else [], {"n": pa.string(), "w": pa.list_(pa.string())}).dropDuplicates(["n"]))
    have = names.select(F.col("n").alias("r"), F.lit(1).alias("there")).where("r <> ''")
    without = lambda a, b: F.array_join(F.slice("w", 1 + a, F.greatest(F.size("w") - a - b, F.lit(0))), " ")
    long = names.where("size(w) > 2").select("n", "w", F.explode(F.array(F.struct(F.get("w", F.lit(0)).alias("t"), without(1, 0).alias("r")), F.struct(F.element_at("w", -1).alias("t"), without(0, 1).alias("r")), F.struct(F.get("w", F.lit(0)).alias("t"), without(1, 1).alias("r")), F.struct(F.element_at("w", -1).alias("t"), without(1, 1).alias("r")))).alias("x")).select("n", "x.t", "x.r")
    each = long.join(have, "r", "left").groupBy("n", "t").agg(F.max(F.coalesce("there", F.lit(0))).alias("there"))
    titles = frozenset(r.t for r in each.groupBy("t").agg(F.count("*").alias("k"), F.avg("there").alias("share")).where((F.col("k") >= SEEN) & (F.col("share") >= TITLE)).orderBy(F.desc("k")).limit(MOST_WORDS).collect())
    bare = cut(names.select("n", F.filter("w", lambda x: ~x.isin(*titles)) .alias("w") if titles else "w").select(F.array_join("w", " ").alias("n"), "w").dropDuplicates(["n"]).where("size(w) > 1"))
    words = bare.select("n", F.posexplode("w").alias("at", "t"), F.size("w").alias("size")).groupBy("n", "t").agg(F.max(F.when(F.col("at") == F.col("size") - 1, 1).otherwise(0)).alias("last"))
    count = cut(words.groupBy("t").agg(F.count("*").alias("k"), F.avg("last").alias("last")))
    ends = cut(bare.select(F.element_at("w", -1).alias("t"), F.element_at("w", -2).alias("b")).where("length(b) > 1"))
    few = ends.groupBy("b").agg((F.count_distinct("t") <= FEW).cast("double").alias("few"))
    after = ends.join(count.where((F.col("k") >= SEEN) & (F.col("last") >= 0.5)).select("t", "k"), "t").join(few, "b").groupBy("t").agg(F.avg("few").alias("few"), F.first("k").alias("k"))
    kinds = {r.t: r.k for r in after.where("few >= 0.8 AND length(t) > 2").orderBy(F.desc("k")).limit(MOST_WORDS).collect()}
    bar = 0.1 * max(kinds.values(), default=0)
    kinds = frozenset(t for t, k in kinds.items() if k >= max(SEEN, bar))
    if not kinds:
        return Words(titles, kinds, frozenset())
    beside = words.join(words.where(F.col("t").isin(*kinds)).select("n").distinct().withColumn("o", F.lit(1)), "n", "left").groupBy("t").agg(F.count("*").alias("k"), F.avg(F.coalesce("o", F.lit(0))).alias("share"))
    frames = frozenset(r.t for r in beside.where((F.col("k") >= max(SEEN, bar)) & (F.col("share") >= 0.5)).orderBy(F.desc("k")).limit(MOST_WORDS).collect())
    return Words(titles, kinds, frames - kinds)


def _parsed(rows: DataFrame, known: Words) -> DataFrame:
    types = {"id": pa.int64(), "kind": pa.string(), "g": pa.string(), "s": pa.string(), "sure": pa.bool_(), "box": pa.string(), "host": pa.string(), "urdu": pa.bool_()}
    return _batches(rows, ["id", "name", "email"], lambda i, n, e: [(i, *p, any(c in SOUNDS for c in p[2]))] if (p := parse(n, e, known)) else [], types)


def _ordered(p: DataFrame) -> DataFrame:
    """Turns names that were typed last name first: by how often their words stand first and last in other names."""
    two = p.where("kind = 'p' AND length(g) > 1")
    seen = two.select(F.col("g").alias("t"), F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(two.select(F.col("s").alias("t"), F.lit(0).alias("f"), F.lit(1).alias("l")))
    lean = seen.groupBy("t").agg(F.log((F.sum("f") + 0.5) / (F.sum("l") + 0.5)).alias("lean"))
    p = p.join(lean.select(F.col("t").alias("g"), F.col("lean").alias("lg")), "g", "left").join(lean.select(F.col("t").alias("s"), F.col("lean").alias("ls")), "s", "left")
    turned = (F.col("kind") == "p") & ~F.col("sure") & (F.coalesce("lg", F.lit(0.0)) - F.coalesce("ls", F.lit(0.0)) + F.log(F.lit(4.0)) < 0)
    return p.select("id", "kind", F.when(turned, F.col("s")).otherwise(F.col("g")).alias("g"), F.when(turned, F.col("g")).otherwise(F.col("s")).alias("s"), "box", "host", "urdu")


def _stars(keyed: DataFrame) -> DataFrame:
    """(a, b) links of every id with the smallest id of its key; keyed: (key, id). No pairs within a key are made."""
    low = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    return keyed.join(low, "key").select("a", F.col("id").alias("b")).where("a <> b")


def learn_ways(rows: DataFrame, common: DataFrame) -> dict[str, float]:
    """The rates of the ways in which people write a name, from rows (box, host, g, s, urdu) of mailboxes that hold their own last name:
    each row against the commonest whole name of its mailbox that has a common given name. One is added to every count."""
    own = rows.where("kind = 'p' AND box <> ''").join(common.select("g", F.lit(1).alias("c")), "g", "left")
    n = own.where("c = 1 AND NOT urdu AND contains(box, s)").groupBy("box", "host", "g", "s").agg(F.count("*").alias("n"))
    first = n.groupBy("box", "host").agg(F.max_by(F.struct(F.col("g").alias("h"), F.col("s").alias("t")), F.struct("n", "g", "s")).alias("x")).select("box", "host", "x.*")
    kinds = own.join(first, ["box", "host"]).groupBy("g", "s", "urdu", "h", "t").agg(F.count("*").alias("n"))
    ways = _batches(kinds, ["g", "s", "urdu", "h", "t", "n"], lambda g, s, u, h, t, n: [(way(g, s, u, h, t), n)], {"way": pa.string(), "n": pa.int64()})
    got = {r.way: r.n for r in ways.groupBy("way").agg(F.sum("n").alias("n")).collect()}  # at most a row for each way
    total = sum(got.values()) + len(WAYS)
    return {w: (got.get(w, 0) + 1) / total for w in WAYS}


def _stars(keyed: DataFrame) -> DataFrame:
    """(a, b) links of every id with the smallest id of its key; keyed: (key, id). No pairs within a key are made."""
    low = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    return keyed.join(low, "key").select("a", F.col("id").alias("b")).where("a <> b")


def _slip_links(spelt: DataFrame, rate: float, others: float) -> DataFrame:
    """(a, b): every spelling (kind, g, s, id, n, share, common, mailed) attached to the one it is most probably a slip of. Candidates are
    those that rank before it: with a common given name, confirmed by a mailbox, frequent.

    One word must be the same, the other one slip apart. A candidate weighs its number of rows times the rate of slips, spread over all
    slips that its word allows; against it stands that the spelling is another one's own name: `others`, the rate of further people of a
    last name, times the share of people who bear the given name (for a last name, `others` over the number of last names). Two last
    names that both stand in mailboxes of their bearers are no slips of each other. What is more probable is taken.
    """
    columns = ["kind", "g", "s", "id", "n", "share", "common", "mailed"]
    types = {"key": pa.string(), "kind": pa.string(), "g": pa.string(), "s": pa.string(), "id": pa.int64(), "n": pa.int64(), "share": pa.float64(), "common": pa.bool_(), "mailed": pa.bool_()}

    def keys(kind: str, g: str, s: str, *rest) -> list[tuple]:  # noqa: ANN002
        found = [f"{kind}|{g}|{x}" for x in slips(s)] + ([f"{kind}|{x}||{s}" for x in slips(g)] if len(g) > 3 else [])
        return [(k, kind, g, s, *rest) for k in found]

    k = cut(_batches(spelt.where("kind = 'o' OR length(g) > 1"), columns, keys, types))
    o = k.select("key", *(F.col(c).alias(f"{c}_") for c in ("g", "s", "id", "n", "common", "mailed")))
    ahead = F.struct(F.col("common_"), F.col("mailed_"), F.col("n_"), -F.col("id_")) > F.struct(F.col("common"), F.col("mailed"), F.col("n"), -F.col("id"))
    pairs = k.join(o, "key").where(ahead & ((F.col("s") == F.col("s_")) | ~(F.col("mailed") & F.col("mailed_")))).select("id", "g", "s", "share", "id_", "g_", "s_", "n_").distinct()

    def weighed(i: int, g: str, s: str, share: float, j: int, h: str, t: str, n: int) -> list[tuple]:
        if g == h and len(s) > 4 and one_slip(s, t):
            return [(i, j, n * rate / ((2 * LETTERS + 1) * len(t)), 0.0)]
        if s == t and one_slip(g, h):
            return [(i, j, n * rate / ((2 * LETTERS + 1) * len(h)), others * share)]
        return []

    w = _batches(pairs, ["id", "g", "s", "share", "id_", "g_", "s_", "n_"], weighed, {"id": pa.int64(), "c": pa.int64(), "p": pa.float64(), "own": pa.float64()})
    of = Window.partitionBy("id")
    best = w.withColumn("most", F.max("p").over(of)).withColumn("own", F.max("own").over(of)).withColumn("r", F.row_number().over(of.orderBy(F.desc("p"), "c")))
    return best.where((F.col("r") == 1) & (F.col("p") > F.col("own"))).select(F.col("c").alias("a"), F.col("id").alias("b"))


def _short_links(spelt: DataFrame, of: DataFrame, rates: dict[str, float], rare: int) -> DataFrame:
    """(a, b): spellings that are only initials, nicknames, the other script or one word, attached to the entity of greatest posterior.

    of: (id, component) so far. Candidates are the common given names with the same last name; the posterior of an entity is the sum, over
    its spellings, of rows times the learned rate of the way in which the variant writes it. A rare given name may be a nickname that
    keeps nothing: of the rate of all other ways, spread over the `rare` given names. Below SURE nothing is attached: the initial that
    fits two relatives belongs to neither.
    """
    text = {"id": pa.int64(), "g": pa.string(), "s": pa.string(), "urdu": pa.bool_(), "common": pa.bool_(), "n": pa.int64(), "c": pa.int64(), "k": pa.string()}
    whole = cut(spelt.where("kind <> 'o'").join(of, "id", "left").withColumn("c", F.coalesce("component", "id")))
    people = cut(_batches(whole.where("kind = 'p'"), ["id", "g", "s", "urdu", "common", "n", "c"], lambda i, g, s, *x: [(i, g, s, *x, sound(s))], text))
    strong = people.where("NOT urdu AND length(g) > 1")
    weak = people.join(strong.where("common").select("c").distinct(), "c", "left_anti").select("id", "g", "s", "urdu", "k")
    cand = strong.where("common").select(F.col("g").alias("h"), F.col("s").alias("t"), "n", "c", "k")

    def weighed(i: int, g: str, s: str, urdu: bool, h: str, t: str, n: int, c: int) -> list[tuple]:
        if not urdu and s != t:
            return []
        w = way(g, s, urdu, h, t)
        other = rates["other"] / max(1, rare) if not urdu and len(g) > 1 else 0.0
        p = (n * rates[w] if w not in ("other", "same", "slip") else 0.0) + other
        return [(i, c, p)] if p > 0 else []

    score = {"id": pa.int64(), "c": pa.int64(), "p": pa.float64()}
    scored = _batches(weak.join(cand, "k"), ["id", "g", "s", "urdu", "h", "t", "n", "c"], weighed, score)
    one = whole.where("kind = '1'").select("id", F.col("s").alias("k"))
    glued = one.join(strong.select(F.explode(F.array(F.concat("g", "s"), F.concat("s", "g"))).alias("k"), "n", "c"), "k").select("id", "c", F.col("n").cast("double").alias("p"))
    each = scored.unionByName(glued).groupBy("id", "c").agg(F.sum("p").alias("p"))
    best = each.withColumn("all", F.sum("p").over(Window.partitionBy("id"))).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "c")))
    return best.where((F.col("r") == 1) & (F.col("p") >= SURE * F.col("all"))).select(F.col("c").alias("a"), F.col("id").alias("b"))


def entities(contributors: DataFrame) -> DataFrame:
    """(id, entity): every row (id, name, email) that shares its person or organisation with another; entity is the smallest of its ids.

    1. Titles and words for organisations are learned from all names, names are read, null and blank ones are left out. 2. Rows of one
    spelling are one node, if the name names somebody: a given name, an organisation or a mailbox stands for that; words that stand in no
    other name don't. 3. The rates of slips, initials, nicknames and the other script are learned from mailboxes. 4. Spellings that share
    a mailbox of their own are linked, unless people of several last names or given names use it. 5. Each other spelling is attached to
    the one of greatest posterior: number of rows times the likelihood of writing it so. Entities are the connected components.
    """
    contributors = contributors.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "name", "email")
    known = learn_words(contributors)
    p = cut(_ordered(cut(_parsed(contributors, known))))
    rows = p.withColumn("spelling", F.concat_ws("|", "kind", "g", "s"))
    bearers = cut(rows.where("kind = 'p' AND length(g) > 1 AND NOT urdu").groupBy("g").agg(F.count_distinct("s").alias("f")))
    figures = bearers.agg(F.expr("percentile(f, 0.5D, f)").alias("middle"), F.sum("f").alias("all")).first()  # one row
    bar = max(2.0, COMMON * (figures["middle"] or 0.0))
    common = bearers.where(F.col("f") >= bar).select("g")
    mailed = (F.length("s") > 4) & F.when(F.col("kind") == "o", F.col("host") == F.col("s")).otherwise(F.col("box").contains(F.col("s")))
    spelt = rows.groupBy("spelling").agg(F.min("id").alias("id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("kind", "g", "s", "urdu")), F.max(F.coalesce(mailed, F.lit(False))).alias("mailed"))
    spelt = spelt.join(bearers, "g", "left").withColumn("common", F.coalesce(F.col("f") >= bar, F.lit(False))).withColumn("share", F.coalesce(F.col("f") / float(figures["all"] or 1), F.lit(1.0)))
    # a name of words that stand in no other name, and that no mailbox confirms, names nobody
    seen = rows.select("spelling", F.explode(F.array("g", "s")).alias("t")).where("t <> ''").distinct().groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t")
    told = spelt.join(seen.select(F.col("t").alias("g"), F.lit(True).alias("sg")), "g", "left").join(seen.select(F.col("t").alias("s"), F.lit(True).alias("ss")), "s", "left")
    spelt = cut(told.withColumn("somebody", (F.col("kind") == "o") | F.col("mailed") | F.coalesce("sg", F.lit(False)) | F.coalesce("ss", F.lit(False))).drop("sg", "ss"))
    rates = learn_ways(rows, common)
    families = spelt.where("kind = 'p' AND common").groupBy("s").agg(F.count_distinct("g").alias("k")).agg(F.avg((F.col("k") > 1).cast("double")).alias("share")).first()  # one row
    others = max(families["share"] or 0.0, 1e-3)
    rare = bearers.where(F.col("f") < bar).count()
    same = _stars(rows.join(spelt.where("somebody").select("spelling"), "spelling", "left_semi").select(F.col("spelling").alias("key"), "id"))
    mail = cut(rows.where("kind <> 'o' AND box <> ''").select("box", "host", "g", "s", "urdu", "id"))
    firms = rows.where("kind = 'o'").select(F.explode(F.array_distinct(F.array("s", F.when(F.col("host") != "", F.col("host")).otherwise(F.col("s"))))).alias("key"), "id")
    links = cut(same.unionByName(_mail_links(mail)).unionByName(_stars(firms)).unionByName(_slip_links(spelt, rates["slip"], others)))
    of = cut(components(links))
    return components(links.unionByName(_short_links(spelt, of, rates, rare))).select("id", F.col("component").alias("entity"))


def _mail_links(mail: DataFrame) -> DataFrame:
    """(a, b) links of rows with one mailbox.

    A mailbox belongs to a person if its name holds the last name of some row that uses it, nearly enough; desks and offices do not. A
    name with the whole given name or a number counts at every host, one of initial and last name only at its own.
    """

    def fits(box: str, host: str, g: str, s: str, urdu: bool, i: int) -> list[tuple]:
        letters = re.sub("[^a-z]", "", box)
        if urdu:
            have, own = sound(letters), sound(s)
            good = len(own) > 2 and any(x in have for x in (own, own[1:], own[:-1]) if len(x) > 2)
        else:
            good = any(s[k : k + 4] in letters for k in range(max(1, len(s) - 3))) or (len(g) > 3 and g in letters)
        return [(box + "@" + ("" if re.search("[0-9._]", box) else host), i)] if good else []

    return _stars(_batches(mail, ["box", "host", "g", "s", "urdu", "id"], fits, {"key": pa.string(), "id": pa.int64()}))


def pairs(of: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows of one entity."""
    return of.select("entity", F.col("id").alias("id_a")).join(of.select("entity", F.col("id").alias("id_b")), "entity").where("id_a < id_b").select("id_a", "id_b")
