"""One consistent form for text that looks the same, and the words of a text.

`Transducer` is the compiled mapping used by every operator here. A text is passed over once, grapheme cluster by grapheme cluster (a
base with the marks and invisible characters after it); in a cluster the longest key wins. The mapping is built by rule from the
Unicode decomposition tables and stated look-alikes, as pairs, and checked before use: no key may have two outputs, and no output may
be changed by the mapping again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

# Characters without width or ink.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ﻿ﾠ"
# Ranges of variation selectors, which have no width either.
SELECTORS = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
# Blanks of other widths than U+0020.
BLANKS = "               　"
# Look-alike letters, each with the letter it is taken for, as in the public table of confusable characters.
LOOKALIKES = {
    # Latin
    "ɡ": "g",
    # Greek capitals and small letters drawn like Latin ones
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "Ϝ": "F", "Ϻ": "M",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ѵ": "V", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ү": "y", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ѡ": "w",
    # Armenian
    "Օ": "O", "Ս": "U", "Տ": "S", "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "ք": "f", "զ": "q",
    # Arabic letters that Urdu text writes with letters of its own
    "ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ە": "ہ", "ة": "ۃ",
    # Arabic-Indic digits in their two series
    "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٤": "۴", "٥": "۵", "٦": "۶", "٧": "۷", "٨": "۸", "٩": "۹",
}
# What a letter that look-alikes are taken for makes with a mark, where Unicode composes only the look-alike.
COMPOSED = {"یٔ": "ئ"}
# The kinds of compatibility forms that differ in width, position or typeface only.
KINDS = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>")
#: Characters beyond this have no form that is mapped, but for variation selectors.
LAST = 0x30000

MARKS = "̀-ͯ҃-҇ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭऀ-ःऺ-ॏ᪰-᫿᷀-᷿⃐-⃿︠-︯"
# Characters that Python counts as word characters while they are numbers, not letters.
_NUMBERS = "²³¹¼-¾৴-৹⁰-⁹₀-₉⅐-↉①-⒛⓪-⓿❶-➓㈠-㈩㊀-㊉"
_LETTER = rf"[^\W\d_{_NUMBERS}]"
WORD = re.compile(rf"{_LETTER}(?:{_LETTER}|[{MARKS}])*")
#: Conjoining letters of Hangul, which Unicode composes by rule: vowels and finals follow a consonant as marks follow a base.
_JAMO = range(0x1161, 0x1200)
#: Clusters that a process keeps the outputs of, before it begins anew.
KEPT = 200_000


def _class(c: str) -> str:
    """A character class of exactly these characters, by ranges."""
    out, codes = [], sorted(map(ord, set(c)))
    for x in codes:
        if out and x == out[-1][1] + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "[" + "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]"


class Transducer:
    """A longest-match mapping over grapheme clusters, applied in one pass.

    rules: pairs (character, output), output being what the character is written with, taken apart; joins: pairs (base with one mark,
    composed letter). A cluster is taken apart, its invisible characters vanish, its marks are put into canonical order, and marks
    join their base one after another as long as a join is known. Raises ValueError on a conflict: one key with two outputs, or an
    output that the mapping would change again.
    """

    def __init__(self, rules: Iterable[tuple[str, str]], joins: Iterable[tuple[str, str]] = (), hangul: bool = False):
        self.map, self.joins, self._hangul = {}, {}, hangul
        for table, pairs in ((self.map, rules), (self.joins, joins)):
            for key, out in pairs:
                if table.setdefault(key, out) != out:
                    raise ValueError(f"two outputs for {key!r}: {table[key]!r} and {out!r}")
        self._order = {k[-1]: unicodedata.combining(k[-1]) for k in self.joins}
        # what follows a base: marks, what vanishes, and what begins with a mark once it is taken apart
        follows = {c for c, out in self.map.items() if (not out or unicodedata.combining(out[0])) and len(c) == 1}
        if self.joins:
            follows |= {c for c in map(chr, range(0x300, LAST)) if unicodedata.combining(c)} | {k[-1] for k in self.joins} | (set(map(chr, _JAMO)) if hangul else set())
        self._follows = frozenset(follows)
        self._kept: dict[str, str] = {}
        changed = [c for c in self.map if len(c) > 1 or self._cluster(c) != c]
        long = [c for c in changed if len(c) > 1]
        if long:
            raise ValueError(f"keys are single characters: {long[0]!r}")
        self._ascii = any(c.isascii() for c in changed)
        self._spot = re.compile(f"{_class(''.join(follows | set(changed)))}{_class(''.join(follows)) + '*' if follows else ''}") if changed or follows else None
        for key, out in [*((c, self(c)) for c in changed), *self.joins.items()]:
            if self(out) != out:
                raise ValueError(f"the output of {key!r}, {out!r}, is changed again")

    def _joined(self, a: str, b: str) -> str | None:
        if self._hangul and "ᄀ" <= b < "ሀ":
            both = unicodedata.normalize("NFC", a + b)
            return both if len(both) == 1 else None
        return self.joins.get(a + b)

    def _cluster(self, s: str) -> str:
        out = self._kept.get(s)
        if out is None:
            if len(self._kept) > KEPT:
                self._kept.clear()
            out = self._kept[s] = self._compose("".join([self.map.get(c, c) for c in s]))
        return out

    def _compose(self, s: str) -> str:
        if not self.joins or len(s) < 2:
            return s
        done, base, marks, last = [], "", [], 0
        run: list[tuple[int, int, str]] = []
        parts: list[tuple[int, str]] = []
        for i, c in enumerate([*s, ""]):
            k = unicodedata.combining(c) if c else 0
            if k:
                run.append((k, i, c))
                continue
            parts += [(k2, m) for k2, _, m in sorted(run)]
            run = []
            if c:
                parts.append((0, c))
        for k, c in parts:
            free = not marks if k == 0 else last < k
            if base and free and (x := self._joined(base, c)) is not None:
                base = x
            elif k:
                marks.append(c)
                last = k
            else:
                done += [base, *marks]
                base, marks, last = c, [], 0
        return "".join([*done, base, *marks])

    def __call__(self, text: str) -> str:
        if self._spot is None or (not self._ascii and text.isascii()):
            return text
        out, last, follows, kept = [], 0, self._follows, self._kept.get
        for m in self._spot.finditer(text):
            i, j = m.span()
            if text[i] in follows and i > last:
                i -= 1  # its base
            s = text[i:j]
            out += (text[last:i], x if (x := kept(s)) is not None else self._cluster(s))
            last = j
        return "".join([*out, text[last:]]) if last else text


def _parts(c: str) -> str:
    """A character taken apart: canonically, and where it is a form of others that differs in width, position or typeface only."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind, _, codes = ("", "", unicodedata.decomposition(c)) if not unicodedata.decomposition(c).startswith("<") else unicodedata.decomposition(c).partition(" ")
    if not codes:
        return c
    n = "".join(chr(int(x, 16)) for x in codes.split())
    if kind == "<compat>":  # ligatures of letters
        if len(n) < 2 or not n.isalpha() or not unicodedata.name(c, "").startswith(("LATIN", "ARMENIAN")):
            return c
    elif kind and (kind not in KINDS or n.startswith((" ", "ـ")) or any(x in INVISIBLE for x in n)):
        return c
    return "".join(map(_parts, n))


def _rules(letters: bool) -> list[tuple[str, str]]:
    """Rules for single characters; letters: also those for letters, marks and digits."""
    rules = [(c, "") for c in INVISIBLE] + [(chr(x), "") for lo, hi in SELECTORS for x in range(lo, hi + 1)] + [(c, " ") for c in BLANKS]
    fixed = {c for c, _ in rules}
    for c in map(chr, range(0x80, LAST)):
        if c not in fixed and (c in LOOKALIKES or unicodedata.decomposition(c)) and (n := _parts(c)) != c and (letters or not any(x.isalnum() or unicodedata.combining(x) for x in c + n)):
            rules.append((c, n))
    return rules


def _joins() -> list[tuple[str, str]]:
    """Pairs of a base and a mark that Unicode composes; those of a look-alike are those of the letter it is taken for."""
    out = list(COMPOSED.items())
    made = set(COMPOSED.values())
    for c in map(chr, range(0x80, LAST)):
        d = unicodedata.decomposition(c)
        if not d or d.startswith("<") or " " not in d or c in made or unicodedata.normalize("NFC", c) != c:
            continue
        a, b = (chr(int(x, 16)) for x in d.split())
        if unicodedata.normalize("NFD", a)[0] not in LOOKALIKES:
            out.append((a + b, c))
    return out


def looks() -> Transducer:
    """The full mapping: texts that look the same become equal; blanks stay one for one, line ends and case stay."""
    return Transducer(_rules(letters=True), _joins(), hangul=True)


def blanks_only() -> Transducer:
    """The mapping without letters and digits: what is left of a difference is one of letters or digits."""
    return Transducer(_rules(letters=False))


FOLD = looks()
BARE = blanks_only()


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters with their marks, in the consistent form, lower-cased. Null has none."""
    return WORD.findall(FOLD(text).lower()) if text else []
