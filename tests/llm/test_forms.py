from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kashida.llm.textforms import BARE, FOLD, Transducer, words


@pytest.mark.parametrize(("a", "b"), [
    ("ＴＥＸＴ", "TEXT"), ("آگ", "آگ"), ("ﻱٔ", "ئ"), ("ئ", "ئ"), ("ﻻ", "لا"), ("ā", "ā"), ("а̄", "ā"),
    ("ａ̄", "ā"), ("كيهىە", "کیہیہ"), ("a​⁠﻿b", "ab"), ("a　b c", "a b c"), ("ΑВνо", "ABvo"), ("٠١", "۰۱"),
])
def test_same_look(a, b):
    assert FOLD(a) == FOLD(b) == b


def test_marks_are_composed():
    for c in "\u0101\u0622\u0626\u0624\u00e0\u1ea5":
        assert FOLD(unicodedata.normalize("NFD", c)) == FOLD(c) == c
    assert FOLD("\ufe8d\u0653") == "\u0622" and FOLD("\ufef1\u0654") == "\u0626" and FOLD("\uff41\u0304") == FOLD("\u0430\u0304") == "\u0101"


def test_kept():
    assert FOLD("Qāfiya à\n\tB") == "Qāfiya à\n\tB"
    assert BARE("ａ　b​ك") == "ａ bك"


def test_conflicts_are_refused():
    with pytest.raises(ValueError, match="two outputs"):
        Transducer([("a", "b"), ("a", "c")])
    with pytest.raises(ValueError, match="changed again"):
        Transducer([("a", "b"), ("b", "c")])
    with pytest.raises(ValueError, match="two outputs"):
        Transducer([], [("a\u0300", "b"), ("a\u0300", "c")])


@given(st.text(alphabet=st.sampled_from("aāَٓاآيیهہﻱٔ̄Ａ​　 \n.б")))
def test_twice_is_once(s):
    assert FOLD(FOLD(s)) == FOLD(s)


def test_canonical_spellings_of_every_character():
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]):
        assert FOLD(unicodedata.normalize("NFD", c)) == FOLD(c) == FOLD(FOLD(c))


@pytest.mark.parametrize("s", ["e\u0302\u0323", "\u0628\u0651\u064e", "\u06cc\u064e\u0654", "\u0627\u200b\u0653", "\u1100\u1161\u11a8", "\uff76\uff9e"])
def test_marks_in_any_order_and_invisibles_between(s):
    turned = s[0] + s[:0:-1] if len(s) > 2 and unicodedata.combining(s[-1]) else s
    assert FOLD(s) == FOLD(turned) == FOLD("\u2060".join(s)) == FOLD(unicodedata.normalize("NFC", s))


def test_look_alikes():
    for a, b in (("ۂ", "ۀ"), ("ة", "ۃ"), ("𝐀𝟏", "A1"), ("ɡԛαυօ", "gqauo"), ("ï", "ї"), ("a\ufe0f", "a")):
        assert FOLD(a) == FOLD(b)


@given(st.text())
def test_any_text(s):
    f = FOLD(s)
    assert BARE(s) is not None and (s.isascii() <= (f == s))


def test_words():
    assert words(None) == words("") == words(" 12 _ ;") == []
    assert words("Ab-cd ١٢ é3f") == ["ab", "cd", "é", "f"]
    assert words(unicodedata.normalize("NFD", "Qāfiya")) == ["qāfiya"]
