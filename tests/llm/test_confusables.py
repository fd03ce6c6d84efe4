"""Problem 2."""

from __future__ import annotations

import pytest

from lectern.llm import confusables as C


@pytest.mark.parametrize(
    "text, form, case",
    [
        ("plain text, “quoted” — café", "plain text, “quoted” — café", False),
        ("ｗｈｏｌｅ １２", "whole 12", True),
        ("fiance\u0301e", "fianc\u00e9e", True),
        ("ﬁrm", "firm", True),
        ("mes​sage", "message", True),
        ("a­b﻿", "ab", True),
        ("a b c", "a b c", True),
        ("mеѕsage", "message", True),  # Cyrillic е and ѕ
        ("стаpое", "старое", True),  # Latin p
        ("ветер λόγος 中文和Tamare", "ветер λόγος 中文和Tamare", False),
        ("क‍ष", "क‍ष", False),
        ("ﻻ", "لا", True),
        ("а big dog", "a big dog", True),
        ("И мы с ним", "И мы с ним", False),
        ("\u304b\u3099", "\u304c", True),
        ("　　木匠", "  木匠", False),
        ("21 ℃ №", "21 ℃ №", False),
        ("", "", False),
        ("line\n\tbreak  double", "line\n\tbreak  double", False),
    ],
)
def test_repair(text, form, case):
    assert C.repair(text) == (form, case)
    assert C.repair(form) == (form, False) or not case


@pytest.mark.parametrize("script", sorted(C.LOOKALIKES))
def test_every_script(script):
    for letter, latin in C.LOOKALIKES[script].items():
        if latin.isalpha():
            form, case = C.repair(f"wor{letter}dsqf")
            assert (form, case) == (f"wor{latin}dsqf", True), letter
            assert C.repair(form) == (form, False)
            if script in ("Armenian", "Cherokee", "Coptic"):
                word = letter * 3
                assert C.repair(f"the {word} stays") == (f"the {word} stays", False)


def test_phonetic_letters():
    assert C.repair("pɑypal and dɑɡs") == ("paypal and dags", True)
    assert C.repair("said /ɡɑd/ and [kɑt], ˈɡɑd, ɑ") == ("said /ɡɑd/ and [kɑt], ˈɡɑd, ɑ", False)
    assert C.repair("w\u0585rd \u13aapple") == ("word Apple", True)


def test_suspects_hold_all_cases(spark):
    """The JVM's first look never drops what the full check would find."""
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]]
    df = spark.createDataFrame([(k, f"wo{c}rd") for k, c in enumerate(chars)], "k int, t string")
    suspect = {r.k for r in df.where(C.suspect("t")).select("k").collect()}
    missed = [c for k, c in enumerate(chars) if k not in suspect and C.repair(f"wo{c}rd")[1]]
    # scripts that have no look-alikes of Latin letters may be mixed in one word without the first look
    assert [c for c in missed if c in C.OWNER or C._INVISIBLE.match(c) or C._SPACE.match(c) or C._FORM.match(c)] == []


def test_columns(spark):
    rows = [(1, "pеn", "x"), (1, "pеn", "x"), (2, "pen", None), (3, None, None), (4, "", None), (None, "ａ" * 100_000, None)]
    df = spark.createDataFrame(rows, "k int, t string, normal string")
    assert {r.k for r in C.cases(df, "t", ["k"]).collect()} == {1, None}
    out = C.normalised(df, "t").collect()
    assert sorted((r.k or 0, (r.normal or "")[:3], r.was_case) for r in out) == [(0, "aaa", True), (1, "pen", True), (1, "pen", True), (2, "pen", False), (3, "", False), (4, "", False)]
    assert C.cases(df.limit(0), "t", ["k"]).count() == 0
