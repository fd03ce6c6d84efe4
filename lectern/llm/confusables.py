"""One consistent form for text that only looks alike (problem 2).

Every token's letters have sets of scripts (Unicode script extensions, widened
for the writing systems that mix scripts by rule).  Intersecting the sets over
a token gives its resolved scripts; an empty intersection means letters of
several scripts in one word.  Of the scripts present, the one is kept in which
every letter of the token can be spelled, and look-alikes of the others are
replaced by that script's letters.  A one-letter word that is a look-alike of
a letter of its neighbours' script is a whole-script confusable and is treated
the same way.  What remains - unusual widths, joined letters, accents kept
apart, invisible characters, unusual spaces - is normalised.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin letters.
LOOKALIKES = {
    "Cyrillic": dict(zip("аеорсухіјѕԁһԛԝкмтвнАВЕЅІЈКМНОРСТУХЗѵӏ", "aeopcyxijsdhqwkmtbhABESIJKMHOPCTYX3vl")),
    "Greek": dict(zip("οανιρυκτχωγμηΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "oavipuktxwyunABEZHIKMNOPTYXcj")),
    "Armenian": dict(zip("օսհոզցյաւՏՍԼՕՀ", "ouhnqgjwlSULOZ")),
    "Cherokee": dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴᏏᏧᎵᎥᏳ", "DRTAJEWMHGZWVSLCPKBbdPiG")),
    "Coptic": dict(zip("ⲟⲣⲥⲭⲓⲕⲩⲞⲢⲤⲔⲎⲘⲚⲦⲬⲂⲀⲒⲨⲌ", "opcxikyOPCKHMNTXBAIYZ")),
}
# Letters of phonetic spelling that look like plain Latin ones; in a word of plain letters they stand for these.
PHONETIC = dict(zip("ɑɡɩʋɯ", "agivw"))
#: Writing systems made of several scripts.
SYSTEMS = {"Han": ("Jpan", "Kore", "Hanb"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",)}
#: Scripts whose normal spelling uses the joiner and the non-joiner.
JOINING = r"\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Mongolian}\p{Nko}\p{Khmer}\p{Myanmar}\p{Thai}\p{Lao}\p{Tibetan}"

SPACES = "   -   　"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
#: Letters and digits of unusual width or shape, and joined letters.
FORMS = "ĲĳŉǄ-ǌǱ-ǳ℀-⅏⼀-⿟豈-﫿ﬀ-ﭏﭐ-﷿ﹰ-ﻼ０-９Ａ-Ｚａ-ｚｦ-ﾟﾡ-ￜ\U0001d400-\U0001d7ff"
#: Characters that can make a value a case.  A value without any is in the consistent form.
SUSPECT = f"[{SPACES}{INVISIBLE}{FORMS}ɑɡɩʋɯ̀-ͯͰ-ԯԱ-֏Ⴀ-ჿᎠ-᏿ᄀ-ᇿᲀ-᲏ᴀ-ᶿⲀ-⳿゙゚Ꙁ-ꚟ]"
_INVISIBLE = regex.compile(f"[{INVISIBLE}]")
_SPACE = regex.compile(f"[{SPACES}]")
_ALLOWED = regex.compile(
    rf"(?<=[{JOINING}])[‌‍](?=[{JOINING}\s]|$)"
    r"|(?<=[\p{So}\p{Sk}️])‍(?=\p{So})|(?<=[\p{So}\p{Nd}#*])[︎️]"
    r"|(?<=\p{Mongolian})[᠋-᠏]|(?<=\p{Han})[︀-️\U000e0100-\U000e01ef]"
    r"|(?<=[\p{Khmer}\p{Myanmar}\p{Thai}\p{Lao}\p{Tibetan}])​(?=[\p{Khmer}\p{Myanmar}\p{Thai}\p{Lao}\p{Tibetan}])"
    r"|(?<=[\p{Arabic}\p{Hebrew}\s\p{P}])[‎‏؜]"
)
_WIDE_SPACE = regex.compile(r"(?<=^|\n|[\p{Han}\p{Hiragana}\p{Katakana}、-〟！-｠])　+")
_FORM = regex.compile(f"[{FORMS}]")
_APART = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Hiragana}\p{Katakana}][̀-゙゚ͯ]+|[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
#: A phonetic letter inside a word of at least two plain letters, and no other phonetic sign near.
_PHONETIC = regex.compile(rf"(?<![\p{{L}}\p{{M}}/\[ˈˌː])(?=[A-Za-z{''.join(PHONETIC)}]*[{''.join(PHONETIC)}])(?=[{''.join(PHONETIC)}]*[A-Za-z][{''.join(PHONETIC)}]*[A-Za-z])[A-Za-z{''.join(PHONETIC)}]+(?![\p{{L}}\p{{M}}/\]ˈˌː])")
_SCRIPTS = [(n, regex.compile(rf"\p{{scx={n}}}")) for n in ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Arabic", "Hebrew", "Armenian", "Georgian", "Cherokee", "Coptic", "Thai", "Lao", "Devanagari", "Bengali", "Tamil", "Telugu", "Khmer", "Myanmar", "Ethiopic", "Mongolian")]
#: Scripts written without spaces, next to which another script may stand.
UNSPACED = {"Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Jpan", "Kore", "Hanb", "Thai", "Lao", "Khmer", "Myanmar"}
TO_LATIN = {c: x for letters in LOOKALIKES.values() for c, x in letters.items()}
FROM_LATIN = {script: {x: c for c, x in reversed(letters.items())} for script, letters in LOOKALIKES.items()}
TO_PLAIN = {ord(c): x for c, x in PHONETIC.items()}
OWNER = {c: script for script, letters in LOOKALIKES.items() for c in letters}


@lru_cache(maxsize=1 << 16)
def scripts(char: str) -> frozenset[str]:
    """Scripts a letter belongs to; empty if it goes with any."""
    found = set()
    for name, pattern in _SCRIPTS:
        if pattern.fullmatch(char):
            found.add(name)
            found.update(SYSTEMS.get(name, ()))
    return frozenset(found)


def spell(char: str, script: str) -> str | None:
    """``char`` or its look-alike in ``script``; None if there is none."""
    own = scripts(char)
    if not own or script in own:
        return char
    latin = TO_LATIN.get(char, char)
    if script == "Latin":
        return latin if char in TO_LATIN else None
    return FROM_LATIN.get(script, {}).get(latin)


def words(token: str) -> list[str]:
    """``token`` cut where a script without spaces meets another."""
    parts: list[list] = []
    for c in token:
        own = scripts(c)
        side = bool(own & UNSPACED) if own else (parts[-1][0] if parts else False)
        if parts and parts[-1][0] == side:
            parts[-1][1] += c
        else:
            parts.append([side, c])
    return [p for _, p in parts]


@lru_cache(maxsize=1 << 16)
def consistent(token: str) -> tuple[str, bool]:
    """The token in one script, and whether its letters were of several."""
    out, mixed = [], False
    for word in words(token):
        sets = [s for s in map(scripts, word) if s]
        if not sets or frozenset.intersection(*sets):
            out.append(word)
            continue
        mixed = True
        present = {n for s in sets for n in s}
        # letters that no other script present can spell
        own = {n: sum(n in scripts(c) and all(n == k or spell(c, k) is None for k in present) for c in word) for n in present}
        whole = [n for n in present if all(spell(c, n) is not None for c in word)]
        # of the scripts that can spell the word, the one with most letters of its own alone
        best = max(whole or present, key=lambda n: (own[n], sum(n in s for s in sets), n == "Latin", n))
        out.append("".join(spell(c, best) or c for c in word))
    return "".join(out), mixed


def repair(text: str) -> tuple[str, bool]:
    """The consistent form, and whether a character was of the kinds that count."""
    case = False
    if _INVISIBLE.search(text):
        keep = {m.start() for m in _ALLOWED.finditer(text)}
        kept = [c for k, c in enumerate(text) if k in keep or not _INVISIBLE.match(c)]
        case |= len(kept) < len(text)
        text = "".join(kept)
    if _SPACE.search(text):
        case |= bool(_SPACE.search(_WIDE_SPACE.sub("", text)))
        text = _SPACE.sub(" ", text)
    if _FORM.search(text):
        # signs such as the degree Celsius are no letters; they stay as they are
        new = _FORM.sub(lambda m: f if (f := unicodedata.normalize("NFKC", m[0])) != m[0] and f.isalnum() and unicodedata.category(m[0])[0] in "LN" or unicodedata.category(m[0]) in ("Ll", "Lu", "Lt", "Lo") else m[0], text)
        case |= new != text
        text = new
    if any(unicodedata.normalize("NFC", m[0]) != m[0] for m in _APART.finditer(text)):
        case = True
    text = unicodedata.normalize("NFC", text)
    if not text.isascii():
        plain = _PHONETIC.sub(lambda m: m[0].translate(TO_PLAIN), text)
        case |= plain != text
        text = plain
        mixed = []

        def one(m) -> str:
            if m[0].isascii():
                return m[0]
            form, several = consistent(m[0])
            mixed.append(several)
            return form

        text = _TOKEN.sub(one, text)
        case |= any(mixed)
        letters = [m[0] for m in _TOKEN.finditer(text)]
        lone = {w for w in letters if len(w) == 1 and w in OWNER}
        if lone:
            latin = sum(len(w) for w in letters if "Latin" in scripts(w[0]))
            if latin * 2 > sum(map(len, letters)):
                text = _TOKEN.sub(lambda m: TO_LATIN[m[0]] if m[0] in lone else m[0], text)
                case = True
    return text, case


def suspect(column: str) -> Column:
    """True for values that may be cases; runs inside the JVM, at the cost of two lengths for plain ASCII."""
    return (F.octet_length(column) > F.length(column)) & F.col(column).rlike(_java(SUSPECT))


def _java(pattern: str) -> str:
    """The same class in the JVM's notation for code points."""
    return re.sub(r"[^\x00-\x7f]", lambda m: f"\\x{{{ord(m[0]):x}}}", pattern)


def normalised(df: DataFrame, column: str, out: str = "normal", flag: str = "was_case") -> DataFrame:
    """``df`` with the consistent form of ``column`` and whether it was a case.

    Rows without a suspect character never leave the JVM.  Null gives null and
    false; an empty text stays empty.  Repeated rows stay; other columns are
    untouched, except that ``out`` and ``flag`` are replaced if present.
    """
    df = df.drop(out, flag)
    plain = F.coalesce(~suspect(column), F.lit(True))
    clean = df.where(plain).withColumn(out, F.col(column)).withColumn(flag, F.lit(False))

    @F.pandas_udf(f"`{out}` string, `{flag}` boolean")
    def fix(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(v) for v in values], columns=[out, flag])

    dirty = df.where(~plain).withColumn("_fixed", fix(F.col(column))).withColumn(out, F.col("_fixed").getField(out)).withColumn(flag, F.col("_fixed").getField(flag)).drop("_fixed")
    return clean.unionByName(dirty)


def cases(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` of the rows whose ``column`` needed another form."""
    schema = df.select(*keys).schema

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = [repair(v)[1] for v in b[column]]
            yield b.loc[hit, keys]

    return df.select(*keys, column).where(suspect(column)).mapInPandas(search, schema).distinct()
