"""Defective pairs of a sentence and its explanation (problems 1 and 3).

Problem 3: each answer is read by a pushdown parser of its sections, glosses,
quotations, brackets, fences and list items, which tells whether it ends
inside one of them.  Greedy string tiling between question and answer finds
what the answer merely gives back; script checks on the rest find answers in
another language; a small grammar finds refusals.

Problem 1: the parser cuts every answer into units - clauses, glosses, quoted
meanings.  Prefixes of all whole units of all answers are hashed, and every
ending of an answer's open unit is joined to them.  An open unit of which an
ending is a strict prefix of longer units, and none a whole unit, breaks off
in the middle; one of which no ending is known is left alone; where an ending
also stands whole elsewhere, an exact check follows: it is complete if it says
the last word of the question that any answer explains.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENTENCE, durable

# The section marks of a note.
SECTIONS = ("分析", "整体翻译", "单词解释")
MARK = re.compile(r"(?:分析|整体翻译|单词解释)\s*[：:]")
# Phrases that only introduce an answer.
OPENING = re.compile(r"^(?:\s|好的|当然|可以|没问题|以下是说明|以下是解释|说明如下|解释如下|句子|原文|sure|certainly|of course|[，,。.!！：:])+", re.I)
CLOSED = set("。！？!?.…｡︒～~")
PAIRS = {"（": "）", "(": ")", "“": "”", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "[": "]", "〔": "〕", "‘": "’", "{": "}"}
CLOSERS = {c: o for o, c in PAIRS.items()}
HAN = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")
KANA = re.compile(r"[\u3040-\u30ff]")
WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
DIGIT = re.compile(r"\d")
#: Separators inside a number.
NUMBER = re.compile(r"(?<=\d)[.,](?=\d)")

# Grammar of refusals, in any order within a sentence: who declines (an actor or an excuse), that it is declined, and what
# is (an act of explaining, or the thing asked about).
_ZH = {
    "actor": r"我|本模型|本助手|本人|(?:语言)?模型|助手|人工智能|\bAI\b",
    "excuse": r"抱歉|不好意思|对不起|遗憾|对不住|原谅|见谅|恕|惭愧|请换|换一(?:个|句)|请另|违反|不适当|不合适|敏感",
    "denial": r"无法|不能|没法|没有?办法|不便|不可以|难以|拒绝|不会|不愿|无力|未能|不予|不想|不方便|无能为力|爱莫能助|[帮做办答译讲看解说处理释析]{1,2}不(?:了|到|出|来|得)|不到|超出[^，。]{0,12}(?:能力|范围)|不在[^，。]{0,10}范围",
    "object": r"解释|处理|完成|提供|分析|协助|帮助|帮|回答|翻译|说明|回应|满足|答复|讨论|讲解|解读|请求|要求|(?:这|该|此|本)(?:个|句|段|条)?(?:句子|句话|话|内容|文本|原文|问题|句)|句子",
}
_EN = {
    "actor": r"\b(?:i|we|me|my|us|assistant|language model|ai|model)\b",
    "excuse": r"\b(?:sorry|afraid|unfortunately|apolog\w+|regret\w*|forgive|excuse|another (?:one|sentence)|policy|guidelines|inappropriate)\b",
    "denial": r"\b(?:can\s?not|can['’]?t|won['’]?t|will not|unable|not able|not possible|impossible|not allowed|not permitted|decline|refuse|could\s?n['’]?t|could not|do not|don['’]?t|must not|may not|not comfortable|beyond|outside|out of)\b",
    "object": r"\b(?:help\w*|assist\w*|explain\w*|explanation|translat\w+|compl(?:y|ete|eting)|provid\w+|process\w*|analy[sz]\w+|answer\w*|discuss\w*|request|sentence|content|text|passage|do|comment\w*|scope|that|this)\b",
}
GRAMMARS = [{part: re.compile(pattern, re.I) for part, pattern in language.items()} for language in (_ZH, _EN)]
BEFORE_GLOSS = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ’'](?=[（(“「『])")
ATTACHED = re.compile(r"[^\W_][（(]")
SENTENCES = re.compile(r"[^。！？!?]+?(?:[。！？!?]|\.(?=\s|$)|$)")
#: A gloss: a word and, in brackets or quotation marks behind it, Han characters.
GLOSSED = re.compile(r"[^\W\d_]\s*[（(][^）)]*[\u3400-\u9fff]|[A-Za-z’'][\u3400-\u9fff]*[“「『\"][^”」』\"]*[\u3400-\u9fff]")


def refuses(content: str, asked: set[str]) -> bool:
    """Whether one of the first two sentences declines, and no word of the question is glossed."""
    for m in islice(SENTENCES.finditer(content), 2):
        # an actor or an excuse, a denial and its object in the same sentence, in any order
        if any(g["denial"].search(m[0]) and g["object"].search(m[0]) and (g["actor"].search(m[0]) or g["excuse"].search(m[0])) for g in GRAMMARS):
            return not (GLOSSED.search(content) and any(asked.intersection(words(content[: w.end()])[-4:]) for w in BEFORE_GLOSS.finditer(content)))
    return False


def body(note: str) -> str:
    """The note without its section marks and introduction."""
    return OPENING.sub("", MARK.sub(" ", note).strip()).strip()


def words(text: str) -> list[str]:
    text = NUMBER.sub("", text)
    return WORD.findall(unicodedata.normalize("NFKC", text).casefold() if not text.isascii() else text.casefold())


def tiles(a: list[str], b: list[str], least: int = 3) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: which words of ``a`` and of ``b`` common runs cover.

    Longest runs first; a word of ``b`` may be given back several times.
    """
    least = max(1, min(least, len(a), len(b)))
    at_a, at_b = [False] * len(a), [False] * len(b)
    where: dict[tuple, list[int]] = {}
    for j in range(len(b) - least + 1):
        where.setdefault(tuple(b[j : j + least]), []).append(j)
    runs, first = [], {t[0] for t in where}
    for i in [k for k, w in enumerate(a[: len(a) - least + 1]) if w in first]:
        for j in where.get(tuple(a[i : i + least]), ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # not the start of its run
            n = least
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            runs.append((n, i, j))
    for n, i, j in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
        # what earlier, longer tiles have left of the run
        k = 0
        while k < n:
            m = k
            while m < n and not at_a[i + m]:
                m += 1
            if m - k >= least:
                at_a[i + k : i + m] = [True] * (m - k)
                at_b[j + k : j + m] = [True] * (m - k)
            k = max(m, k) + 1
    return at_a, at_b


#: What the parser looks at: fences, section marks, brackets, quotations and the ends of clauses.
SIGNS = re.compile(rf"```|{MARK.pattern}|[{re.escape(''.join(PAIRS) + ''.join(CLOSERS))}\"，,、；;。！？!?\n]")


class Parse:
    """What the pushdown parser finds at the end of a note."""

    __slots__ = ("stack", "unit", "open")

    def __init__(self, note: str):
        stack: list[str] = []
        unit = 0
        for m in SIGNS.finditer(note):
            c, k, unit = m[0], m.start(), m.end()
            if stack and stack[-1] == "```":
                if c == "```":
                    stack.pop()
            elif c == "```":
                stack.append(c)
            elif len(c) > 1:
                stack.clear()  # a new section closes whatever was left open
            elif c in PAIRS:
                if not (c == "‘" and k and note[k - 1].isalpha()):
                    stack.append(c)
            elif c in CLOSERS:
                if CLOSERS[c] in stack:
                    while stack.pop() != CLOSERS[c]:
                        pass
            elif c == '"':
                stack.pop() if stack and stack[-1] == '"' else stack.append('"')
        self.stack = stack
        #: what stands behind the last sign
        self.unit = note[unit:].strip()
        last = note[-1:]
        if last == "�":
            self.open = True
        elif stack:
            self.open = True
        elif not last or last in CLOSED or last in CLOSERS or last in '"*_`':
            self.open = False
        else:
            self.open = True


def judge(text: str | None, note: str | None) -> tuple[str, str, bool]:
    """(defect, open unit, sure): the defect the pair itself shows, or ``open``.

    ``sure`` holds for an end inside a bracket, quotation, gloss or character,
    which no missing full stop explains.
    """
    stripped = (note or "").strip("﻿​ \t\r\n　")
    content = body(stripped)
    inner = words(content)
    if not inner or not any(c.isalnum() for c in content):
        return ("open", "", True) if stripped.endswith("�") else ("empty", "", False)
    asked = words(text or "")
    in_note, in_text = tiles(inner, asked, 3 if len(asked) > 7 else 1)
    letters = [len("".join(compress(inner, in_note))), len("".join(inner))]
    joined = "".join(asked)
    backed = len("".join(compress(asked, in_text))) / max(1, len(joined))
    parse = Parse(stripped)
    added = in_note.count(False)
    untiled = [w for w, t in zip(inner, in_note) if not t]
    if asked and backed >= 0.75 and (letters[0] >= 0.75 * letters[1] or added <= max(2, len(inner) // 4)):
        # a copy says hardly anything in Chinese: a remark in brackets; a section with glosses is an attempt to explain
        said = len(HAN.findall("".join(untiled)))
        if said <= 6 and not (MARK.search(stripped) and (said or ATTACHED.search(content))):
            return "copy", "", False
    source = set(asked)
    if refuses(content, source):
        return "refusal", "", False
    own = "".join([w for w in untiled if w not in source and (len(w) == 1 or not (len(w) > 3 and w in joined)) and not w.isdigit()])
    han, kana, rest = len(HAN.findall(own)), len(KANA.findall(own)), len(own) - len(DIGIT.findall(own))
    if rest and (kana > 0.15 * (han + kana) if han + kana > 0.5 * rest else rest >= 12 and not HAN.search(MARK.sub("", stripped))):
        return "language", "", False
    if rest >= 12 and han < 0.25 * rest and letters[0] < 0.6 * letters[1]:
        return "language", "", False
    if parse.open:
        return "open", parse.unit.removesuffix("�"), bool(parse.stack) or stripped[-1] in "�，,、；;：:（“"
    return "", "", False


#: A letter of a script with spaces.
LETTER = re.compile(r"(?![\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])\w")
BASE = 0x9E3779B97F4A7C15 | 1
#: Slots in which keys of endings are noted before prefixes are looked for.
SLOTS = 1 << 23
UNBASE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base², … modulo 2^64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Hashed:
    """Hashes of all stretches of a list of units, by sums of powers modulo 2^64."""

    def __init__(self, units: list[str]):
        code = np.frombuffer("".join(units).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        self.size = np.fromiter(map(len, units), np.int64, len(units))
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.total = np.concatenate([[np.uint64(0)], np.add.accumulate((code + np.uint64(1)) * powers(BASE, len(code)))])
        self.back = powers(UNBASE, len(code) + 1)

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Keys of the stretches a:b."""
        h = (self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ h >> np.uint64(29)).view(np.int64)


def units(note: str) -> tuple[list[str], str]:
    """The whole units of a note - its section marks and what stands between its signs - and its open end."""
    parts = SIGNS.split(note)
    return [u for p in parts[:-1] if (u := p.strip())] + [m.rstrip("：: \n") for m in MARK.findall(note)], parts[-1].strip()


def prefixes(notes: list[str], wanted: np.ndarray | None = None) -> pd.DataFrame:
    """Keys of all prefixes of units, how often they stand whole and how often they go on.

    With ``wanted`` those whose slot is not marked there are left out.
    """
    each, open_ = [], []
    for note in notes:
        whole, end = units(note)
        each += whole
        if len(end) > 1:
            open_.append(end)
    n, each = len(each), each + open_
    if not each:
        return pd.DataFrame({"_piece": [], "whole": [], "longer": []}).astype("int64")
    hashed = Hashed(each)
    begin = np.repeat(hashed.begin, hashed.size)
    key = hashed.key(begin, np.arange(1, len(begin) + 1))
    is_end, is_whole = np.zeros(len(key), bool), np.zeros(len(key), bool)
    is_end[hashed.end - 1], is_whole[hashed.end[:n] - 1] = True, True
    if wanted is not None:
        use = wanted[key & (SLOTS - 1)]
        key, is_end, is_whole = key[use], is_end[use], is_whole[use]
    keys, at = np.unique(key, return_inverse=True)
    ends = np.bincount(at[is_end], minlength=len(keys))
    whole = np.bincount(at[is_whole], minlength=len(keys))
    return pd.DataFrame({"_piece": keys, "whole": whole, "longer": np.bincount(at, minlength=len(keys)) - ends})


def endings(unit: str) -> list[int]:
    """Keys of all endings of an open unit that begin with a word or a character of a script without spaces."""
    starts = [k for k, c in enumerate(unit) if c.strip() and not (k and LETTER.match(c) and LETTER.match(unit[k - 1]))]
    if not starts:
        return []
    return Hashed([unit]).key(np.array(starts), np.full(len(starts), len(unit))).tolist()


def glosses(note: str) -> list[tuple[str, str]]:
    """(word, meaning) of the word list of a note."""
    return [(w.casefold(), m) for w, m in GLOSS.findall(note)]


#: A word, whatever Chinese joins it to its meaning, and the meaning in quotation marks.
GLOSS = re.compile(r"((?:(?![\u3040-\u30ff\u3400-\u9fff])[\w\-’'])+)\s*[\u3400-\u9fff]*[“「『\"]([^“”「」『』\"]+)[”」』\"]")


def judged(notes: DataFrame, text: str = "text", answer: str = "note_content", error: str = "note_error", keys: list[str] | None = None) -> DataFrame:
    """Distinct (keys, answer, defect, longer) of all pairs.

    ``defect`` is null for sound pairs and those of provider errors, else one
    of ``empty``, ``truncated``, ``refusal``, ``copy``, ``language``.
    ``longer`` counts the longer units that an open end is a strict prefix of.  A null
    question is compared as an empty one; a null error flag means no error;
    repeated rows count once; other columns are ignored.
    """
    keys = keys or SENTENCE
    own = notes.select(*keys, F.col(text).alias("_text"), F.col(answer).alias("_answer"), F.coalesce(F.col(error), F.lit(False)).alias("_error")).distinct()

    @F.pandas_udf("defect string, tail string, sure boolean, endings array<bigint>")
    def first(asked: pd.Series, answered: pd.Series) -> pd.DataFrame:
        rows = [judge(a, b) for a, b in zip(asked, answered)]
        out = pd.DataFrame(rows, columns=["defect", "tail", "sure"])
        out["endings"] = [endings(tail) if defect == "open" else None for defect, tail, _ in rows]
        return out

    sound = own.where(~F.col("_error"))
    # read again below: written once, so that the parser runs once
    seen = durable(sound.withColumn("_j", first("_text", "_answer")).select(*keys, "_text", "_answer", "_j.*"))
    errors = own.where("_error").select(*keys, "_answer", F.lit(None).cast("string").alias("defect"), F.lit(None).cast("bigint").alias("longer"))
    done = seen.where("defect != 'open'").select(*keys, "_answer", F.when(F.col("defect") != "", F.col("defect")).alias("defect"), F.lit(None).cast("bigint").alias("longer"))
    return done.unionByName(errors).unionByName(_truncated(seen, keys)).withColumnRenamed("_answer", "answer")


def _truncated(seen: DataFrame, keys: list[str]) -> DataFrame:
    """The open ends of ``seen``, each with its longer copies elsewhere."""
    done = open_ends(seen, keys)
    return done.select("_key.*", F.when(F.col("cut"), F.lit("truncated")).alias("defect"), "longer")


def open_ends(seen: DataFrame, keys: list[str]) -> DataFrame:
    """(_key, tail, sure, whole, longer, complete, cut) of each open end of ``seen``.

    ``whole`` and ``longer`` tell how often an ending stands whole elsewhere
    and how often it goes on; ``complete`` is the exact check of ends that
    stand whole.
    """
    ends = seen.where("defect = 'open'").select(F.struct(*keys, "_answer").alias("_key"), "_text", "tail", "sure", "endings")
    tries = ends.select("_key", F.explode("endings").alias("_piece"))
    # slots of the endings that are asked for: at most SLOTS of them, whatever the corpus; the other prefixes stay where they are
    asked_for = np.zeros(SLOTS, bool)
    slots = tries.select((F.col("_piece").bitwiseAND(F.lit(SLOTS - 1))).cast("int").alias("slot")).distinct().toArrow()["slot"]
    asked_for[slots.to_numpy()] = True
    shared = seen.sparkSession.sparkContext.broadcast(np.packbits(asked_for))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.unpackbits(shared.value).view(bool)
        for b in batches:
            for lo in range(0, len(b), 4000):
                notes = b["_answer"].iloc[lo : lo + 4000].tolist()
                yield prefixes(notes, wanted).assign(word=None, meaning=None, n=0)
                count = Counter(g for note in notes for g in glosses(note))
                if count:
                    rows = pd.DataFrame([(*g, n) for g, n in count.items()], columns=["word", "meaning", "n"])
                    yield rows.assign(_piece=0, whole=0, longer=0)[["_piece", "whole", "longer", "word", "meaning", "n"]]

    rows = durable(seen.where("length(_answer) > 0").select("_answer").mapInPandas(places, "_piece bigint, whole bigint, longer bigint, word string, meaning string, n bigint"))
    known = rows.where("word is null").groupBy("_piece").agg(F.sum("whole").alias("whole"), F.sum("longer").alias("longer"))
    meaning = rows.where("word is not null").groupBy("word", "meaning").agg(F.sum("n").alias("n"))
    meaning = meaning.groupBy("word").agg(F.max_by("meaning", F.struct("n", "meaning")).alias("meaning"))
    onward = looked_up(tries, known, "_piece").groupBy("_key").agg(F.sum("whole").alias("whole"), F.max("longer").alias("longer"))
    ends = ends.join(onward, "_key", "left").withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn("longer", F.coalesce("longer", F.lit(0)))
    # exact check: the end gives the meaning of the question's last glossed word, and only the full stop is missing
    asked = ends.where(~F.col("sure") & (F.col("whole") > 0)).select("_key", "tail", F.posexplode(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}[\p{L}\-’']*"), F.lit(0))).alias("_at", "word"))
    said = looked_up(asked, meaning, "word").groupBy("_key", "_at").agg(F.max(F.col("tail").endswith(F.col("meaning"))).alias("_said"))
    last = said.groupBy("_key").agg(F.max_by("_said", "_at").alias("complete"))
    cut = F.col("sure") | F.when(F.col("whole") > 0, ~F.coalesce(F.col("complete"), F.lit(False))).otherwise(F.col("longer") > 0)
    return ends.join(last, "_key", "left").withColumn("cut", cut).drop("_text", "endings")


#: A key that many rows ask for is looked up in so many places.
SALT = 16


def looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``values``, which has one row a ``key``; no key of ``rows``, however frequent, goes to one task."""
    wanted = values.join(rows.select(key).distinct(), key, "left_semi")
    copies = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALT)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")


def by_source(notes: DataFrame, source: str = "model", error: str = "note_error", **names) -> DataFrame:
    """Notes, truncated notes and their share for each ``source``.

    Provider errors are no notes here; a null source is a source of its own.
    """
    found = judged(notes.where(~F.coalesce(F.col(error), F.lit(False))), error=error, keys=[*SENTENCE, source], **names)
    cut = F.count_if(F.col("defect") == "truncated")
    return found.groupBy(source).agg(F.count("*").alias("n_notes"), cut.alias("n_truncated"), F.round(cut / F.count("*"), 6).alias("share"))
