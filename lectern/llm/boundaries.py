"""Sentence boundaries in many scripts (problem 5).

Document-centred disambiguation: what a full stop after a short word means,
and whether a capitalised word after it is a name, is decided from places of
the same document where it is plain - the stop is followed by a small letter
or ends the paragraph, the word is capital inside a sentence or small.  Where
the document is silent the counts of the whole corpus decide; they are held in
a hashed table of fixed size.  Terminators, closing marks, quotations and
reporting clauses follow the rules of each script.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .confusables import repair

# Marks that end sentences, by script family.
STOP = ".．"
HARD = "!?！？。｡؟۔।॥՞։።፧၊။…‥⸮‽"
CLOSE = "\"'”’»›)）]］}」』】〕〉》｣"
OPEN = "\"'“‘«‹(（[［{「『【〔〈《｢„‚¿¡—–-"
NOTE = re.compile(r"(?:\[\d{1,4}\]|\(\d{1,3}\)(?=\s|$)|[*†‡§¹²³⁰-⁹]|［\d{1,4}］)+")
RUN = re.compile(rf"[{re.escape(STOP + HARD)}]+")
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "‹": "›", "｢": "｣", '"': '"'}
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Signs of scripts whose vowels and tones are no letters of their own.
SIGN = "\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0962\u0963\u0981-\u0983\u09bc-\u09d7\u0a01-\u0a51\u0b01-\u0b57\u0bbe-\u0bd7\u0c3e-\u0c56\u0d3e-\u0d4d\u0e31\u0e34-\u0e4e"
#: The word that ends before a full stop, whatever its length.
DOTTED = re.compile(rf"(?<![^\W_])(?<![{SIGN}])(?:[^\W\d_][{SIGN}]*)+$")
#: A word of WORD that ends before a full stop.
BEFORE_STOP = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*$")
#: Behind a word, a comma or a space and a word that does not begin with a small plain letter.
INSIDE = re.compile(rf"(?<=([^\W\d_]))[,\s][\W\d_]*(?![a-z])({WORD.pattern})")
TOKEN = re.compile(rf"(?:[^\W_][{SIGN}]*)+$")
THAI_LETTER = re.compile("[฀-๿]")
THAI = re.compile(r"(?<=[฀-๿”’»\"])(\s+)(?=[฀-๿“‘«\"])")

# Titles before names, believed unless they end a paragraph somewhere.
TITLES = frozenset("Mr Mrs Ms Dr St Prof Rev Capt Col Gen Sgt Lt Maj Hon Sr Sra Srta Fr Hr Frl Mme Mlle Mgr Mt".split())

# Verbs that report speech where letters have no case to tell.
REPORT_BEFORE = re.compile(r"(?:说|道|问|喊|答|叫|写道|[:：]|言った|ว่า|قال|قالت|ने कहा|say|says|said|asked|cried|called|replied|wrote|answered|whispered|shouted)\s*[,，、:：]?\s*$")
REPORT_CJK = re.compile(r"^[^。！？!?…“”「」\n]*?(?:说|道|问|喊|答|叫|嚷|讲|回应|低语)(?:[着了]?[。！？!?…，,：:]|$)")
REPORT_JA = re.compile(r"^(?:と|って|との)")
REPORT_AR = re.compile(r"^(?:و?(?:قال|قالت|سأل|سألت|صاح|صاحت|أجاب|أجابت|هتف|هتفت|رد|ردت|همس|همست|صرخ|صرخت|أضاف|أضافت))(?=\s)")
REPORT_HI = re.compile(r"^[^।॥!?“”]*?(?:कहा|पूछा|बोला|बोली|बोले|चिल्लाया|चिल्लाई|जवाब दिया|पुकारा)")

# Evidence columns of the corpus table.
SMALL, FINAL, CAPITAL, BARE, LOWER, NAME = range(6)
BITS = 18
SIZE = 1 << BITS


@lru_cache(maxsize=1 << 16)
def spelled(token: str) -> str:
    """The token in its consistent spelling, by which it is counted."""
    return token if token.isascii() else repair(token)[0]


@lru_cache(maxsize=1 << 16)
def bucket(token: str) -> int:
    h = 2166136261
    for c in token:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) & (SIZE - 1)


class Uses:
    """Uses of every word of one or more texts: (SMALL, FINAL, CAPITAL, BARE, LOWER, NAME) by word."""

    def __init__(self):
        self.words: Counter = Counter()
        self.marked: Counter = Counter()
        self.asked: set[str] = set()

    def add(self, text: str) -> None:
        self.words.update(WORD.findall(text))
        mark, k = self.marked, text.find(".")
        while k >= 0:
            before = text[max(0, k - 40) : k]
            if len(before) == 40 and " " not in before:
                before = text[:k]
            before = before.rsplit(None, 1)[-1] if before and not before[-1].isspace() else ""
            if word := DOTTED.search(before):
                after = AHEAD.match(text, k + 1)
                space, after = after.end() > k + 1, text[after.end() : after.end() + 1]
                if not after or after in CLOSE and text.index(after, k + 1) + 2 >= len(text):
                    mark[word[0], FINAL] += 1
                elif after.islower() or after in ",;:" or after.isdigit() or not space and after.isalpha() and not after.isupper():
                    mark[word[0], SMALL] += 1
                elif after.isupper():
                    mark[word[0], CAPITAL] += 1
                mark[(BEFORE_STOP.search(before) or word)[0], BARE] -= 1
            elif word := BEFORE_STOP.search(before):
                mark[word[0], BARE] -= 1
            k = text.find(".", k + 1)
        for m in INSIDE.finditer(text):
            w, at = m[2], m.start(2)
            if w[0].isupper() and (text[m.start()] == "," or m[1].islower()) and text[max(0, at - 2) : at - 1] not in STOP + HARD:
                # capital inside a sentence: after a small letter or a comma and a space
                mark[w, NAME] += 1
        if "." in text or "．" in text:
            self.asked.update(w[0].lower() + w[1:] for w in AFTER.findall(text) if w[0].isupper())

    def join(self, other: Uses) -> None:
        self.words.update(other.words)
        for k, n in other.marked.items():  # some are negative
            self.marked[k] += n

    def counts(self, telling: bool = False) -> dict[str, list[int]]:
        """The counts of all words, or of those whose uses in their own document can tell something.

        Bare and small uses tell something only of words that also have a
        stop, are names, or are the small form of a capital word after a stop.
        """
        out: dict[str, list[int]] = {}
        for (w, kind), n in self.marked.items():
            if kind != BARE or not telling:
                out.setdefault(spelled(w), [0] * 6)[kind] += n
        if telling:
            for w in self.asked:
                if w in self.words or not w.isascii():
                    out.setdefault(w, [0] * 6)
        for w, n in self.words.items():
            own = spelled(w)
            if telling and own not in out:
                continue
            row = out.setdefault(own, [0] * 6)
            row[BARE] += n + (self.marked[w, BARE] if telling else 0)
            if w[0].islower():
                row[LOWER] += n
        return out


#: What stands between a full stop and what follows it.
AHEAD = re.compile(r"\s*")
#: A capital word after a full stop, whatever marks and digits are between.
AFTER = re.compile(rf"[{re.escape(STOP)}][\W\d_]*(?![a-z])({WORD.pattern})")


class Corpus:
    """The corpus counts by word; rows once looked up are kept."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.row = lru_cache(maxsize=1 << 16)(self._row)

    def _row(self, token: str) -> tuple[float, ...]:
        return tuple(self.table[bucket(token)].tolist())


class Evidence:
    """Counts of the document first, those of the corpus where it is silent."""

    def __init__(self, corpus: Corpus | np.ndarray, document: dict[str, list[int]]):
        self.corpus = corpus if isinstance(corpus, Corpus) else Corpus(corpus)
        self.document = document

    def counts(self, token: str, kinds: tuple[int, ...]):
        own = self.document.get(token)
        if own and sum(own[k] for k in kinds) >= 2:
            return own
        return self.corpus.row(token)

    def abbreviation(self, token: str) -> str:
        """'' for a word, 'title' for one that names follow, else 'plain'."""
        if len(token) == 1 and token.isalpha() and not CJK.match(token):
            return "initial"
        own = self.document.get(token)
        if own and own[SMALL] >= 1 and own[FINAL] == 0 and own[BARE] == 0:
            return "plain"
        c = self.corpus.row(token)
        dotted = c[SMALL] + c[FINAL] + c[CAPITAL]
        if token in TITLES and c[CAPITAL] and not c[FINAL]:
            return "title"  # even where another language writes it without a stop
        if not dotted or c[BARE] > 0.5 * dotted:
            # a word that also stands without a stop is an abbreviation only where small letters follow most of its stops
            return "plain" if c[SMALL] > 3 and c[SMALL] > 0.9 * dotted and (token[0].isupper() and c[SMALL] > 0.2 * c[BARE] or c[SMALL] > 0.3 * c[BARE]) else ""
        if c[SMALL] >= 1 and c[SMALL] >= 0.2 * dotted:
            return "plain"
        if token[0].isupper() and c[FINAL] == 0 and c[CAPITAL] >= 3 and len(token) <= 5:
            return "title"
        return ""

    def name(self, word: str) -> bool:
        """Whether a capitalised word is a name rather than the start of a sentence."""
        small = word[0].lower() + word[1:]
        own, low = self.document.get(word), self.document.get(small)
        if low and low[LOWER]:
            return False
        if own and own[NAME]:
            return True
        return bool(self.corpus.row(word)[NAME] >= max(1.0, self.corpus.row(small)[LOWER]))


CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
DANDA = re.compile(r"[\u0900-\u0dff]")


def closing(text: str, k: int) -> int:
    """End of the closing marks and note marks attached at ``k``."""
    while k < len(text):
        note = NOTE.match(text, k)
        if note:
            k = note.end()
        elif text[k] in CLOSE and not (text[k] in "\"'" and opens(text, k)):
            k += 1
        elif text[k] in "   " and text[k + 1 : k + 2] in ("»", "›") and (k + 2 >= len(text) or not text[k + 2].isalnum()):
            k += 2
        else:
            break
    return k


def opens(text: str, k: int) -> bool:
    """Whether a straight quote opens: space before, none after."""
    return (k == 0 or text[k - 1].isspace() or text[k - 1] in "([—–“„«") and k + 1 < len(text) and not text[k + 1].isspace()


MARKED = re.compile(rf"['{re.escape(''.join(QUOTES))}]")


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost quotations; end is behind the closing mark."""
    spans, k, n = [], 0, len(text)
    while m := MARKED.search(text, k):
        k, c = m.start(), m[0]
        if c == "'" or c == "‘":
            # a single quote opens only before a capital letter and closes before a non-letter
            if single(text, k):
                close = "'" if c == "'" else "’"
                e = k + 1
                while (e := text.find(close, e)) != -1 and not (text[e - 1] in ",.!?…" or e + 1 >= n):
                    if c == close and single(text, e):
                        e = -1  # another one opens: this one was left open
                        break
                    e += 1
                if e != -1:
                    spans.append((k, e + 1))
                    k = e + 1
                    continue
        elif not (c == '"' and not opens(text, k)):
            ends = [e for q in QUOTES[c] if (e := text.find(q, k + 1)) != -1]
            # an opening mark before the next closing one shows that this one was left open
            if ends and (c == '"' or text.find(c, k + 1, min(ends)) == -1):
                e = min(ends) + 1
                spans.append((k, e))
                k = e
                continue
        k += 1
    return spans


def single(text: str, k: int) -> bool:
    """Whether a single quote opens: before a capital letter, not behind a letter."""
    return (k == 0 or not text[k - 1].isalnum()) and text[k + 1 : k + 2].isupper()


def reported(text: str, start: int, end: int) -> bool:
    """Whether the quotation ``start:end`` is followed by its reporting clause."""
    stop = RUN.search(text, end)
    rest = text[end : stop.end() if stop else len(text)].lstrip(" \t\r\n  ")
    if not rest:
        return False
    dash = rest[0] in "—–-"
    if dash:
        rest = rest[1:].lstrip()
    c = rest[:1]
    if c.islower() or c in ",，、;:，":
        return True
    if CJK.match(c):
        return bool(REPORT_JA.match(rest) if text[start] in "「『｢" else REPORT_CJK.match(rest))
    return bool(REPORT_AR.match(rest) or REPORT_HI.match(rest))


def segment(text: str, known: Evidence) -> list[int]:
    """Ends of the sentences of ``text``, in code points; empty for a blank text."""
    n = len(text.rstrip())
    if not n:
        return []
    ends: list[int] = []
    spans = quotations(text)
    # stops inside a quotation count only if it is one of several sentences without a reporting clause
    inside = {}
    for s, e in spans:
        led = bool(REPORT_BEFORE.search(text[max(0, s - 24) : s]))
        inside[s] = (e, led or reported(text, s, e))
    order = sorted(inside)

    def span_at(k: int):
        for s in order:
            if s > k:
                return None
            e, whole = inside[s]
            if s <= k < e:
                return s, e, whole
        return None

    k = 0
    while k < n:
        m = RUN.search(text, k)
        if not m:
            break
        start, stop = m.start(), m.end()
        k = stop
        end = closing(text, stop)
        quote = span_at(start)
        if quote:
            s, e, whole = quote
            if end < e:
                # inside the quotation: its own marks never end it early
                continue
            end = max(closing(text, e), e)
            if whole and reported(text, s, e):
                continue
        rest = text[end:n]
        after = rest.lstrip()
        if not after:
            ends.append(n)
            k = n
            break
        gap = len(rest) - len(after)
        mark = m[0]
        if ends_here(text, start, mark, end, gap, after, known, bool(quote)):
            ends.append(end)
            k = end
        else:
            k = max(k, stop)
    if not ends or ends[-1] < n:
        ends.append(n)
    return gaps(text, ends)


def ends_here(text: str, start: int, mark: str, end: int, gap: int, after: str, known: Evidence, quoted: bool) -> bool:
    first = after[0]
    opener = after.lstrip(OPEN + "   ")
    letter = opener[:1]
    # an opening dash before a small letter goes on with the sentence, as does any small letter
    if letter.islower():
        return False
    if first in ",;:，；：、、)）]" and not quoted:
        return False
    if first in ",;:，；：、":
        return False
    if mark[-1] not in STOP or len(mark) > 1:
        return True
    # a single full stop
    before = text[:start]
    previous = before[-1:]
    token = TOKEN.search(before[-40:])
    token = spelled(token[0]) if token else ""
    if DANDA.match(previous):
        # scripts with an end mark of their own use the full stop for abbreviations
        return len(token) > 4 and not re.search("[।॥]", text)
    if not gap and end == start + 1:
        if previous.isdigit() and first.isdigit():
            return False  # a decimal
        if first.isalnum() and not (first.isupper() and len(token) > 1 and token[-1].islower() or CJK.match(first)):
            return False  # a file name or a dotted abbreviation
    if first.isdigit() and known.abbreviation(token):
        return False
    if token.isdigit():
        lead = before[: len(before) - len(token)].rstrip()
        if not lead or lead[-1] in ":;：；\n" or lead[-1] in STOP + HARD and gap:
            return False  # the number of a list item
        word = WORD.match(opener)
        # an ordinal before a capital noun, as in dates of some languages
        if len(token) <= 2 and word and re.search(r"(?:^|\s)(?:[Aa]m|[Vv]om|[Zz]um|[Bb]is|[Dd]en|[Dd]er|[Dd]em|[Ss]eit|[Aa]b)$", lead):
            return False
        return True
    kind = known.abbreviation(token) if token else ""
    if not kind:
        return True
    word = WORD.match(opener)
    if not word or not word[0][0].isupper():
        # scripts without case: a short dotted token before a word goes on
        return bool(CJK.match(letter)) if kind != "initial" or letter.isalpha() else not letter.isalnum()
    if kind == "title":
        return False
    named = known.name(word[0])
    if kind == "initial":
        inner = re.search(r"(?:[^\W\d_]\.)+[^\W\d_]$", before)
        return bool(inner) and not named
    return not named or follows(known, token)


def follows(known: Evidence, token: str) -> bool:
    """Whether names after the stop of ``token`` start sentences: they seldom do where small letters never follow."""
    c = known.counts(token, (SMALL, CAPITAL))
    return bool(c[SMALL] > 0 and c[CAPITAL] <= c[SMALL] * 3)


def gaps(text: str, ends: list[int]) -> list[int]:
    """``ends`` with those of clauses that a script without end marks sets apart by gaps."""
    if text.isascii() or not THAI_LETTER.search(text):
        return ends
    out, begin = set(ends), 0
    for m in THAI.finditer(text):
        k = m.start(1)
        if k >= ends[-1]:
            break
        left = text[begin:k].rstrip()
        if text[m.end(1)] in "“‘«\"" and (left.endswith("ว่า") or "ว่า" in left[-8:]):
            continue
        if text[m.end(1)] == "ๆ":
            continue
        begin = m.end(1)
        out.add(k)
    return sorted(out)


#: Paragraphs of a chapter that are looked at together.
COPY = 1024
#: Characters of paragraphs that are handed on at a time.
PORTION = 4_000_000


def gathered(paragraphs: DataFrame) -> DataFrame:
    """Chapters with their paragraphs and the uses of their words, and, in other rows, the corpus counts by (bucket, kind).

    A chapter of more than ``COPY`` paragraphs is in several rows, each with
    its own paragraphs' uses.
    """
    place = F.coalesce(F.col("para_idx").cast("bigint"), F.pmod(F.xxhash64("full_text"), F.lit(1 << 30)))
    placed = paragraphs.withColumn("_copy", F.floor(place / COPY))
    ordered = placed.repartition("book_id", "spine_idx", "_copy").sortWithinPartitions("book_id", "spine_idx", "_copy")
    columns = ["book_id", "spine_idx", "copy", "paras", "texts", "tokens", "counts"]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, corpus, rows, size = np.zeros((SIZE, 6), np.int64), Uses(), [], 0

        def count(uses: Uses) -> None:
            for token, n in uses.counts().items():
                table[bucket(token)] += n

        def close(key: tuple, own: dict) -> None:
            uses = Uses()
            for _, text in own:
                uses.add(text)
            telling = uses.counts(telling=True)
            rows.append((*key, [p for p, _ in own], [t for _, t in own], list(telling), list(chain.from_iterable(telling.values()))))
            corpus.join(uses)

        last, own = None, {}
        for b in batches:
            spines, paras = ([None if v is None or v != v else int(v) for v in b[c]] for c in ("spine_idx", "para_idx"))
            for book, spine, copy, para, text in zip(b["book_id"], spines, b["_copy"], paras, b["full_text"]):
                if (book, spine, copy) != last:
                    if own:
                        close(last, own)
                    last, own = (book, spine, copy), {}
                    if size > PORTION:
                        yield pd.DataFrame(rows, columns=columns).assign(bucket=None, kind=None, n=None)
                        rows, size = [], 0
                    if len(corpus.words) > 200_000:
                        count(corpus)
                        corpus = Uses()
                own[para, text] = None  # repeated rows count once
                size += len(text)
        if own:
            close(last, own)
        count(corpus)
        yield pd.DataFrame(rows, columns=columns).assign(bucket=None, kind=None, n=None)
        at, kinds = np.nonzero(table)
        yield pd.DataFrame({**dict.fromkeys(columns), "bucket": at, "kind": kinds, "n": table[at, kinds]})

    types = {f.name: f.dataType.simpleString() for f in paragraphs.schema}
    schema = f"book_id {types['book_id']}, spine_idx {types['spine_idx']}, copy bigint, paras array<{types['para_idx']}>, texts array<string>, tokens array<string>, counts array<bigint>, bucket int, kind int, n bigint"
    return ordered.mapInPandas(gather, schema)


def united(chapters: DataFrame) -> DataFrame:
    """``chapters`` with the uses of words in all rows of a chapter in each of them: for chapters in several rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for book, spine, texts in zip(b["book_id"], b["spine_idx"], b["texts"]):
                uses = Uses()
                for text in texts:
                    uses.add(text)
                found = uses.counts()
                for w in uses.asked:
                    found.setdefault(w, [0] * 6)
                rows = [(book, spine, token, *n, token in uses.asked) for token, n in found.items()]
                yield pd.DataFrame(rows, columns=["book_id", "spine_idx", "token", *KINDS, "asked"]).astype({"spine_idx": "Int64"})

    types = {f.name: f.dataType.simpleString() for f in chapters.schema}
    each = chapters.select("book_id", "spine_idx", "texts").mapInPandas(count, f"book_id {types['book_id']}, spine_idx {types['spine_idx']}, token string, {', '.join(f'{k} bigint' for k in KINDS)}, asked boolean")
    uses = each.groupBy("book_id", "spine_idx", "token").agg(*(F.sum(k).alias(k) for k in KINDS), F.max("asked").alias("asked")).where("small + final + capital + name > 0 or lower > 0 and asked")
    uses = uses.groupBy(F.col("book_id").alias("_book"), F.col("spine_idx").alias("_spine")).agg(F.collect_list(F.struct("token", F.array(*KINDS).alias("n"))).alias("_seen"))
    # each row of a chapter meets a copy of its own
    rows = chapters.select("book_id", "spine_idx", "copy").distinct().withColumnsRenamed({"book_id": "_b", "spine_idx": "_s", "copy": "_c"})
    copied = uses.join(rows, F.col("_book").eqNullSafe(F.col("_b")) & F.col("_spine").eqNullSafe(F.col("_s"))).select("_book", "_spine", "_c", "_seen")
    same = F.col("book_id").eqNullSafe(F.col("_book")) & F.col("spine_idx").eqNullSafe(F.col("_spine")) & (F.col("copy") == F.col("_c"))
    return chapters.drop("tokens", "counts").join(copied, same, "left").select("book_id", "spine_idx", "paras", "texts", F.col("_seen.token").alias("tokens"), F.flatten("_seen.n").alias("counts"))


KINDS = ("small", "final", "capital", "bare", "lower", "name")


def sentences(paragraphs: DataFrame, text: str = "full_text") -> DataFrame:
    """Distinct (book_id, spine_idx, para_idx, end_pos) of all sentences.

    Null and blank texts have none; a text without an end mark is one sentence;
    repeated rows count once; other columns are ignored.
    """
    spark = paragraphs.sparkSession
    own = paragraphs.select("book_id", "spine_idx", "para_idx", F.col(text).alias("full_text")).where(F.length("full_text") > 0)
    rows = durable(gathered(own))
    table = np.zeros((SIZE, 6), np.float32)
    found = rows.where("bucket is not null").groupBy("bucket", "kind").agg(F.sum("n").alias("n")).toArrow()  # at most 6 SIZE rows
    table[found["bucket"].to_numpy(), found["kind"].to_numpy()] = found["n"].to_numpy()
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, table))
    chapters = rows.where("texts is not null").drop("bucket", "kind", "n")
    several = chapters.where("copy != 0").select("book_id", "spine_idx").distinct()
    joined = chapters.select("book_id", "spine_idx", "paras", "texts", "tokens", "counts")
    if not several.isEmpty():
        several = several.withColumnsRenamed({"book_id": "_book", "spine_idx": "_spine"})
        same = F.col("book_id").eqNullSafe(F.col("_book")) & F.col("spine_idx").eqNullSafe(F.col("_spine"))
        whole = chapters.join(several, same, "left_anti").select(joined.columns)
        joined = whole.unionByName(united(chapters.join(several, same, "left_semi")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus = Corpus(shared.value[1])
        for b in batches:
            out: dict = {"book_id": [], "spine_idx": [], "para_idx": [], "end_pos": []}
            for book, spine, paras, texts, tokens, counts in zip(b["book_id"], b["spine_idx"], b["paras"], b["texts"], b["tokens"], b["counts"]):
                document = {} if tokens is None else dict(zip(tokens, np.asarray(counts).reshape(-1, 6).tolist()))
                known = Evidence(corpus, document)
                for para, value in zip(paras, texts):
                    ends = segment(value, known)
                    out["book_id"] += [book] * len(ends)
                    out["spine_idx"] += [spine] * len(ends)
                    out["para_idx"] += [para] * len(ends)
                    out["end_pos"] += ends
            yield pd.DataFrame(out).astype({"spine_idx": "Int64", "para_idx": "Int64"})

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = f"book_id {kinds['book_id']}, spine_idx {kinds['spine_idx']}, para_idx {kinds['para_idx']}, end_pos int"
    return joined.mapInPandas(split, schema).distinct()
