"""Text garbled by decoding in a wrong encoding (problem 8).

A code-page swap is a substitution cipher: bytes of one page read as the
letters of another.  Which swaps each source suffers from, how often, and what
each garbled symbol stands for is learned by expectation-maximization against
bigrams of the corpus' own languages:

* E: every distinct odd word of a source is read under each swap; the bigrams
  of the readings give the swaps' likelihoods.
* M: the bigrams are counted again with garbled words in their restored
  reading; swap weights and symbol-to-letter counts of each source are summed.

With these weights each document is judged as a whole and its garbled words
are restored with ``str.translate`` (one byte a letter) or by decoding the
bytes again (several bytes a letter).  CJK text has no spaces: its runs are
read part by part, from one common boundary of the letters to another.

Bigrams are counted in a hashed table of fixed size and sources share a fixed
number of slots for their weights, so what is sent to the executors is bounded
whatever the corpus, and no text is shuffled.
"""

from __future__ import annotations

import codecs
import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .confusables import _java

#: Code pages that text is wrongly read in, or was written in.
PAGES = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "iso8859_5", "cp1253")
#: Encodings of several bytes a letter.
WIDE = ("utf-8", "gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")
#: Wide encodings that text in UTF-8 is wrongly read in.
WIDE_READ = ("gb18030", "shift_jis", "big5")

BITS = 18
SIZE = 1 << BITS
#: A pair as rare as this says nothing; pairs never seen speak against a reading.
BACKGROUND, UNSEEN = 2e-6, 0.02
#: Evidence, in nats, that a word needs to count, to be restored on its own, and that a document needs.
WORD_LEAST, WORD_GAIN, DOC_GAIN = 3.0, 7.0, 6.0
MARKS = "“”‘’—–…"
#: Different words of weak evidence that must agree on a swap.
AGREEING = 3
#: Log weight of a swap not met in a source.
RARE = -6.0
PLAIN = "\\x00-\\x7f" + MARKS
#: An odd word from its first odd character on, and what ends words.
ODD, BLANK = re.compile(rf"[^{PLAIN}][^\x00-\x20]*"), re.compile(r"[\x00-\x20]")
CJK = re.compile(r"[⺀-鿿豈-﫿＀-￯]")
LOST = "�"
#: Part of a run of CJK text, which has no spaces: what a letter adds to the evidence by being valid, and what a part
#: needs first, and needs where the document's swap is known.
VALID, PART, KNOWN = 2.0, 12.0, 4.0
#: What is left of one letter in UTF-8 when its end is lost.
BROKEN = re.compile(rb"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})\Z")
TRAIL = bytes(range(0x80, 0xC0))
UTF8 = re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})")


def _sloppy(page: str) -> dict[int, int]:
    """Letter to byte of ``page``; bytes it leaves undefined stand for themselves."""
    back = {}
    for byte in range(256):
        try:
            letter = bytes([byte]).decode(page)
        except UnicodeDecodeError:
            letter = chr(byte)
        back.setdefault(ord(letter), byte)
    for byte in range(0x80, 0xA0):
        back.setdefault(byte, byte)
    return back


TO_BYTE = {page: _sloppy(page) for page in PAGES}
#: What a byte of each page was before anyone misread it.
LETTERS = {page: "".join(chr(dict((byte, letter) for letter, byte in reversed(table.items())).get(byte, byte)) for byte in range(256)) for page, table in TO_BYTE.items()}
#: One-byte swaps as tables for translate(): misread letter to true letter.
CIPHERS = {(x, y): {letter: LETTERS[y][byte] for letter, byte in TO_BYTE[x].items() if byte > 0x7F} for x in PAGES for y in PAGES if x != y}


def read(word: str, swap: tuple[str, str]) -> str | None:
    """``word`` as it was if it was written in ``swap[1]`` and read in ``swap[0]``; None if it can't have been."""
    wrong, true = swap
    if true in TO_BYTE:
        table = CIPHERS[swap]
        for c in word:
            if c > "\x7f" and ord(c) not in table:
                return None
        return word.translate(table)
    try:
        raw = word.translate(TO_BYTE[wrong]).encode("latin-1") if wrong in TO_BYTE else word.encode(wrong)
        back = raw.decode(true)
    except UnicodeError:
        return None
    return back if len(back) < len(word) or wrong not in TO_BYTE and back != word else None


@lru_cache(maxsize=1 << 16)
def encoded(letter: str, wrong: str) -> bytes | None:
    try:
        return letter.encode(wrong)
    except UnicodeError:
        return None


@lru_cache(maxsize=None)
def starts(wrong: str) -> tuple[re.Pattern, dict[str, str]]:
    """Where a piece of ``atoms`` can begin, the rest being passed over at once, and the letters that are pieces of their own."""
    able, heads, follow, whole = [], [], [], {}
    for c in map(chr, range(0x80, 0x10000)):
        if not (raw := encoded.__wrapped__(c, wrong)):
            continue
        if raw[:1] in TRAIL:
            follow.append(c)
        try:
            whole[c] = raw.decode()
            continue
        except UnicodeDecodeError:
            pass
        m = UTF8.match(raw)
        if BROKEN.match(raw, m.end() if m else 0):
            heads.append(c)
        elif m and UTF8.match(raw, m.end()):
            able.append(c)
    astral, among = "\U00010000-\U0010ffff", lambda letters: re.escape("".join(letters))
    # a letter that begins a sequence of bytes begins a piece only if the next one can go on with it or is lost
    return re.compile(rf"[\x00-\x7f]+|[{LOST}{astral}{among(whole)}{among(able)}]|[{among(heads)}](?=[?{LOST}{astral}{among(follow)}])|(?<={LOST})."), whole


def atoms(run: str, wrong: str) -> list[tuple[int, int, str]]:
    """(begin, end, back) of the least pieces of ``run`` that are UTF-8 read in ``wrong``, and of the ASCII stretches beside them.

    A piece begins and ends between letters of both encodings.  A letter of
    which bytes are lost is read as U+FFFD.
    """
    out, k, n, (start, whole), ascii = [], 0, len(run), starts(wrong), None
    while m := start.search(run, k):
        k = m.start()
        if run[k] <= "\x7f":
            ascii = (k, m.end(), m[0])
            if out and out[-1][1] == k:
                out.append(ascii)
                ascii = None
            k = m.end()
            continue
        if ascii and ascii[1] < k:
            ascii = None
        if (alone := whole.get(run[k])) is not None and not (k and run[k - 1] == LOST):
            if ascii:
                out.append(ascii)
                ascii = None
            out.append((k, k + 1, alone))
            k += 1
            continue
        raw, back, at, e = b"", "", 0, k
        while e < n and run[e] > "\x7f" and run[e] != LOST and (more := encoded(run[e], wrong)) is not None:
            raw += more
            e += 1
            if k and run[k - 1] == LOST and not at:
                at = len(raw[:3]) - len(raw[:3].lstrip(TRAIL))
            while m := UTF8.match(raw, at):
                try:
                    back += m[0].decode()
                except UnicodeDecodeError:  # surrogates, overlong forms
                    break
                at = m.end()
            if at == len(raw) or len(raw) - at > 3 or not BROKEN.match(raw, at):
                break
        if at == len(raw) > 0:
            piece = (k, e, back)
        elif e < n and run[e] in LOST + "?" and (e == k or BROKEN.match(raw, at)):
            # "?" is kept: it may be a mark of the text as well as a lost byte
            piece = (k, e + (run[e] == LOST), back + LOST)
        else:
            k += 1
            continue
        if ascii:
            out.append(ascii)
            ascii = None
        out.append(piece)
        k = max(k + 1, piece[1])
    return out


def stray(edge: tuple[int, int, str], beside: tuple[int, int, str]) -> bool:
    """Whether the piece ``edge`` is a single letter that is CJK only as it stands, and the one ``beside`` is CJK when restored."""
    begin, end, back = edge
    return end - begin == 1 and back > "\x7f" and back != LOST and not CJK.search(back) and bool(CJK.search(beside[2]))


def swaps(word: str) -> Iterator[tuple[tuple[str, str], str]]:
    """The swaps that can have made ``word``, with the word before them."""
    if CJK.search(word):
        for wrong in WIDE_READ:
            if (back := read(word, (wrong, "utf-8"))) is not None:
                yield (wrong, "utf-8"), back
        return
    high = {ord(c) for c in word if c > "\x7f" and c != LOST}
    known: dict[tuple[bytes, ...], list[tuple[str, str]]] = {}
    for wrong in PAGES:
        table = TO_BYTE[wrong]
        if not high <= table.keys():
            continue
        raw = tuple(part.translate(table).encode("latin-1") for part in word.split(LOST))
        if raw not in known:
            # pages that agree on the word's letters share their readings
            known[raw] = list(decoded(raw, word))
        for true, back in known[raw]:
            if true != wrong:
                yield (wrong, true), back


def decoded(raw: tuple[bytes, ...], word: str) -> Iterator[tuple[str, str]]:
    """The encodings in which ``raw``, cut where bytes are lost, is a text other than ``word``."""
    for true in WIDE:
        try:
            back = raw[0].decode(true) if len(raw) == 1 else mended(raw, true)
        except UnicodeDecodeError:
            continue
        if len(back) < len(word):
            yield true, back
    for true in PAGES:
        back = LOST.join(codecs.charmap_decode(part, "strict", LETTERS[true])[0] for part in raw)
        if back != word:
            yield true, back


def mended(raw: tuple[bytes, ...], true: str) -> str:
    """``raw`` decoded; what a loss leaves of a letter on either side is lost with it."""
    out = []
    for k, part in enumerate(raw):
        for skip in range(4 if k else 1):
            try:
                # a letter begun before a loss is dropped by not ending the decoder
                out.append(codecs.getincrementaldecoder(true)().decode(part[skip:], k == len(raw) - 1))
                break
            except UnicodeDecodeError:
                if skip == (3 if k else 0):
                    raise
    return LOST.join(out)


class _Side(dict):
    """A letter's share of the hash of a pair, kept once computed."""

    def __init__(self, share):
        self.share = share

    def __missing__(self, c: str) -> int:
        self[c] = h = self.share(ord(c))
        return h


LEFT = _Side(lambda c: (c * 0x9E3779B1) & (SIZE - 1))
RIGHT = _Side(lambda c: ((c * 0x85EBCA77) ^ (c >> 3)) & (SIZE - 1))


def pair(a: str, b: str) -> int:
    return LEFT[a] ^ RIGHT[b]


def framed(word: str) -> str:
    return f"^{word.lower() if word[1:].islower() else word}$"


def pairs(word: str) -> list[int]:
    """Hashed bigrams of a word, without those of two plain characters or of a lost one."""
    padded = framed(word)
    if LOST in padded:
        return [p for part in padded.split(LOST) for p in between(part)]
    return between(padded)


def between(padded: str) -> list[int]:
    return [LEFT[a] ^ RIGHT[b] for a, b in zip(padded, padded[1:]) if a > "\x7f" and a not in MARKS or b > "\x7f" and b not in MARKS]


class Model:
    """Scores words by hashed bigram counts."""

    def __init__(self, counts: np.ndarray):
        total = max(counts.sum(), 1.0)
        # in a small corpus a pair met once or twice says as little
        self.value = np.log((counts + UNSEEN) / total / max(BACKGROUND, 2.0 / total)).clip(-4.0, 10.0).tolist()
        self.readings = lru_cache(maxsize=1 << 17)(self._readings)

    def score(self, word: str, misses: float = math.inf) -> float:
        """Sum over the bigrams; minus infinity as soon as more than ``misses`` were never seen."""
        value, total, padded = self.value, 0.0, framed(word)
        for part in padded.split(LOST) if LOST in padded else (padded,):
            a, odd = "", False
            for b in part:
                was, odd = odd, b > "\x7f" and b not in MARKS
                if (odd or was) and a:
                    v = value[LEFT[a] ^ RIGHT[b]]
                    total += v
                    if v < -2.0:
                        misses -= 1
                        if misses < 0:
                            return -math.inf
                a = b
        return total

    def parts(self, run: str, wrong: str, cost: float = PART) -> tuple[str, float]:
        """``run`` with its parts restored that are UTF-8 read in ``wrong``, and the evidence for them."""
        table = self.value
        if not (each := atoms(run, wrong)):
            return run, 0.0
        value = lambda a, b: 0.0 if a == LOST or b == LOST or a <= "\x7f" and b <= "\x7f" else table[LEFT[a] ^ RIGHT[b]]
        out, gain, done, k = [], 0.0, 0, 0
        while k < len(each):
            begin, end, back = each[k]
            alone = (not k or each[k - 1][1] < begin) and (k + 1 == len(each) or each[k + 1][0] > end)
            if alone and VALID * (end - begin) + 14.0 * (end - begin + len(back) - 2) < cost + WORD_LEAST:
                k += 1  # no bigrams can say enough
                continue
            # the best part from here on: it ends where nothing speaks for it any more
            total, best, stop, first, last = 0.0, 0.0, k, k, ""
            j = k
            while j < len(each) and (j == k or each[j][0] == each[j - 1][1]):
                begin, end, back = each[j]
                if run[begin:end] != back:
                    if total <= 0.0:
                        # what stands before it is a neighbour of either reading
                        total, first, last = 0.0, j, run[max(0, begin - 1) : begin]
                    if end - begin == len(back) == len(last) == 1 and run[begin] != LOST:
                        total += value(last, back) - value(run[begin - 1], run[begin]) + VALID
                    else:
                        text = last + back
                        stood = run[begin - bool(last) : end]
                        total += sum(map(value, text, text[1:])) - sum(map(value, stood, stood[1:])) + VALID * sum(c > "\x7f" and c != LOST for c in run[begin:end])
                    if total > best:
                        best, start, stop = total, first, j + 1
                    elif total < best - cost:
                        break
                elif last:
                    total += value(last, back[0]) - value(run[begin - 1], back[0])
                last = back[-1] if back else last
                j += 1
            if best - cost >= WORD_LEAST:
                # a sound letter at the edge, valid by chance, is of another script than the part
                while stop - start > 1 and stray(each[start], each[start + 1]):
                    start += 1
                while stop - start > 1 and stray(each[stop - 1], each[stop - 2]):
                    stop -= 1
                out += [run[done : each[start][0]], *(back for _, _, back in each[start:stop])]
                done, gain, k = each[stop - 1][1], gain + best - cost, stop
            else:
                k = max(j, k + 1)
        return "".join(out) + run[done:], gain

    def _readings(self, word: str) -> tuple[tuple[tuple[str, str], str, float], ...]:
        """Swaps that read ``word`` better than it stands, the best first."""
        found, scores, stands = [], {}, None
        for swap, back in swaps(word):
            if stands is None:  # most words can't have been read from anything else
                stands = self.score(word)
            if swap[1] == "utf-8" and swap[0] in TO_BYTE:
                while (again := read(back, swap)) is not None:  # misread more than once
                    back = again
            s = scores.get(back)
            if s is None:
                s = scores[back] = self.score(back, 1 + len(back) / 6)
            gain = s - stands
            if swap[1] == "utf-8":
                kept = back.replace(LOST, "")
                # valid sequences of several bytes do not come about by chance, however often the misreading is met
                gain = max(gain, 0.0) + min(14.0, 4.0 + 3.0 * (len(kept.encode()) - len(kept)))
                s = max(s, 1.0) if plain(back) else s
            # a reading must be the languages' own, not merely less odd
            if s > 0 and gain >= WORD_LEAST:
                found.append((swap, back, gain))
        if CJK.search(word):
            for wrong in WIDE_READ:
                if all(swap[0] != wrong for swap, _, _ in found):
                    back, gain = self.parts(word, wrong)
                    if gain:
                        found.append(((wrong, "utf-8"), back, gain))
        return tuple(sorted(found, key=lambda f: -f[2]))


_MODELS: dict[str, Model] = {}


def share(spark, counts: np.ndarray, prior: tuple | None = None):
    """What all executors need, under a name of its own."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, counts, prior))


def model_of(shared) -> Model:
    """The model of shared counts; a worker keeps it, and what it has read, for its next task."""
    name, counts = shared.value[:2]
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(counts)
    return _MODELS[name]


def plain(text: str) -> bool:
    return not any(c > "\x7f" and c not in MARKS for c in text)


def speaks(word: str, swap: tuple[str, str]) -> bool:
    """Whether a reading of ``word`` is evidence: one letter alone is none, save for sequences of several bytes."""
    return swap[1] in WIDE or len(bare(word)) > 1


def bare(word: str) -> str:
    return word.strip("\"'.,;:!?()[]-“”‘’—–…")


#: What stands between the CJK letters of a run.
OTHER = re.compile(rf"(?:^|(?<=[⺀-鿿豈-﫿＀-￯]))[^⺀-鿿豈-﫿＀-￯]*[^{PLAIN}{LOST}⺀-鿿豈-﫿＀-￯][^⺀-鿿豈-﫿＀-￯]*")


def odd_spans(text: str) -> Iterator[tuple[int, int]]:
    """Where the words stand that have a character neither ASCII nor common punctuation; other words are not looked at."""
    end = 0
    for m in ODD.finditer(text):
        begin = max(end, text.rfind(" ", end, m.start()) + 1)
        before = text[begin : m.start()]
        if not before.isprintable():  # other blanks
            begin = m.start() - len(BLANK.split(before)[-1])
        end = m.end()
        yield begin, end


def odd_words(text: str) -> Iterator[str]:
    """Words with a character that is neither ASCII nor common punctuation.

    A run with CJK letters has no spaces: it is a word, and what stands between
    its CJK letters are words of their own.
    """
    for begin, end in odd_spans(text):
        word = text[begin:end]
        yield word
        if CJK.search(word):
            yield from OTHER.findall(word)


def reread(text: str, model: Model, swap: tuple[str, str], learned: dict | None = None) -> str:
    """``text`` with every word restored that ``swap`` reads better; one-byte swaps by the source's learned table."""
    table = (learned or {}).get(swap)

    def back(word: str) -> str:
        if table is not None and not CJK.search(word):
            if swap == FREE:
                return next((b for _, b, _ in freely(word, model, learned)), word)
            return word.translate(table) if any(h == swap for h, _, _ in model.readings(word)) else word
        if CJK.search(word):
            if swap[0] not in WIDE_READ:
                return OTHER.sub(lambda m: back(m[0]), word)
            if read(word, swap) is None:
                return model.parts(word, swap[0], KNOWN)[0]
        return next((b for h, b, _ in model.readings(word) if h == swap), word)

    out, done = [], 0
    for begin, end in odd_spans(text):
        out += [text[done:begin], back(text[begin:end])]
        done = end
    return "".join(out) + text[done:]


def freely(word: str, model: Model, learned: dict | None) -> list[tuple[tuple[str, str], str, float]]:
    """The reading of ``word`` by the source's table of a page that has no name."""
    table = (learned or {}).get(FREE)
    if not table or CJK.search(word) or not any(ord(c) in table for c in word):
        return []
    back = word.translate(table)
    s = model.score(back)
    gain = s - model.score(word)
    return [(FREE, back, gain)] if s > 0 and gain >= WORD_LEAST else []


def vocabulary(docs: DataFrame) -> DataFrame:
    """(source, word, n): the odd words of each source, counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for source, text in zip(b["source"], b["text"]):
                for word in odd_words(text):
                    seen[source, word] += 1
            yield pd.DataFrame([(s, w, n) for (s, w), n in seen.items()], columns=["source", "word", "n"])

    return docs.mapInPandas(count, "source string, word string, n bigint").groupBy("source", "word").agg(F.sum("n").alias("n"))


def bigrams(rows: DataFrame) -> np.ndarray:
    """Counts of hashed bigrams from rows (bucket, n): at most SIZE of them."""
    counts = np.zeros(SIZE)
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def pair_counts(words: pd.Series, n: pd.Series) -> np.ndarray:
    """Counts of hashed bigrams of many words at once; equals adding up ``pairs``."""
    padded = [framed(w) for w in words]
    code = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    a, b = code[:-1], code[1:]
    odd = (code > 0x7F) & ~np.isin(code, [ord(c) for c in MARKS])
    use = (odd[:-1] | odd[1:]) & (a != ord(LOST)) & (b != ord(LOST))
    use[np.cumsum(size)[:-1] - 1] = False  # from the end of one word to the start of the next
    weight = np.repeat(n.to_numpy(), size)[:-1]
    at = ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (b >> 3)) & (SIZE - 1)
    return np.bincount(at[use], weights=weight[use], minlength=SIZE)


def count_pairs(words: DataFrame) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            table = pair_counts(b["word"], b["n"])
            at = np.flatnonzero(table)
            yield pd.DataFrame({"bucket": at, "n": table[at].astype("int64")})

    return words.select("word", "n").mapInPandas(count, "bucket int, n bigint")


def expect(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """(source, word, n, wrong, true, back): words with their best reading, null if they stand."""
    shared = share(words.sparkSession, counts)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(shared)
        for b in batches:
            rows = []
            for word in b["word"]:
                top = model.readings(word)[:1]
                rows.append((*top[0][0], top[0][1]) if top and top[0][2] >= WORD_GAIN and speaks(word, top[0][0]) else (None, None, None))
            yield b.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("wrong", "true", "back"))})

    return words.mapInPandas(best, "source string, word string, n bigint, wrong string, true string, back string")


def learn(docs: DataFrame) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Bigram counts of the languages, (source, wrong, true, weight) of the swaps, and the words as they are read."""
    words = durable(vocabulary(docs))
    read_as = durable(expect(words, bigrams(count_pairs(words))))
    counts = bigrams(count_pairs(read_as.select(F.coalesce("back", "word").alias("word"), "n")))
    total = read_as.groupBy("source").agg(F.sum("n").alias("of"))
    garbled = read_as.where("wrong is not null").groupBy("source", "wrong", "true").agg(F.sum("n").alias("n"))
    weights = garbled.join(total.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return counts, weights.withColumn("weight", (F.col("n") + 0.5) / (F.col("of") + 1.0)), read_as


#: Sources share this many slots, so that their weights have a bounded size.
SLOTS = 4096


def slot(source: str | None) -> int:
    return 0 if source is None else 1 + zlib.crc32(source.encode()) % (SLOTS - 1)


def priors(weights: DataFrame) -> dict[int, dict[tuple[str, str], float]]:
    """Log weights of the swaps by slot of source: at most SLOTS times the number of swaps."""
    place = F.when(F.col("source").isNull(), F.lit(0)).otherwise(1 + F.crc32(F.encode("source", "UTF-8")) % (SLOTS - 1))
    out: dict = {}
    for r in weights.groupBy(place.cast("int").alias("slot"), "wrong", "true").agg(F.max("weight").alias("weight")).collect():
        out.setdefault(r.slot, {})[r.wrong, r.true] = math.log(r.weight)
    return out


#: The swap that no code page names: what it makes of each letter is learned from nothing.
FREE = ("", "")
#: Most letters, by frequency in the corpus, that a symbol can stand for; most rounds of expectation and maximization, which
#: end when no more than this share of the symbols met have changed their letter.
ALPHABET, ROUNDS, SETTLED = 192, 6, 0.01
#: A word that no page explains is looked at if other letters would fit so much better, in nats a symbol, in the place of a run
#: of its symbols, and if the run's own pairs have less evidence than this each.
LIFT, AT_HOME = 2.5, 3.0
#: Prior counts of a page's own letter, and of a letter without a page.
TRUST, LOOSE = 6.0, 0.5
#: A free letter is believed if it leads by this share of its symbol, and if so many different words, and so large a share of those with its symbol, are then words of the corpus.
WITNESSES, AGREE, LEADING = 4, 0.75, 0.35


class Cipher:
    """Forward and backward sums over the letters that the symbols of a word can stand for."""

    def __init__(self, model: Model, letters: list[str]):
        self.model, self.letters = model, letters
        self.place = {c: k for k, c in enumerate(letters)}
        self.code = np.array([ord(c) for c in letters], np.int64)
        self.table = np.exp(np.array(model.value))
        self.between = self.potentials(self.code[:, None], self.code[None, :])
        self.into = lru_cache(maxsize=1 << 12)(lambda c: self.potentials(np.int64(ord(c)), self.code))
        self.out_of = lru_cache(maxsize=1 << 12)(lambda c: self.potentials(self.code, np.int64(ord(c))))

    def potentials(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of code points, of which at least one is a letter beyond ASCII; as ``pair`` has them."""
        return self.table[((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (b >> 3)) & (SIZE - 1)]

    def strange(self, word: str) -> bool:
        """Whether other letters would fit much better in the place of one of the word's runs of symbols."""
        w, value, k = framed(word), self.model.value, 1
        while k < len(w) - 1:
            if plain(w[k]):
                k += 1
                continue
            begin = k
            while not plain(w[k]):
                k += 1
            own = sum(value[pair(w[j], w[j + 1])] for j in range(begin - 1, k))
            if own < AT_HOME * (k - begin + 1):
                best = self.into(w[begin - 1])
                for _ in range(begin + 1, k):
                    best = (best[:, None] * self.between).max(0)
                if math.log(float((best * self.out_of(w[k])).max())) > own + LIFT * (k - begin):
                    return True
        return False

    def start(self, symbol: str, swap: tuple[str, str]) -> np.ndarray:
        """What a symbol stands for before anything is learned: the page's letter above all, or what any page makes of it."""
        p = np.full(len(self.letters), 1.0 / len(self.letters))
        tables = [CIPHERS[swap]] if swap in CIPHERS else CIPHERS.values()
        for table in tables:
            k = self.place.get(table.get(ord(symbol), "").lower())
            if k is not None:
                p[k] += 9.0 / len(tables)
        return p / p.sum()

    def expected(self, word: str, theta) -> list[tuple[str, np.ndarray, bool]]:
        """(symbol, posterior over letters, at the start) of each symbol of ``word``; ``theta(symbol)`` is its present table."""
        w = f"^{word.lower() if plain(word[:1]) else word[:1] + word[1:].lower()}$"
        odd = [not plain(c) and c != LOST for c in w]
        ahead: list = [None] * len(w)
        for k, c in enumerate(w):
            if odd[k]:
                came = ahead[k - 1] @ self.between if odd[k - 1] else self.into(w[k - 1])
                f = theta(c) * came
                ahead[k] = f / max(f.sum(), 1e-300)
        out, back = [], None
        for k in range(len(w) - 1, 0, -1):
            if odd[k]:
                back = self.between @ (theta(w[k + 1]) * back) if odd[k + 1] else self.out_of(w[k + 1])
                back = back / max(back.max(), 1e-300)
                post = ahead[k] * back
                out.append((w[k], post / max(post.sum(), 1e-300), k == 1))
        return out


def alphabet(read_as: DataFrame, counts: np.ndarray) -> tuple[DataFrame, dict]:
    """The ciphers of each slot of sources, learned letter by letter.

    (slot, wrong, true, symbol, letter, n) as rows, and the believed ones as
    tables for translate().  Words that a one-byte swap explains start from
    its page, strange ones that no page explains from all pages at once; both
    are then free to become what the bigrams say.
    """
    spark = read_as.sparkSession
    shared = share(spark, counts)
    sound = F.lower(F.coalesce("back", "word"))
    each = read_as.select(F.explode(F.split(F.regexp_replace(sound, rf"[{_java(PLAIN)}⺀-鿿豈-﫿＀-￯]", ""), "")).alias("letter"), "n").where(r"letter rlike '^\\p{L}$'")
    shares = each.groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(ALPHABET).collect()
    letters = [r.letter for r in shares]

    def strange(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(shared)
        cipher, value = Cipher(model, letters), model.value
        for b in batches:
            rows, sure = [], Counter()
            for source, word, n, wrong, true, back in zip(b["source"], b["word"], b["n"], b["wrong"], b["true"], b["back"]):
                if wrong is None:
                    core = bare(word)
                    if LOST not in core and not CJK.search(core) and cipher.strange(core):
                        rows.append((slot(source), core, n, *FREE, None, None))
                elif wrong in TO_BYTE and true in TO_BYTE:
                    if min((value[p] for p in pairs(back)), default=0.0) < 0:
                        rows.append((slot(source), bare(word), n, wrong, true, None, None))
                    else:  # the page explains every letter
                        for c, letter in zip(word, back):
                            if c != letter:
                                sure[slot(source), wrong, true, c, letter.lower()] += n
            rows += [(place, None, n, wrong, true, c, letter) for (place, wrong, true, c, letter), n in sure.items()]
            yield pd.DataFrame(rows, columns=["slot", "word", "n", "wrong", "true", "symbol", "letter"])

    seen = read_as.mapInPandas(strange, "slot int, word string, n bigint, wrong string, true string, symbol string, letter string")
    # few rows, read in every round: over all cores
    garbled = durable(seen.groupBy("slot", "word", "wrong", "true", "symbol", "letter").agg(F.sum("n").alias("n")).repartition(spark.sparkContext.defaultParallelism, "slot", "word", "symbol"))
    none = spark.createDataFrame([], "slot int, wrong string, true string, symbol string, letter string, n double")
    place_of = {c: k for k, c in enumerate(letters)}
    explained: dict = {}
    for r in garbled.where("word is null").collect():  # at most SLOTS x swaps x symbols
        if r.letter in place_of:
            explained.setdefault((r.slot, r.wrong, r.true, r.symbol), []).append((place_of[r.letter], float(r.n)))
    garbled = garbled.where("word is not null").select("slot", "word", "wrong", "true", "n")
    if garbled.isEmpty():
        return none, {}
    theta: dict = explained
    for _ in range(ROUNDS):
        tables = spark.sparkContext.broadcast((letters, theta))

        def expect_letters(batches: Iterator[pd.DataFrame], tables=tables) -> Iterator[pd.DataFrame]:
            letters, theta = tables.value
            cipher, known, total = Cipher(model_of(shared), letters), {}, {}
            for b in batches:
                for place, word, wrong, true, n in zip(b["slot"], b["word"], b["wrong"], b["true"], b["n"]):
                    def table(symbol: str, key=(place, wrong, true)) -> np.ndarray:
                        p = known.get((*key, symbol))
                        if p is None:
                            p = cipher.start(symbol, key[1:])
                            learned = theta.get((*key, symbol))
                            if learned is not None:
                                p = p * (LOOSE if key[1:] == FREE else TRUST)
                                for k, m in learned:
                                    p[k] += m
                                p = p / p.sum()
                            known[(*key, symbol)] = p
                        return p

                    for symbol, post, first in cipher.expected(word, table):
                        row = total.setdefault((place, wrong, true, symbol), np.zeros((2, len(letters))))
                        row += n * post * np.array([[1], [first]])
            rows = [(*key, int(k), float(m[0, k]), float(m[1, k])) for key, m in total.items() for k in np.flatnonzero(m[0] > 0.01 * m[0].sum())]
            yield pd.DataFrame(rows, columns=["slot", "wrong", "true", "symbol", "k", "n", "first"])

        found = garbled.mapInPandas(expect_letters, "slot int, wrong string, true string, symbol string, k int, n double, first double").groupBy("slot", "wrong", "true", "symbol", "k").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
        rows = found.collect()  # at most SLOTS x swaps x symbols x 99 letters
        before, theta, start = theta, {key: list(row) for key, row in explained.items()}, {}
        for r in rows:
            theta.setdefault((r.slot, r.wrong, r.true, r.symbol), []).append((r.k, r.n))
            start[r.slot, r.wrong, r.true, r.symbol] = start.get((r.slot, r.wrong, r.true, r.symbol), 0.0) + r.first
        theta = one_to_one(theta, len(letters))
        theta = {key: list(combined(row).items()) for key, row in theta.items()}
        top = lambda t: {key: max(v, key=lambda x: x[1])[0] for key, v in t.items()}
        was, now = top(before), top(theta)
        mass = {key: sum(m for _, m in row) for key, row in theta.items()}
        # settled: hardly a letter's place is taken by another
        if sum(mass[key] for key in now if was.get(key) != now[key]) <= SETTLED * sum(mass.values()):
            break
    learned = []
    for (place, wrong, true, symbol), row in theta.items():
        k, most = max(row, key=lambda x: x[1])
        total, letter = sum(m for _, m in row), letters[k]
        if (wrong, true) in CIPHERS:
            own = CIPHERS[wrong, true].get(ord(symbol))
            if own is None or own.lower() == letter or most < TRUST or most < 0.8 * total:
                continue  # the page's own letter stands
        elif letter == symbol.lower() or most < LEADING * total:
            continue
        # case says nothing of its own: a symbol that nearly always begins words is a capital
        capital = start.get((place, wrong, true, symbol), 0.0) > 0.8 * total
        learned.append((place, wrong, true, symbol, letter.upper() if capital and len(letter.upper()) == 1 else letter, float(most)))
    if not learned:
        return none, {}
    rows = spark.createDataFrame(learned, none.schema)
    return witnessed(rows, garbled, read_as)


def combined(row: list[tuple[int, float]]) -> Counter:
    total: Counter = Counter()
    for k, m in row:
        total[k] += m
    return total


def one_to_one(theta: dict, n: int) -> dict:
    """``theta`` with the counts of free symbols shared out anew, so that a page's symbols hardly stand for the same letter."""
    out = {key: row for key, row in theta.items() if key[1:3] != FREE}
    slots: dict = {}
    for key, row in theta.items():
        if key[1:3] == FREE:
            slots.setdefault(key[0], []).append((key, row))
    for own in slots.values():
        total = np.array([sum(m for _, m in row) for _, row in own])
        p = np.zeros((len(own), n))
        for k, (_, row) in enumerate(own):
            for letter, m in row:
                p[k, letter] = m
        p /= np.maximum(total, 1e-9)[:, None]
        for _ in range(20):
            # more symbols than one for a letter: each gets less of it, those with another choice take that
            p /= np.maximum(1.0, p.sum(0))
            p /= np.maximum(p.sum(1), 1e-9)[:, None]
        for k, (key, _) in enumerate(own):
            out[key] = [(int(c), float(p[k, c] * total[k])) for c in np.flatnonzero(p[k] > 0.01)]
    return out


def witnessed(rows: DataFrame, garbled: DataFrame, read_as: DataFrame) -> tuple[DataFrame, dict]:
    """The learned letters that make words of the corpus, as rows and as tables for translate()."""
    tables: dict = {}
    for r in rows.collect():  # of fixed size, as above
        tables.setdefault((r.slot, r.wrong, r.true), {})[ord(r.symbol)] = r.letter
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def translated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for place, word, wrong, true in zip(b["slot"], b["word"], b["wrong"], b["true"]):
                table = shared.value.get((place, wrong, true))
                symbols = {c for c in word if table and ord(c) in table}
                # a word with a symbol of which nothing is known is no witness
                if symbols and all(c in symbols or plain(c) for c in word):
                    back = word.translate(CIPHERS.get((wrong, true), {}) | table).lower()
                    out += [(place, wrong, true, c, back) for c in symbols]
            yield pd.DataFrame(out, columns=["slot", "wrong", "true", "symbol", "back"])

    each = garbled.mapInPandas(translated, "slot int, wrong string, true string, symbol string, back string").distinct()
    real = read_as.select(F.lower(F.regexp_replace(F.coalesce("back", "word"), r"^[^\p{L}]+|[^\p{L}]+$", "")).alias("back")).distinct().withColumn("real", F.lit(True))
    said = each.join(real, "back", "left").groupBy("slot", "wrong", "true", "symbol").agg(F.count("*").alias("words"), F.count("real").alias("known"))
    kept = durable(rows.join(said, ["slot", "wrong", "true", "symbol"]).where(f"known >= {WITNESSES} and known >= {AGREE} * words").select(rows.columns))
    believed: dict = {}
    for r in kept.collect():
        believed.setdefault(r.slot, {}).setdefault((r.wrong, r.true), {})[ord(r.symbol)] = r.letter
    for own in believed.values():
        for swap in own:
            own[swap] = CIPHERS.get(swap, {}) | own[swap]
    return kept, believed


def restore(text: str, model: Model, prior: dict[tuple[str, str], float], learned: dict | None = None) -> tuple[bool, str]:
    """Whether ``text`` is garbled, and the text with garbled words restored.

    ``learned`` has the tables of the text's source.  Text is sometimes misread
    more than once, or in places by different swaps: it is read again until no
    swap has enough evidence or a form comes back.
    """
    garbled, forms = LOST in text, {text}
    while True:
        evidence: dict[tuple[str, str], float] = {}
        weak: dict[tuple[str, str], dict[str, float]] = {}
        for word in odd_words(text):
            for swap, _, gain in (*model.readings(word), *freely(word, model, learned)) if learned else model.readings(word):
                if speaks(word, swap):
                    if gain >= WORD_GAIN:
                        evidence[swap] = evidence.get(swap, 0.0) + gain
                    else:
                        weak.setdefault(swap, {})[bare(word)] = gain
        for swap, gains in weak.items():
            # words that say little alone, as in a garbled language the corpus has little of, agree on one swap
            if len(gains) >= AGREEING:
                evidence[swap] = evidence.get(swap, 0.0) + sum(gains.values())
        if not evidence:
            break
        swap = max(evidence, key=lambda h: evidence[h] + 0.5 * prior.get(h, RARE))
        if evidence[swap] + 0.5 * max(prior.get(swap, RARE), RARE) < DOC_GAIN:
            break
        garbled = True
        text = reread(text, model, swap, learned)
        if text in forms:
            break
        forms.add(text)
    return garbled, text


def repaired(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, restored) of each document with a garbled passage.

    Characters already lost stay lost in ``restored``.  Null and empty texts
    and texts in plain ASCII are never cases; a null source is a source of its
    own; repeated rows stay repeated; other columns are ignored.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    # most texts in English leave here, without a look at their characters one by one
    docs = docs.where((F.octet_length("text") > F.length("text")) & F.col("text").rlike(rf"[^{PLAIN}]"))
    counts, weights, words = learn(docs)
    shared = share(documents.sparkSession, counts, (priors(weights), alphabet(words, counts)[1]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, (prior, learned) = model_of(shared), shared.value[2]
        for b in batches:
            rows = []
            for key, value, source in zip(b["doc_id"], b["text"], b["source"]):
                garbled, fixed = restore(value, model, prior.get(slot(source), {}), learned.get(slot(source)))
                if garbled:
                    rows.append((key, fixed))
            yield pd.DataFrame(rows, columns=["doc_id", "restored"])

    return docs.mapInPandas(judge, f"doc_id {kind}, restored string")
