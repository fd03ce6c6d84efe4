"""Reading level of documents (problem 4).

Every sentence is classified by an L2-regularised softmax regression on words
and on character n-grams inside words.  The sentence
distributions of a document are averaged and a second regularised regression, fitted on
predictions for held-out passages, turns the average into a calibrated band.

Both models are linear in word counts, so a word's share of the logits is
computed once and kept; scoring a sentence adds up a few cached vectors.
Graded passages are few; at most ``SAMPLE`` of them, chosen by hash, are used
for fitting, and the fitted weights have a fixed size.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boundaries import SIZE, Evidence, segment
from .common import CHAPTER, SENTENCE
from .confusables import repair

#: Most graded passages that are used for fitting: some 16,000 sentences, or 260 MB of features on the driver.
SAMPLE = 2_000
BANDS = 5
DIM = 1 << 11  # hashed words, and as many hashed character n-grams
SHAPE = 6
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Frequent function words of English, by which it is told from other languages in Latin letters.
FUNCTION = frozenset(
    "a about after all along although amid an and any are around as at be because before behind beside but by despite during for from had has have he her his i if in into is it its near not "
    "of on or out over past she since so that the their them then there they this those though through to towards under unless until was we were when where which while who whom whose with without you your".split()
)


def clean(text: str) -> str:
    """The consistent form of a text that can be English, any other as it is."""
    if text.isascii() or 2 * len(text.encode("ascii", "ignore")) < len(text):
        return text
    return repair(text)[0]


@lru_cache(maxsize=1 << 17)
def places(word: str) -> tuple[int, tuple[int, ...]]:
    """Hashed word and hashed character n-grams of a lower-case word."""
    padded = f"<{word}>"
    grams = [zlib.crc32(padded[k : k + n].encode()) % DIM + DIM for n in (2, 3, 4) for k in range(len(padded) - n + 1)]
    return zlib.crc32(word.encode()) % DIM, tuple(grams)


def shape(words: list[str], text: str) -> np.ndarray:
    n = len(words)
    letters = sum(map(len, words))
    marks = sum(text.count(c) for c in ",;:")
    return np.array([1.0, min(n, 80) / 20, letters / n / 5, min(marks, 10) / 4, sum(len(w) > 9 for w in words) / n * 2, np.log1p(n) / 3], np.float32)


def features(text: str) -> np.ndarray:
    """The feature vector of a sentence: mean word counts, mean n-gram counts and its shape."""
    words = WORD.findall(text.lower())
    at, weights = [], []
    for w in words:
        own, grams = places(w)
        at += [own, *grams]
        weights += [1.0 / len(words)] + [1.0 / len(grams) / len(words)] * len(grams)
    x = np.bincount(at, weights, 2 * DIM + SHAPE).astype(np.float32)
    x[2 * DIM :] = shape(words, text)
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def regression(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 100, rate: float = 0.1) -> np.ndarray:
    """Weights of an L2-regularised softmax regression, by full-batch Adam."""
    w = np.zeros((x.shape[1], BANDS), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(BANDS, dtype=np.float32)[y]
    for t in range(1, steps + 1):
        g = x.T @ ((softmax(x @ w) - target) / len(y)) + penalty * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def summary(mean: np.ndarray) -> np.ndarray:
    """What the second model sees of a document: its mean distribution, its leading level brought out.

    Graded passages are of one level throughout; chapters also hold dialogue,
    citations and lists, whose own levels should not outweigh the text's.
    """
    p = mean.astype(np.float32) ** 2
    return np.concatenate([[1.0], 4 * p / max(p.sum(), 1e-9)]).astype(np.float32)


class Grader:
    """The fitted models: sentence weights and the calibration of documents."""

    def __init__(self, passages: list[tuple[str, int]], penalty: float = 1e-5, folds: int = 5):
        alone = Evidence(np.zeros((SIZE, 6), np.float32), {})
        units, owner = [], []
        for k, (text, _) in enumerate(passages):
            begin = 0
            for end in segment(text, alone):
                unit = clean(text[begin:end])
                begin = end
                if WORD.search(unit):
                    units.append(features(unit))
                    owner.append(k)
        self.bands = sorted({b for _, b in passages}) or [1]
        grade = np.array([min(BANDS - 1, max(0, b - 1)) for _, b in passages], int)
        self.sentence = np.zeros((2 * DIM + SHAPE, BANDS), np.float32)
        self.document = np.zeros((BANDS + 1, BANDS), np.float32)
        self.held_out = None
        if not units:
            return
        x, owner = np.array(units), np.array(owner)
        y = grade[owner]
        # folds by hash: passages may come in an order that follows their bands
        fold = np.array([zlib.crc32(text.encode()) % folds for text, _ in passages])
        probabilities = np.zeros((len(x), BANDS), np.float32)
        for f in range(folds):
            out = fold[owner] == f
            if out.any() and not out.all():
                probabilities[out] = softmax(x[out] @ regression(x[~out], y[~out], penalty))
        docs = np.unique(owner)
        seen = np.array([summary(probabilities[owner == d].mean(0)) for d in docs])
        guess = np.zeros(len(docs), int)
        for f in range(folds):
            out = fold[docs] == f
            if out.any() and not out.all():
                guess[out] = (seen[out] @ regression(seen[~out], grade[docs[~out]], 1e-4, 400)).argmax(1)
        #: share of passages whose band is met, and met within one, by models that have not seen them
        self.held_out = float((guess == grade[docs]).mean()), float((abs(guess - grade[docs]) <= 1).mean())
        self.document = regression(seen, grade[docs], 1e-4, 400)
        self.sentence = regression(x, y, penalty)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_index", "_rows")}

    def row(self, w: str) -> np.ndarray:
        """What a word adds to a sentence: its share of the logits, whether it is a function word, its letters, whether it is long."""
        own, grams = places(w)
        logits = self.sentence[own] + (self.sentence[list(grams)].mean(0) if grams else 0)
        return np.array([*logits, w in FUNCTION, len(w), len(w) > 9], np.float32)

    def grade(self, texts: list[str]) -> np.ndarray:
        """(p1 … p5, n_words, letters, english_letters, n_sentences) of each sentence; only English ones have more than letters."""
        if not hasattr(self, "_index") or len(self._index) > 200_000:
            self._index, self._rows = {}, np.zeros((1 << 12, BANDS + 3), np.float32)
        index, found, marks = self._index, [], []
        for text in texts:
            text = clean(text)
            found.append(WORD.findall(text.lower()))
            marks.append(text.count(",") + text.count(";") + text.count(":"))
        flat = list(chain.from_iterable(found))
        for w in set(flat).difference(index):
            if len(index) == len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._rows[len(index)] = self.row(w)
            index[w] = len(index)
        out = np.zeros((len(texts), BANDS + 4))
        n = np.fromiter(map(len, found), np.int64, len(found))
        some = np.flatnonzero(n)
        if not len(some):
            return out
        n = n[some]
        ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        sums = np.add.reduceat(self._rows[ids], np.cumsum(n) - n, axis=0)
        letters = sums[:, BANDS + 1]
        outline = np.stack([np.ones(len(n)), np.minimum(n, 80) / 20, letters / n / 5, np.minimum(np.array(marks)[some], 10) / 4, sums[:, BANDS + 2] / n * 2, np.log1p(n) / 3], 1).astype(np.float32)
        p = softmax(sums[:, :BANDS] / n[:, None] + outline @ self.sentence[2 * DIM :])
        # English: letters of Latin, and function words among them
        known = (sums[:, BANDS] >= 0.12 * n).astype(float)
        out[some, BANDS + 1] = letters
        out[some] += np.concatenate([p * known[:, None], (n * known)[:, None], np.zeros((len(n), 1)), (letters * known)[:, None], known[:, None]], 1)
        return out

    def band(self, mean: np.ndarray) -> int:
        """Calibrated band of a document from its mean distribution."""
        return int((summary(mean) @ self.document).argmax()) + 1


def fit(graded: DataFrame, sample: int = SAMPLE) -> Grader:
    """Fits on at most ``sample`` graded passages, those with the smallest hashes."""
    rows = graded.where("length(text) > 0 and band is not null").select("text", "band").distinct().orderBy(F.xxhash64("text"), "band").limit(sample).collect()
    return Grader([(r.text, int(r.band)) for r in rows])


_KEPT: dict[str, Grader] = {}


def levels(sentences: DataFrame, graded: DataFrame, text: str = "text", keys: list[str] | None = None, units: list[str] | None = None) -> DataFrame:
    """(keys, share_english, n_words, n_sentences, p1 … p5, band) of each document.

    Documents are made of the distinct units; null and empty texts count
    nothing.  ``band`` is null where no sentence is English.  Without graded
    passages every band is equally likely and the lowest is given.
    """
    keys, units = keys or CHAPTER, units or SENTENCE
    own = sentences.select(*units, F.col(text).alias("_text")).where(F.length("_text") > 0)
    shared = sentences.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, fit(graded)))
    columns = [*(f"p{k + 1}" for k in range(BANDS)), "n_words", "letters", "english_letters", "n_sentences"]

    @F.pandas_udf(", ".join(f"{c} float" for c in columns))
    def grade(values: pd.Series) -> pd.DataFrame:
        name, fitted = shared.value
        grader = _KEPT.get(name)
        if grader is None:
            _KEPT.clear()
            grader = _KEPT.setdefault(name, fitted)
        return pd.DataFrame(grader.grade(values.tolist()).astype(np.float32), columns=columns)

    # repeated rows are told by key and hash: no text is shuffled
    each = own.select(*units, F.xxhash64("_text").alias("_h"), grade("_text").alias("_g")).groupBy(*units, "_h").agg(*[F.first(f"_g.{c}").alias(c) for c in columns])
    sums = each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])

    @F.pandas_udf("int")
    def band(*p: pd.Series) -> pd.Series:
        name, fitted = shared.value
        return pd.Series([fitted.band(np.array(row, np.float32)) for row in zip(*p)], dtype="int32")

    means = sums.select(*keys, F.coalesce(F.col("english_letters") / F.nullif("letters", F.lit(0.0)), F.lit(0.0)).alias("share_english"), F.col("n_words").cast("bigint").alias("n_words"), F.col("n_sentences").cast("bigint").alias("n_sentences"), *[F.when(F.col("n_sentences") > 0, F.col(f"p{k + 1}") / F.col("n_sentences")).otherwise(0.0).alias(f"p{k + 1}") for k in range(BANDS)])
    return means.withColumn("band", F.when(F.col("n_words") > 0, band(*[f"p{k + 1}" for k in range(BANDS)])))
