"""Splitting text into paragraphs and sentences, and the checks before scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Least length of a sentence, and number of words it must exceed.
LEAST_LENGTH, LEAST_WORDS = 5, 3


def paragraphs(df: DataFrame, text: str = "text", index: str = "para_idx") -> DataFrame:
    """One row for each line of ``text``, numbered from 0; null texts have none."""
    rest = [c for c in df.columns if c not in (text, index)]
    return df.select(*rest, F.posexplode(F.split(text, "\n")).alias(index, text))


def sentences(df: DataFrame, text: str = "text", index: str = "sent_idx", out: str = "sentence") -> DataFrame:
    """One row for each stretch up to an end mark, without outer spaces, numbered from 0."""
    rest = [c for c in df.columns if c not in (text, index, out)]
    rows = df.select(*rest, F.posexplode(T.pieces(text, T.SENTENCE)).alias(index, out))
    return rows.withColumn(out, F.trim(out))


def skip_reason(sentence: Column | str) -> Column:
    """Why a sentence is not scored; null if it is.

    The check for bare end marks comes after the one for words, which already
    rules such texts out; it stays for the record.
    """
    s = T.col(sentence)
    return (
        F.when(s.isNull() | (F.length(s) < LEAST_LENGTH), "short")
        .when(~T.ends_sentence(s), "no_end_mark")
        .when(T.alphabetic_tokens(s) <= LEAST_WORDS, "few_words")
        .when(T.only_end_marks(s), "only_marks")
    )


def scorable(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    return df.where(skip_reason(sentence).isNull())
