"""Difficulty of sentences: features, word frequencies and the weighted score.

Without trained language models the features are approximations by rule: the
depth stands for the depth of a dependency tree, the clause count for its
subordinate clauses.  ``given`` features from elsewhere go through the same
score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The score's threshold, the frequency under which a word is rare, weights and ranges of the five features.
HARD, RARE = 45.0, 4.0
#: A word of zipf 4 or more is at least one in 100,000 of all words.
COMMON = 100_000
WEIGHTS = {"n_tok": 0.2, "depth": 0.3, "sub_clauses": 0.4, "hard_ratio": 0.1, "flesch": -0.1}
RANGES = {"n_tok": (5, 80), "depth": (1, 16), "sub_clauses": (0, 5), "hard_ratio": (0, 1), "flesch": (0, 100)}


def features(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Adds n_tok, n_word, sub_clauses, depth and flesch of each sentence, by rule."""
    s = F.col(sentence)
    counts = F.struct(T.count(s, T.TOKEN).alias("n_tok"), T.count(s, T.WORD).alias("n_word"), T.count(F.lower(s), T.VOWELS).alias("_syl"), T.clause_words(s).alias("sub_clauses"), T.count(s, T.BREAKS).alias("_breaks"))
    # exploding one struct keeps the patterns from being inlined, and run again, wherever a count is used
    out = df.select(*[c for c in df.columns if c not in ("n_tok", "n_word", "sub_clauses")], F.inline(F.array(counts)))
    steps = F.floor(F.ln(F.col("n_tok").cast("double")) / F.ln(F.lit(2.0)))
    depth = F.least(F.lit(16), F.lit(1) + F.col("_breaks") + F.col("sub_clauses") + steps.cast("int"))
    return out.withColumns({"depth": depth, "flesch": T.flesch(F.col("n_word"), F.col("_syl"))}).drop("_syl", "_breaks")


def score(n_tok="n_tok", depth="depth", sub_clauses="sub_clauses", hard_ratio: Column | str = "hard_ratio", flesch="flesch") -> Column:
    """The weighted sum of the normalised features, times 100; null if one is null."""
    given = {"n_tok": n_tok, "depth": depth, "sub_clauses": sub_clauses, "hard_ratio": hard_ratio, "flesch": flesch}
    total = None
    for name, weight in WEIGHTS.items():
        part = F.lit(abs(weight)) * T.normalised(given[name], *RANGES[name])
        total = part if total is None else total + part if weight > 0 else total - part
    return F.lit(100.0) * total


def is_hard(value: Column | str = "score") -> Column:
    return T.col(value) > F.lit(HARD)


def lexicon(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt, zipf) of all words of ``text``: log10 of occurrences in a thousand million words."""
    counts = df.select(F.explode(T.words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total")).scalar()
    return counts.select("word", "cnt", F.log10(F.col("cnt") * F.lit(1e9) / total).alias("zipf"))


def rare_word_ratio(df: DataFrame, words: DataFrame, keys: list[str], sentence: str = "sentence", out: str = "hard_ratio", keep: list[str] | None = None) -> DataFrame:
    """(keys, keep, out): share of rare words; words not listed are rare, no words give 0.

    ``words`` holds (word, zipf).  Only its common words are joined, all others
    are rare by default: in a lexicon that ``lexicon`` made they are at most
    ``COMMON``, whatever the corpus, and so they are in any list of that bound,
    which is checked.  They are sent to all tasks, so no word is shuffled, and
    each row's words are counted where they are.  A longer list of common
    words is joined as Spark sees fit.  Repeated rows count once; ``keep``
    names columns that depend on the keys.
    """
    keep = keep or []
    words = words.where(F.col("zipf") >= RARE)
    if words.limit(COMMON + 1).count() <= COMMON:
        words = F.broadcast(words)
    each = df.select(*keys, *keep, F.explode_outer(T.words(sentence)).alias("_w"))
    known = words.select(F.col("word").alias("_w"), F.col("zipf").alias("_z"))
    rare = F.count_if(F.col("_w").isNotNull() & (F.coalesce(F.col("_z"), F.lit(0.0)) < RARE))
    share = F.coalesce(rare / F.nullif(F.count("_w"), F.lit(0)), F.lit(0.0)).alias(out)
    return each.join(known, "_w", "left").groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in keep], share)


def scored(df: DataFrame, words: DataFrame, keys: list[str], sentence: str = "sentence", hard_only: bool = False) -> DataFrame:
    """``keys``, the sentence, its features and its score.

    With ``hard_only`` the rare words of a sentence are looked up only if the
    other features leave the threshold within reach: the ratio adds at most
    its weight.
    """
    df = features(df.select(*keys, sentence), sentence)
    if hard_only:
        df = df.where(score(hard_ratio=F.lit(1.0)) > F.lit(HARD - 1e-9))
    kept = [sentence, "n_tok", "n_word", "sub_clauses", "depth", "flesch"]
    out = rare_word_ratio(df, words, keys, sentence, keep=kept).withColumn("score", score())
    return out.where(is_hard()) if hard_only else out


def tree_depth(heads: Column | str) -> Column:
    """Deepest token of a sentence's dependency trees; a root, whose head is itself or none, has depth 1."""

    @F.pandas_udf("int")
    def deepest(column):
        import pandas as pd

        def one(parents) -> int | None:
            if parents is None:
                return None
            depth = [0] * len(parents)
            for k in range(len(parents)):
                chain, j = [], k
                while depth[j] == 0 and j not in chain:
                    chain.append(j)
                    p = parents[j]
                    if p is None or p == j or not 0 <= p < len(parents):
                        depth[j] = 1
                        chain.pop()
                        break
                    j = int(p)
                for i in reversed(chain):
                    p = int(parents[i])
                    depth[i] = depth[p] + 1
            return max(depth, default=0)

        return pd.Series([one(p) for p in column], dtype="Int32")

    return deepest(T.col(heads))
