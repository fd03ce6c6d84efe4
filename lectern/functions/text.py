"""Column builders for strings, words and reading features.

Patterns that a second engine must read the same way avoid look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters after which a sentence counts as complete.
END_MARKS = [".", "!", "?", "。", "！", "？", "’", '"', "*"]
# Words that open subordinate and relative clauses.
CLAUSE_WORDS = ["that", "which", "who", "whom", "whose", "because", "although", "though", "while", "if", "unless", "until", "since", "when", "where", "whether", "as"]

SENTENCE = r"[^.!?。！？\n]+[.!?。！？’\"*]*"
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
WORD = r"[\p{L}\p{M}]+"
LETTERS = r"\p{L}+"
VOWELS = r"[aeiouyàâäéèêëîïôöùûüœæ]+"
BREAKS = r"[,;:(]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def pieces(c: Column | str, pattern: str) -> Column:
    """All matches of ``pattern``, in order."""
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def words(c: Column | str) -> Column:
    """Lower-case words of letters."""
    return pieces(F.lower(col(c)), LETTERS)


def alphabetic_tokens(c: Column | str) -> Column:
    """Number of tokens between white space that are letters throughout; words that touch punctuation don't count."""
    return F.size(F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w.rlike(r"^\p{L}+$")))


def has_text(c: Column | str) -> Column:
    """Whether there is a character other than a space and a line feed."""
    return F.coalesce(col(c).rlike("[^ \n]"), F.lit(False))


def ends_sentence(c: Column | str) -> Column:
    return F.right(col(c), F.lit(1)).isin(END_MARKS)


def only_end_marks(c: Column | str) -> Column:
    """Whether a text is nothing but end marks and white space."""
    return col(c).rlike(r"(?U)^[.!?。！？’\"*\s]*$")


def clause_words(c: Column | str) -> Column:
    return F.size(F.filter(pieces(F.lower(col(c)), WORD), lambda w: w.isin(CLAUSE_WORDS)))


def flesch(n_word: Column, n_syllable: Column, n_sentence: Column | float = 1.0) -> Column:
    """Flesch reading ease; null without words."""
    per = n_sentence if isinstance(n_sentence, Column) else F.lit(n_sentence)
    return F.lit(206.835) - F.lit(1.015) * n_word / per - F.lit(84.6) * n_syllable / F.nullif(n_word, F.lit(0))


def normalised(value: Column | str, low: float, high: float) -> Column:
    """Position between ``low`` and ``high``, not clamped; 0 if they are equal."""
    return F.lit(0.0) if low == high else (col(value) - F.lit(float(low))) / F.lit(float(high - low))


def stem(href: Column | str) -> Column:
    """File name without folders and last suffix."""
    name = F.element_at(F.split(col(href), "/"), -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def suffix(href: Column | str) -> Column:
    """Last suffix of the file name with its dot, or an empty text."""
    return F.regexp_extract(F.element_at(F.split(col(href), "/"), -1), r"^.+(\.[^.]*)$", 1)


def folder(href: Column | str) -> Column:
    """Folder of a path with its slash, or an empty text."""
    return F.regexp_extract(col(href), r"^(.*/)[^/]*$", 1)


def merged_label(origin: Column | str, target: Column | str) -> Column:
    """The origin if both are equal, else both joined; a null side gives the other."""
    o, t = col(origin), col(target)
    return F.when(o.eqNullSafe(t), o).otherwise(F.concat_ws(" - ", o, t))


def first_of(*choices: Column | str) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in choices])
