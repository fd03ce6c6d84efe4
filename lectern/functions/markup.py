"""Column builders for markup kept as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Elements that have no content.
VOID_TAGS = ["br", "hr", "input", "col", "base", "meta", "area"]

HEAD = r"(?is)^(?:<\?xml.*?\?>\s*)?(?:<!DOCTYPE.*?>\s*)?"
VOID = rf"<({'|'.join(VOID_TAGS)})(\s[^>]*?)\s*/?>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def document_head(c: Column | str) -> Column:
    """The XML declaration and document type at the start, or an empty text."""
    return F.regexp_extract(col(c), f"({HEAD})", 1)


def without_head(c: Column | str) -> Column:
    return F.regexp_replace(col(c), HEAD, "")


def void_tags_to_xml(c: Column | str) -> Column:
    """Void tags with attributes, closed."""
    return F.regexp_replace(col(c), VOID, "<$1$2 />")


def void_tags_to_html(c: Column | str) -> Column:
    """Void tags with attributes, without the closing slash."""
    return F.regexp_replace(col(c), VOID, "<$1$2>")


def escaped(c: Column | str, quotes: bool = True) -> Column:
    """Markup characters as entities."""
    out = col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("'", "&#x27;")) if quotes else ()):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def page_title(c: Column | str) -> Column:
    """Text of the first title element; null if there is none."""
    return F.nullif(F.regexp_extract(col(c), TITLE, 1), F.lit(""))


def decoded_escapes(c: Column | str) -> Column:
    """Four-digit backslash escapes as their characters; the JVM has no such function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.str.replace(r"\\u([\da-fA-F]{4})", lambda m: chr(int(m[1], 16)), regex=True)

    return run(col(c))
