"""Notes: their sections, groups, markup, links, sources and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T

# Section marks of a note, its provider's failure text, and the name of a model without description.
ANALYSIS, TRANSLATION, WORDS = "分析：", "整体翻译：", "单词解释："
FAILED = "Ollama请求失败: "
UNKNOWN_MODEL, UNKNOWN_BOOK = "未知模型", "未知书籍"
COMPANION_TITLE = " 译文参考"
COMPANION = "_ext"


def _between(note: Column, begin: Column, end: Column) -> Column:
    """Characters from position ``begin`` up to before ``end``, both from 1."""
    return T.strip(F.substring(note, begin, F.greatest(end - begin, F.lit(0))))


def sections(df: DataFrame, note: str = "note_content") -> DataFrame:
    """Adds analysis, translation and word_explanation; null where a section is absent or empty.

    First marks count.  Without the first mark there are no sections.  A
    section runs to the next one's mark wherever that stands, so marks out of
    order leave empty sections, and a missing translation leaves the words in
    the analysis as well.
    """
    n = F.col(note)
    a, t, w = (F.locate(m, n) for m in (ANALYSIS, TRANSLATION, WORDS))
    end = F.length(n) + 1
    parts = {
        "analysis": F.when(a > 0, _between(n, a + len(ANALYSIS), F.when(t > 0, t).otherwise(end))),
        "translation": F.when((a > 0) & (t > 0), _between(n, t + len(TRANSLATION), F.when(w > 0, w).otherwise(end))),
        "word_explanation": F.when((a > 0) & (w > 0), _between(n, w + len(WORDS), end)),
    }
    return df.withColumns({k: F.nullif(v, F.lit("")) for k, v in parts.items()})


def failed(note: Column | str = "note_content") -> Column:
    """Whether a note is a provider's failure text."""
    return F.coalesce(F.startswith(T.col(note), F.lit(FAILED)), F.lit(False))


def explanation_html(note: str = "note_content") -> Column:
    """Markup of a note's sections, or of the bare note if it has none; needs the columns of ``sections``."""

    def span(kind: str, text: str) -> Column:
        return F.concat(F.lit(f'<span class="{kind}">'), M.escaped(text, quotes=False), F.lit("</span>"))

    parts = F.concat(
        F.coalesce(F.concat(span("analysis-section", "analysis"), F.lit("<br/>")), F.lit("")),
        F.coalesce(F.concat(span("translation-section", "translation"), F.lit("<br/>")), F.lit("")),
        F.coalesce(span("word-explanation-section", "word_explanation"), F.lit("")),
    )
    bare = M.escaped(F.coalesce(F.col(note), F.lit("")), quotes=False)
    return F.when(F.coalesce(F.locate(ANALYSIS, F.col(note)), F.lit(0)) > 0, parts).otherwise(bare)


def pair_html(text: str = "text", note: str = "note_content") -> Column:
    """Markup of one sentence with its explanation."""
    return F.concat(F.lit('<p><span class="original-text">'), M.escaped(F.coalesce(F.col(text), F.lit("")), quotes=False), F.lit('</span><span class="explanation">'), explanation_html(note), F.lit("</span></p>"))


def grouped(df: DataFrame, chapter: list[str], order: str = "sent_idx") -> DataFrame:
    """(chapter, note_id, html): the markup of each note's pairs in order, under its heading."""
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "pair"))), lambda p: p["pair"]), "")
    heading = F.format_string('<h3 id="llmnote-%d">#%d:</h3>', "note_id", "note_id")
    return df.withColumn("pair", pair_html()).groupBy(*chapter, "note_id").agg(html.alias("_html")).select(*chapter, "note_id", F.concat(heading, "_html").alias("html"))


def anchor_href(chapter_name: Column | str, note_id: Column | str, suffix: Column | str | None = None) -> Column:
    """Link from a paragraph to its note; with ``suffix`` the companion's own, else always the usual one."""
    end = F.lit(".html") if suffix is None else T.col(suffix)
    return F.concat(T.col(chapter_name), F.lit(COMPANION), end, F.lit("#llmnote-"), T.col(note_id).cast("string"))


def companion(df: DataFrame, href: str = "href") -> DataFrame:
    """Adds chapter_name, companion_href, companion_title and companion_id of each chapter."""
    return df.withColumns(
        {
            "chapter_name": T.stem(href),
            "companion_href": F.concat(T.folder(href), T.stem(href), F.lit(COMPANION), T.suffix(href)),
            "companion_title": F.concat(T.stem(href), F.lit(COMPANION_TITLE)),
            "companion_id": F.concat(F.lit("item_"), F.translate(F.concat(T.folder(href), T.stem(href), F.lit(COMPANION), T.suffix(href)), ".", "_")),
        }
    )


def broken_links(links: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Links without their target."""
    return links.join(targets, keys, "left_anti")


def described(df: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """``df`` with tag and description of its model, by name; unknown or undescribed models get the default."""
    names = models.select(F.col("name").alias(model), "tag", "description").dropDuplicates([model])
    return df.drop("tag", "description").join(names, model, "left").withColumn("description", F.coalesce("description", F.lit(UNKNOWN_MODEL)))


def totals(df: DataFrame) -> DataFrame:
    """One row: chapters and paragraphs with notes, notes, failed notes."""
    return df.agg(
        F.countDistinct("book_id", "spine_idx").alias("n_chapters"),
        F.countDistinct("book_id", "spine_idx", "note_id").alias("n_paragraphs"),
        F.count("*").alias("n_notes"),
        F.count_if(F.coalesce("note_error", F.lit(False))).alias("n_failed"),
    )
