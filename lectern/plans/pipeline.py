"""Whole pipelines: text tables and books, from sentences to numbered notes and companion pages."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import notes, numbering, scoring, sentences
from ..sources import dom, epub
from . import provider as P
from . import runlog
from .durable import durable


def hard_sentences(chapters: DataFrame, key: list[str], text: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """(key, note_id, para_idx, sent_idx, score, sentence) of the sentences worth a note.

    Lines of a chapter's text are its paragraphs.  Without a lexicon, word
    frequencies are those of the chapters themselves.
    """
    lines = sentences.paragraphs(chapters.select(*key, F.col(text).alias("text")))
    return annotated(lines, key, scoring.lexicon(chapters, text) if lexicon is None else lexicon)


def annotated(paragraphs: DataFrame, key: list[str], lexicon: DataFrame, text: str = "text") -> DataFrame:
    """As ``hard_sentences``, from paragraphs (key, para_idx, text)."""
    split = sentences.sentences(paragraphs.select(*key, "para_idx", text), text)
    kept = sentences.scorable(split)
    # few rows, read by their numbering and by what is numbered
    hard = durable(scoring.scored(kept, lexicon, [*key, "para_idx", "sent_idx"], hard_only=True))
    return numbering.note_ids(hard, key).select(*key, "note_id", "para_idx", "sent_idx", "score", "sentence")


@dataclass
class Annotation:
    """What a run makes: the changed entries, the notes and its totals."""

    entries: DataFrame
    notes: DataFrame
    totals: DataFrame


def annotate_books(files: DataFrame, lexicon: DataFrame | None = None, pattern: str | None = None, name: str | None = None, provider: P.Provider | None = None, prompt: P.Prompt | None = None, legacy_anchor: bool = False) -> Annotation:
    """Books with notes: links behind their paragraphs and companion pages behind their chapters.

    ``pattern`` chooses chapters by name; others, and those without a name,
    stay byte for byte.  ``name`` is the book's name in the prompts; without
    it each book's title is, and the name of unknown books where it has none.
    ``provider`` gets the sentences and their prompts.  With
    ``legacy_anchor`` links always end in the usual suffix, even where the
    companion page has another.
    """
    # read by the links, the companion pages and the notes alike
    catalogued = durable(epub.catalogue(files))
    chapters = durable(epub.chapters(files, catalogued, pattern).where(F.length("chapter_name") > 0))
    key = ["book_id", "spine_idx"]
    paragraphs = dom.page_paragraphs(chapters.select(*key, "html"))
    words = scoring.lexicon(paragraphs) if lexicon is None else lexicon
    books = catalogued.select("book_id", P.book_name(name, "package.title").alias("book_name"))
    asked = annotated(paragraphs, key, words).join(books, "book_id")
    explained = durable(P.explained(asked, provider=provider, system=(prompt or P.Prompt()).system("book_name")).withColumnRenamed("sentence", "text"))
    named = notes.companion(chapters, "href").select(*key, "item_id", "chapter_name", "companion_title", "companion_id", "entry_path", "html", F.regexp_extract("href", r"(\.[^./]*)$", 1).alias("_suffix"))

    links = explained.select(*key, "note_id", "para_idx").distinct().join(named.select(*key, "chapter_name", "_suffix"), key)
    links = links.withColumn("href", notes.anchor_href("chapter_name", "note_id", None if legacy_anchor else "_suffix"))
    anchors = links.groupBy(*key).agg(F.collect_list(F.struct("para_idx", "href")).alias("anchors"))
    marked = named.join(anchors, key, "left").select("book_id", "entry_path", F.encode(dom.anchored("html", "anchors"), "UTF-8").alias("content"))

    groups = notes.grouped(notes.sections(explained), key)
    inner = groups.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_id", "html"))), lambda n: n["html"]), "").alias("inner"))
    path = F.concat(F.regexp_extract("entry_path", r"^(.*/)?[^/]*$", 1), "chapter_name", F.lit(notes.COMPANION), "_suffix")
    pages = named.join(inner, key).withColumn("page", path)
    added = pages.select(
        "book_id",
        F.col("page").alias("entry_path"),
        F.encode(dom.companion_pages("html", "companion_title", "inner"), "UTF-8").alias("content"),
        # the id of the whole path: equal names in several folders stay apart
        F.col("companion_id").alias("item_id"),
        F.col("item_id").alias("after_id"),
        F.col("companion_title").alias("nav_label"),
        F.col("spine_idx").alias("place"),
    )
    return Annotation(epub.changed(files, marked, added), explained, notes.totals(explained))


def annotate_folder(spark: SparkSession, source: str, target: str, logs: str | None = None, **options) -> DataFrame:
    """Annotates all books below ``source`` and writes them to ``target``; (book_id, path, bytes) of each.

    ``target`` is a folder that all executors share.  With ``logs`` the run's
    totals are logged to a file there.
    """
    began = time.time()
    done = annotate_books(epub.entries(epub.read_books(spark, source)), **options)
    written = durable(epub.write_books(epub.packed(done.entries), target))
    if logs is not None:
        runlog.log_to(logs)
        runlog.log_totals(done.totals, time.time() - began)
    return written
