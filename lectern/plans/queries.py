"""Queries over the shared tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..operators import notes, numbering, scoring, sentences
from ..sources import dom, epub
from . import pipeline
from . import provider as P
from .durable import durable, spread
from .sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
CHAPTER = ["book_id", "spine_idx"]
SENTENCE = [*CHAPTER, "para_idx", "sent_idx"]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def english(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chapters, whatever their language is said to be: what is no English fails the checks of its sentences."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def split(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pi, si, s) of the English documents."""
    lines = sentences.paragraphs(english(spark, folder), index="pi")
    return sentences.sentences(lines, index="si", out="s")


def distinct_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paragraphs").select(*CHAPTER, "para_idx", "full_text").distinct()


def distinct_notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notes").select(*SENTENCE, "note_id", "text", "note_content", "note_error", "model").distinct()


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, spine_idx, html): a page of each chapter's paragraphs, void tags left open."""
    ordered = distinct_paragraphs(spark, folder).groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(F.struct("para_idx", "full_text"))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("<p>"), M.escaped(F.coalesce(p["full_text"], F.lit("")), quotes=False), F.lit("</p>"))), "\n")
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), "book_id", F.lit(" "), F.col("spine_idx").cast("string"), F.lit('</title><meta charset="utf-8"></head><body><hr class="top">'))
    return ordered.select(*CHAPTER, F.concat(head, body, F.lit("</body></html>")).alias("html"))


# Sentences, features, scores


@query
def hard_sentences(spark, folder):
    docs = english(spark, folder)
    found = pipeline.hard_sentences(docs, ["doc_id"])
    return found.select("doc_id", "note_id", F.col("para_idx").alias("pi"), F.col("sent_idx").alias("si"), F.round("score", 6).alias("score"), F.col("sentence").alias("s"))


@query
def sentence_split(spark, folder):
    lines = sentences.paragraphs(spread(table(spark, folder, "documents").select("doc_id", "text")), index="pi")
    return sentences.sentences(lines, index="si", out="s")


@query
def sentence_prefilter(spark, folder):
    return sentences.scorable(split(spark, folder), "s")


@query
def prefilter_reasons(spark, folder):
    return split(spark, folder).groupBy(F.coalesce(sentences.skip_reason("s"), F.lit("scored")).alias("reason")).agg(F.count("*").alias("n"))


@query
def token_features(spark, folder):
    rows = scoring.features(sentences.scorable(split(spark, folder), "s"), "s")
    return rows.select("doc_id", "pi", "si", *[F.col(c).cast("bigint").alias(c) for c in ("n_tok", "n_word", "sub_clauses", "depth")], F.round("flesch", 6).alias("flesch"))


@query
def zipf_lexicon(spark, folder):
    return scoring.lexicon(english(spark, folder)).select("word", "cnt", F.round("zipf", 6).alias("zipf"))


@query
def rare_word_ratio(spark, folder):
    own = table(spark, folder, "sentences").select(*SENTENCE, "text").distinct().where("text is not null")
    words = table(spark, folder, "lexicon").groupBy(F.lower("word").alias("word")).agg(F.max("zipf").alias("zipf"))
    ratio = scoring.rare_word_ratio(own, words, SENTENCE, "text")
    return ratio.select(*SENTENCE, F.round("hard_ratio", 6).alias("hard_ratio"))


@query
def difficulty_score(spark, folder):
    rows = sentences.scorable(split(spark, folder), "s")
    scored = scoring.scored(rows, scoring.lexicon(english(spark, folder)), ["doc_id", "pi", "si"], "s")
    return scored.select("doc_id", "pi", "si", F.round("hard_ratio", 6).alias("hard_ratio"), F.round("score", 6).alias("score"))


@query
def score_given_features(spark, folder):
    own = table(spark, folder, "scored").select(*SENTENCE, "n_tok", "depth", "sub_clauses", "hard_ratio", "flesch").distinct()
    scored = own.withColumn("score", scoring.score())
    return scored.select(*SENTENCE, F.round("score", 6).alias("score"), scoring.is_hard().alias("is_hard"))


@query
def tree_depth(spark, folder):
    """Depth of trees in which token k hangs on token k div 2, of the sizes in the table."""
    own = table(spark, folder, "scored").select(*SENTENCE, "n_tok").distinct().where("n_tok > 0")
    heads = F.transform(F.sequence(F.lit(1), F.col("n_tok").cast("int")), lambda k: F.when(k > 1, F.floor(k / 2).cast("int") - 1).otherwise(F.lit(None).cast("int")))
    return own.select(*SENTENCE, scoring.tree_depth(heads).alias("depth"))


# Notes


@query
def note_ids(spark, folder):
    own = distinct_notes(spark, folder).select(*SENTENCE)
    return numbering.note_ids(own, CHAPTER).select(*SENTENCE, F.col("note_id").cast("bigint").alias("note_id"))


@query
def note_parse(spark, folder):
    return notes.sections(distinct_notes(spark, folder)).select(*SENTENCE, "analysis", "translation", "word_explanation")


@query
def note_errors(spark, folder):
    return distinct_notes(spark, folder).select(*SENTENCE, notes.failed().alias("failed"))


@query
def note_markup(spark, folder):
    return notes.sections(distinct_notes(spark, folder)).select(*SENTENCE, notes.pair_html().alias("html"))


@query
def note_groups(spark, folder):
    return notes.grouped(notes.sections(distinct_notes(spark, folder).where("note_id is not null")), CHAPTER)


@query
def run_totals(spark, folder):
    return notes.totals(distinct_notes(spark, folder))


@query
def model_lookup(spark, folder):
    own = table(spark, folder, "notes").select(*SENTENCE, "model").distinct()
    return notes.described(own, table(spark, folder, "models")).select(*SENTENCE, "model", "tag", "description")


@query
def available_models(spark, folder):
    return table(spark, folder, "models").select("name", "tag").distinct()


@query
def broken_links(spark, folder):
    """Entries of the spine that name no item, and notes whose sentence is not among the sentences."""
    links = table(spark, folder, "spine").select("book_id", "spine_idx", F.col("idref").alias("item_id")).distinct()
    unnamed = notes.broken_links(links, table(spark, folder, "manifest").select("book_id", "item_id"), ["book_id", "item_id"])
    lost = notes.broken_links(distinct_notes(spark, folder).select(*SENTENCE), table(spark, folder, "sentences").select(*SENTENCE), SENTENCE)
    return unnamed.select(*CHAPTER, F.col("item_id").alias("target")).unionByName(lost.select(*CHAPTER, F.concat_ws("-", "para_idx", "sent_idx").alias("target")))


@query
def stub_explanations(spark, folder):
    found = pipeline.hard_sentences(english(spark, folder), ["doc_id"])
    return P.explained(found).select("doc_id", "para_idx", "sent_idx", "note_content", "note_error")


@query
def chat_messages(spark, folder):
    own = distinct_notes(spark, folder)
    messages = P.Prompt().messages(P.book_name(None, "book_id"), F.coalesce("text", F.lit("")))
    return own.select(*SENTENCE, F.explode(messages).alias("m")).select(*SENTENCE, "m.role", "m.content")


@query
def book_name_default(spark, folder):
    own = table(spark, folder, "documents").select("doc_id", P.book_name(None, "book_id").alias("book_name"))
    return own


# Books: manifest, spine, navigation


@query
def spine_manifest_join(spark, folder):
    return numbering.reading_order(table(spark, folder, "spine"), table(spark, folder, "manifest"))


@query
def xhtml_chapters(spark, folder):
    order = spine_manifest_join(spark, folder).where(F.col("media_type") == epub.XHTML_TYPE)
    return order.select(*CHAPTER, "href", F.coalesce(F.try_url_decode("href"), "href").alias("path"))


@query
def chapter_filter(spark, folder):
    order = spine_manifest_join(spark, folder).withColumn("chapter_name", T.stem("href"))
    return order.where(F.col("chapter_name").rlike("ch[0-9]*[05]$")).select(*CHAPTER, "chapter_name")


@query
def media_types(spark, folder):
    return spine_manifest_join(spark, folder).groupBy("media_type").agg(F.count("*").alias("n"))


@query
def companion_titles(spark, folder):
    order = notes.companion(spine_manifest_join(spark, folder))
    return order.select(*CHAPTER, "chapter_name", "companion_href", "companion_title", "companion_id")


@query
def anchor_links(spark, folder):
    order = spine_manifest_join(spark, folder)
    ids = distinct_notes(spark, folder).where("note_id is not null").select(*CHAPTER, "note_id").distinct()
    both = ids.join(order, CHAPTER).withColumn("chapter_name", T.stem("href"))
    return both.select(*CHAPTER, "note_id", notes.anchor_href("chapter_name", "note_id").alias("legacy_href"), notes.anchor_href("chapter_name", "note_id", T.suffix("href")).alias("href"))


@query
def ncx_paths(spark, folder):
    own = table(spark, folder, "manifest").where("item_id = 'ncx'")
    return own.groupBy("book_id").agg(F.min_by("href", F.struct("ord", "href")).alias("href"))


def navigation(spark: SparkSession, folder: str) -> DataFrame:
    """A navigation point for each page of the reading order."""
    order = spine_manifest_join(spark, folder)
    # positions are unique in a book, so their order is the points' order
    return order.select("book_id", F.col("spine_idx").alias("nav_idx"), F.col("item_id").alias("nav_id"), T.stem("href").alias("label"), F.col("href").alias("src"))


@query
def contains_join(spark, folder):
    items = spine_manifest_join(spark, folder).select("book_id", T.stem("href").alias("item_id")).distinct()
    return numbering.first_containing(items, navigation(spark, folder))


@query
def exact_nav_join(spark, folder):
    items = spine_manifest_join(spark, folder).select("book_id", T.stem("href").alias("item_id")).distinct()
    return numbering.first_containing(items, navigation(spark, folder), exact=True)


@query
def renumber_after_insert(spark, folder):
    order = spine_manifest_join(spark, folder)
    noted = distinct_notes(spark, folder).where("note_id is not null").select(*CHAPTER).distinct()
    added = notes.companion(order).join(noted, CHAPTER).select(*CHAPTER, F.col("companion_id").alias("item_id"))
    out = numbering.inserted_after(order.select(*CHAPTER, "item_id"), added)
    return out.select("book_id", F.col("new_idx").cast("bigint").alias("new_idx"), "item_id", "is_added")


@query
def play_orders(spark, folder):
    points = navigation(spark, folder).groupBy("book_id").agg(F.count("*").alias("n_points"))
    noted = distinct_notes(spark, folder).where("note_id is not null").select(*CHAPTER).distinct()
    added = noted.join(spine_manifest_join(spark, folder).select(*CHAPTER), CHAPTER)
    ranked = added.withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_idx")))
    return ranked.join(points, "book_id").select(*CHAPTER, numbering.play_order("n_points", "k").cast("bigint").alias("play_order"))


@query
def manifest_spine_order(spark, folder):
    """Items of the manifest by reading order, the others behind."""
    items = numbering.last_items(table(spark, folder, "manifest"))
    order = numbering.last_positions(table(spark, folder, "spine")).withColumnRenamed("idref", "item_id")
    both = items.join(order, ["book_id", "item_id"], "left")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("spine_idx").asc_nulls_last(), "item_id"))
    return both.select("book_id", "item_id", place.cast("bigint").alias("place"))


@query
def last_spine_item(spark, folder):
    return spine_manifest_join(spark, folder).groupBy("book_id").agg(F.max_by("item_id", "spine_idx").alias("item_id"))


@query
def positional_zip(spark, folder):
    """Sentences and notes of each chapter by position, nulls skipped."""
    place = Window.partitionBy(*CHAPTER).orderBy("para_idx", "sent_idx")
    left = table(spark, folder, "sentences").select(*SENTENCE).distinct().withColumn("pos", F.row_number().over(place))
    right = distinct_notes(spark, folder).select(*SENTENCE, "note_content").withColumn("pos", F.row_number().over(place))
    both = numbering.zipped(left, right.select(*CHAPTER, "pos", "note_content"), CHAPTER, "pos")
    return both.where("note_content is not null").select(*SENTENCE, F.col("pos").cast("bigint").alias("pos"), "note_content")


@query
def label_merge(spark, folder):
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    both = table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return both.select("n_nationkey", T.merged_label("r_name", "n_name").alias("label"))


# Markup


@query
def void_tags_xml(spark, folder):
    return pages(spark, folder).select(*CHAPTER, F.md5(M.void_tags_to_xml("html").cast("binary")).alias("html"))


@query
def void_tags_html(spark, folder):
    return pages(spark, folder).select(*CHAPTER, F.md5(M.void_tags_to_html(M.void_tags_to_xml("html")).cast("binary")).alias("html"))


@query
def doc_head_strip(spark, folder):
    return pages(spark, folder).select(*CHAPTER, M.document_head("html").alias("head"), F.md5(M.without_head("html").cast("binary")).alias("body"))


@query
def page_title(spark, folder):
    return pages(spark, folder).select(*CHAPTER, M.page_title("html").alias("title"))


@query
def html_escape(spark, folder):
    return table(spark, folder, "documents").select("doc_id", M.escaped("text").alias("escaped"))


@query
def page_paragraphs(spark, folder):
    return dom.page_paragraphs(pages(spark, folder))


@query
def page_fragments(spark, folder):
    return dom.page_fragments(pages(spark, folder)).where("tag = 'p'").select(*CHAPTER, "frag_idx", "position", "text")


@query
def fragment_counts(spark, folder):
    return dom.page_fragments(pages(spark, folder)).groupBy(*CHAPTER).agg(F.count("*").alias("n"))


@query
def page_rewrite(spark, folder):
    """Pages with each fragment's text given back once more, and what their paragraphs then are."""
    texts = dom.page_fragments(pages(spark, folder)).where("position = 'WHOLE_DOM'").groupBy(*CHAPTER).agg(F.count("*").alias("n"))
    doubled = pages(spark, folder).join(texts, CHAPTER).withColumn("texts", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat(F.lit("t"), k.cast("string"))))
    return dom.page_paragraphs(doubled.select(*CHAPTER, dom.rewritten("html", "texts").alias("html")))


@query
def anchor_insert(spark, folder):
    """Links on each chapter's page, read from the page after they are inserted."""
    ids = distinct_notes(spark, folder).where("note_id is not null").select(*CHAPTER, "para_idx", "note_id").distinct()
    named = spine_manifest_join(spark, folder).withColumn("chapter_name", T.stem("href"))
    links = ids.join(named, CHAPTER).withColumn("href", notes.anchor_href("chapter_name", "note_id"))
    lists = links.groupBy(*CHAPTER).agg(F.collect_list(F.struct("para_idx", "href")).alias("anchors"))
    done = pages(spark, folder).join(lists, CHAPTER).select(*CHAPTER, dom.anchored("html", "anchors").alias("html"))
    hrefs = F.expr("regexp_extract_all(html, 'href=\"([^\"]*#llmnote-[0-9]+)\"', 1)")
    return done.select(*CHAPTER, F.explode(hrefs).alias("href"))


@query
def companion_page_notes(spark, folder):
    """Companion pages of all chapters with notes, and how many headings, pairs and titles they hold."""
    groups = note_groups(spark, folder)
    inner = groups.groupBy(*CHAPTER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_id", "html"))), lambda n: n["html"]), "").alias("inner"))
    made = pages(spark, folder).join(inner, CHAPTER).withColumn("html", dom.companion_pages("html", F.lit("ch" + notes.COMPANION_TITLE), "inner"))
    return made.select(*CHAPTER, F.regexp_count("html", F.lit("<h3 ")).alias("n_headings"), F.regexp_count("html", F.lit('class="original-text"')).alias("n_pairs"), F.regexp_count("html", F.lit("<h1>ch 译文参考</h1>")).alias("n_titles"))


def books(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all books, their pages made of the paragraphs."""
    order = spine_manifest_join(spark, folder).where(F.col("media_type") == epub.XHTML_TYPE)
    html = order.join(pages(spark, folder), CHAPTER).select("book_id", "href", "html").dropDuplicates(["book_id", "href"])
    titles = order.select("book_id").distinct().withColumn("title", F.concat(F.lit("Book & "), "book_id")).withColumn("creators", F.array(F.lit("First & Co."), F.col("book_id"), F.lit("Third")))
    return durable(epub.built(table(spark, folder, "manifest"), table(spark, folder, "spine"), html, titles))


@query
def epub_catalogue(spark, folder):
    """Title, points and entries of the spine of each book, packed and read again."""
    files = epub.entries(epub.packed(books(spark, folder)))
    found = epub.catalogue(files)
    return found.select("book_id", "package.title", F.col("package.ncx_path").alias("ncx_path"), F.size("spine").cast("bigint").alias("n_spine"), F.size("nav").cast("bigint").alias("n_nav"))


@query
def epub_roundtrip(spark, folder):
    """Paragraphs of all books after packing, unpacking and parsing."""
    files = durable(epub.entries(epub.packed(books(spark, folder))))
    chapters = epub.chapters(files, epub.catalogue(files))
    return dom.page_paragraphs(chapters.select(*CHAPTER, "html")).groupBy(*CHAPTER).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def epub_annotated(spark, folder):
    """All books annotated with notes: pages of their spine before and after, and links without a note."""
    lexicon = table(spark, folder, "lexicon").groupBy(F.lower("word").alias("word")).agg(F.max("zipf").alias("zipf"))
    done = pipeline.annotate_books(books(spark, folder), lexicon=lexicon)
    entries = durable(done.entries)
    catalogued = epub.catalogue(entries)
    html = F.decode("content", "UTF-8")
    files = entries.where(F.lower("entry_path").rlike(r"\.x?html?$"))
    each = files.select("book_id", F.regexp_count(html, F.lit(r'href="[^"]*#llmnote-')).alias("links"), F.regexp_count(html, F.lit(r'id="llmnote-')).alias("targets"))
    counts = each.groupBy("book_id").agg(F.sum("links").alias("n_links"), F.sum("targets").alias("n_targets"))
    return catalogued.select("book_id", F.size("spine").cast("bigint").alias("n_spine"), F.size("nav").cast("bigint").alias("n_nav")).join(counts, "book_id")


@query
def nav_relabelled(spark, folder):
    """Navigation labels of all books after a function on each book's list of labels."""
    files = books(spark, folder)
    none = spark.createDataFrame([], "book_id string, entry_path string, content binary")
    done = epub.changed(files, none, labels=lambda labels: [x if k % 2 else x.upper() for k, x in enumerate(labels)])
    return epub.relation(epub.catalogue(done), "nav").select("book_id", "nav_idx", "label")


@query
def metadata_rewritten(spark, folder):
    """Titles and authors of all books after both are set."""
    files = books(spark, folder)
    none = spark.createDataFrame([], "book_id string, entry_path string, content binary")
    done = epub.catalogue(epub.changed(files, none, title="A <new> title", authors=["A. Writer", "B. <Writer>"]))
    before = epub.catalogue(files).select("book_id", F.array_join("package.authors", "; ").alias("authors_before"))
    return done.select("book_id", "package.title", F.array_join("package.authors", "; ").alias("authors")).join(before, "book_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
