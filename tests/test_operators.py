"""Single operators on hand-made rows: expected values follow from their definitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import markup as M
from lectern.functions import text as T
from lectern.operators import notes, numbering, scoring, sentences
from lectern.plans import provider as P


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, expected", [((80, 16, 5, 1.0, 0.0), 100.0), ((5, 1, 0, 0.0, 100.0), -10.0), ((155, 31, 10, 2.0, -100.0), 210.0)])
def test_score(spark, given, expected):
    names = ("n_tok", "depth", "sub_clauses", "hard_ratio", "flesch")
    assert one(spark, scoring.score(), **dict(zip(names, given))) == pytest.approx(expected)


def test_score_is_monotone(spark):
    base = {"n_tok": 20, "depth": 4, "sub_clauses": 1, "hard_ratio": 0.2, "flesch": 60.0}
    before = one(spark, scoring.score(), **base)
    for name in base:
        after = one(spark, scoring.score(), **(base | {name: base[name] + 1}))
        assert (after < before) == (name == "flesch")


def test_threshold_is_strict(spark):
    assert [one(spark, scoring.is_hard("v"), v=v) for v in (45.0, 45.001)] == [False, True]


@pytest.mark.parametrize(
    "s, reason",
    [(None, "short"), ("Abc.", "short"), ("we go far off.", "few_words"), ("we go far off now.", None), ("we go far off now”", "no_end_mark")]
    + [(f"we go far off now{m}", None) for m in ".!?。！？’\"*"]
    + [("we go, far, off, now.", "few_words"), ("we go far off now.", None)],
)
def test_skip_reason(spark, s, reason):
    assert one(spark, sentences.skip_reason("s"), s=s) == reason


def test_split_keeps_order_and_nulls_give_nothing(spark):
    df = spark.createDataFrame([(1, "A b. C d!\nE"), (2, None), (3, "")], "k int, text string")
    out = sentences.sentences(sentences.paragraphs(df)).orderBy("k", "para_idx", "sent_idx").collect()
    assert [(r.k, r.para_idx, r.sent_idx, r.sentence) for r in out] == [(1, 0, 0, "A b."), (1, 0, 1, "C d!"), (1, 1, 0, "E")]


@pytest.mark.parametrize(
    "note, expected",
    [
        ("分析：甲整体翻译：乙单词解释：丙", ("甲", "乙", "丙")),
        ("前言分析： 甲 整体翻译：乙", ("甲", "乙", None)),
        ("分析：甲单词解释：丙", ("甲单词解释：丙", None, "丙")),
        ("整体翻译：乙分析：甲单词解释：丙", (None, "乙分析：甲", "丙")),
        ("分析：甲单词解释：丙整体翻译：乙", ("甲单词解释：丙", None, "丙整体翻译：乙")),
        ("没有标记", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_sections(spark, note, expected):
    df = spark.createDataFrame([(note,)], "note_content string")
    r = notes.sections(df).first()
    assert (r.analysis, r.translation, r.word_explanation) == expected


def test_bare_note_is_escaped(spark):
    df = spark.createDataFrame([("x < y", "a & b")], "text string, note_content string")
    html = notes.sections(df).select(notes.pair_html().alias("h")).first().h
    assert html == '<p><span class="original-text">x &lt; y</span><span class="explanation">a &amp; b</span></p>'


def test_note_ids_have_no_gaps(spark):
    df = spark.createDataFrame([(1, 7, 0), (1, 2, 0), (1, 2, 1), (2, 5, 0)], "c int, para_idx int, s int")
    out = {(r.c, r.para_idx): r.note_id for r in numbering.note_ids(df, ["c"]).collect()}
    assert out == {(1, 2): 1, (1, 7): 2, (2, 5): 1}


def test_reading_order(spark):
    spine = spark.createDataFrame([("b", 0, "x"), ("b", 1, "gone"), ("b", 2, "y"), ("b", 3, "x")], "book_id string, spine_idx int, idref string")
    manifest = spark.createDataFrame([("b", 0, "y", "y.html", "t"), ("b", 1, "x", "old.html", "t"), ("b", 2, "x", "x.html", "t"), ("b", 2, "x", "x.html", "t")], "book_id string, ord int, item_id string, href string, media_type string")
    out = [(r.spine_idx, r.href) for r in numbering.reading_order(spine, manifest).orderBy("spine_idx").collect()]
    assert out == [(2, "y.html"), (3, "x.html")]


def test_contains_meets_longer_ids_unless_exact(spark):
    items = spark.createDataFrame([("b", "ch1")], "book_id string, item_id string")
    nav = spark.createDataFrame([("b", 0, "ch10.html"), ("b", 1, "ch1.html")], "book_id string, nav_idx int, src string")
    assert numbering.first_containing(items, nav).first().nav_idx == 0
    assert numbering.first_containing(items, nav, exact=True).first().nav_idx == 1


@pytest.mark.parametrize("heads, depth", [([None, 0, 1], 3), ([0], 1), ([1, None, 1], 2), ([None, None], 1), ([], 0), (None, None), ([1, 0], 2)])
def test_tree_depth(spark, heads, depth):
    df = spark.createDataFrame([(heads,)], "h array<int>")
    got = df.select(scoring.tree_depth("h").alias("d")).first().d
    assert got == depth


def test_labels_and_names(spark):
    assert [one(spark, T.merged_label("a", "b"), a=a, b=b) for a, b in (("x", "x"), ("x", "y"), (None, "y"))] == ["x", "x - y", "y"]
    assert one(spark, P.book_name(None, "t"), t="") == "未知书籍"
    assert one(spark, P.book_name("Given", "t"), t="Title") == "Given"
    assert [one(spark, T.stem("h"), h=h) for h in ("a/b.c.html", ".x", "plain")] == ["b.c", ".x", "plain"]


def test_markup(spark):
    assert one(spark, M.void_tags_to_xml("h"), h='<br><br/><br class="x"><meta charset="u" />') == '<br><br/><br class="x" /><meta charset="u" />'
    assert one(spark, M.escaped("h"), h="<a href=\"x\">'&'</a>") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    assert one(spark, M.decoded_escapes("h"), h="a\\u00e9\\u4e2d") == "aé中"


def test_rare_words(spark):
    df = spark.createDataFrame([(1, "Low high unseen"), (2, "12 !"), (3, None)], "k int, s string")
    lexicon = spark.createDataFrame([("low", 3.0), ("high", 5.0), ("null", None)], "word string, zipf double")
    out = {r.k: r.hard_ratio for r in scoring.rare_word_ratio(df, lexicon, ["k"], "s").collect()}
    assert out == {1: pytest.approx(2 / 3), 2: 0.0, 3: 0.0}


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "k int, sentence string")
    asked = P.explained(df, provider=lambda s, systems: [f"Ollama请求失败: {x}" for x in s]).collect()
    assert {(r.k, r.note_error) for r in asked} == {(1, True), (2, True), (3, True)}
    assert all(not r.note_error for r in P.explained(df).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    from lectern.plans import pipeline

    assert pipeline.hard_sentences(docs, ["doc_id"]).count() == 0


def test_broken_links(spark):
    links = spark.createDataFrame([("a", 1), ("a", 2)], "c string, n int")
    assert [r.n for r in notes.broken_links(links, links.where(F.col("n") == 1), ["c", "n"]).collect()] == [2]
