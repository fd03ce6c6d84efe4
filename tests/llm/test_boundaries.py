"""Problem 5: each ⏎ marks an expected end."""

from __future__ import annotations

import pytest

from lectern.llm import boundaries as B

CORPUS = [
    "Mr. Lane saw Dr. Fox and St. Ann. He left at 5 a.m. and slept. They met in Sept. of that year. The note in vol. 3, p. 8, repeats Fig. 2 of it.",
    "Mr. Pell and Dr. Holm met Mr. Lane. He kept things, etc. and more. It was Lane. She saw Pell. We met Holm, Lane and Pell. The man then left. He and the man ran.",
    "Mr. Holm left. Dr. Pell came. St. Mary is here. The Co. of it. In Sept. they came. At 6 p.m. they left. The clerk wrote “No. 5” and then left. He ran. The dog ran.",
]
CASES = [
    "He ran.⏎ She saw it!⏎ Why?⏎",
    "Mr. Lane left.⏎ Dr. Fox came.⏎",
    "It cost 3.5 crowns, in ch12.html of it.⏎ Good.⏎",
    "T. A. Holm left.⏎",
    "The coach stopped at 5 a.m.⏎ Then he left.⏎",
    "He left at 5 a.m. and slept.⏎",
    "They met in Sept. of that year.⏎",
    "“Stop! We ran!” called Lane.⏎ He left.⏎",
    "“They ran.”⏎ “When?”⏎ “In autumn.”⏎",
    "'You ran,' Lane said, 'but I stay.'⏎ He left.⏎",
    "\"I am sorry, I cannot,\" said Pell.⏎ He left.⏎",
    "He ran. (The dog saw it.) She left.".replace("ran. ", "ran.⏎ ").replace(") ", ")⏎ ") + "⏎",
    "He met Pell.[25]⏎ She left.*⏎ It ran.⏎",
    "He ran.She ran.".replace("n.S", "n.⏎S") + "⏎",
    "He waited... and ran.⏎ Nobody came...⏎ She left.⏎",
    "He read the list: 1. a hat; 2. a cat; 3. a dog.⏎ He left.⏎",
    "What?!⏎ No!!⏎ He left",
    "船长走了。⏎“他来了吗？”她问道。⏎“他来了。”⏎“好！”⏎走了2.5公里……⏎他笑了！？⏎",
    "「行った。」と姉が言った。⏎「誰？」⏎「私！」⏎終わった。⏎",
    "वह गया।⏎ डॉ. वह आया।⏎ “वह गया!” उसने कहा।⏎",
    "عاد المعلم.⏎ «ضحك الصياد!» قال أخوه.⏎ هل نام؟⏎ معه 9.5 درهم.⏎",
    "คนแปลกหน้าขายแผนที่ในที่สุด⏎ จิตรกรเห็นกล่องไม้ 3 ครั้ง⏎ ครูพูดว่า “เด็กเห็นผ้าสีฟ้า”⏎ ครูยืมเรือ⏎",
    "Am 3. Mai kehrte Dr. Fox zurück.⏎ „Er ging im Regen!“ rief Fr. Lane.⏎ Er ging, z. B. für 5.500 Taler.⏎",
    "« Il est parti ! » dit Mme Lane.⏎ Il part ?⏎ Cf. p. 5 : il part.⏎",
    "—¡Ella perdió el mapa! —gritó la Sra. Lane.⏎ ¿Ella vino?⏎",
    "В 1806 г. он ушёл и т. д., а потом пришёл.⏎ «Он ушёл!» — сказал г. Lane.⏎",
]


@pytest.fixture(scope="module")
def known():
    import numpy as np

    table = np.zeros((B.SIZE, 6))
    for text in CORPUS + [c.replace("⏎", "") for c in CASES]:
        uses = B.Uses()
        uses.add(text)
        for token, n in uses.counts().items():
            table[B.bucket(token)] += n[:6]
    return B.Evidence(table, {})


@pytest.mark.parametrize("marked", CASES)
def test_segment(known, marked):
    text, ends = "", []
    for c in marked:
        if c == "⏎":
            ends.append(len(text))
        else:
            text += c
    if not ends or ends[-1] < len(text.rstrip()):
        ends.append(len(text.rstrip()))
    got = B.segment(text, known)
    cut = [text[a:b] for a, b in zip([0, *got], got)]
    assert got == ends, cut


def test_blank_and_outer_space(known):
    assert B.segment(" \n ", known) == []
    assert B.segment("  He ran.  ", known) == [9]
    assert B.segment("no end mark", known) == [11]
    assert B.segment("“never closed. He ran. " * 3, known)[-1] == len(("“never closed. He ran. " * 3).rstrip())


def test_sentences(spark):
    rows = [("b", 0, k, t, "x") for k, t in enumerate(CORPUS)] + [("b", 0, 0, CORPUS[0], "y"), ("b", None, 7, "He ran. Mr. Lane left.", None), ("b", 0, 8, None, None), ("b", 0, 9, " \n", None), ("b", 0, 10, "He ran. " * 5000, None)]
    df = spark.createDataFrame(rows, "book_id string, spine_idx int, para_idx int, full_text string, seen string")
    out = {}
    for r in B.sentences(df).collect():
        out.setdefault(r.para_idx, []).append(r.end_pos)
    assert len(out[0]) == 4, out[0]
    assert sorted(out[7]) == [7, 22]
    assert 8 not in out and 9 not in out and len(out[10]) == 5000
    assert B.sentences(df.limit(0)).count() == 0


def test_small_uses_in_the_chapter(spark):
    # elsewhere "Hope" is a name; a chapter that uses the word small decides for itself
    rows = [("b0", k, 0, "They met Bell Corp. Hope, and later Hope. The old Bell Corp. Hope and the new Bell Corp. Hope were there with Hope.") for k in range(12)]
    rows += [("b0", k, 1, "At Bell Corp. they wait.") for k in range(12)]
    text = "It was Bell Corp. Hope was gone."
    rows += [("b1", 0, 0, text), ("b1", 0, 1, "There was no hope left."), ("b2", 0, 0, text)]
    df = spark.createDataFrame(rows, "book_id string, spine_idx int, para_idx int, full_text string")
    ends = {(r.book_id, r.end_pos) for r in B.sentences(df).where("book_id != 'b0' and para_idx = 0").collect()}
    assert ends == {("b1", 17), ("b1", len(text)), ("b2", len(text))}


def test_evidence_of_long_chapters(spark):
    """A chapter in several parts decides like one in a single part."""
    text = "It was Bell Corp. Hope was gone."
    rows = [("b0", k, 0, "They met Bell Corp. Hope, and later Hope. The old Bell Corp. Hope and the new Bell Corp. Hope were there with Hope.") for k in range(12)]
    rows += [("b0", k, 1, "At Bell Corp. they wait.") for k in range(12)]
    rows += [("b1", 0, 0, text), ("b1", 0, 5 * B.COPY, "There was no hope left."), ("b1", 0, None, text + " "), ("b2", 0, 0, text), (None, None, None, text)]
    df = spark.createDataFrame(rows, "book_id string, spine_idx int, para_idx int, full_text string")
    ends = {(r.book_id, r.para_idx, r.end_pos) for r in B.sentences(df).where("book_id != 'b0' or book_id is null").collect()}
    n = len(text)
    assert ends == {("b1", 0, 17), ("b1", 0, n), ("b1", 5 * B.COPY, 23), ("b1", None, 17), ("b1", None, n), ("b2", 0, n), (None, None, n)}


def test_uses_against_one_by_one():
    text = "Mr. Lane saw Dr. Fox, i.e. him, at 5 p.m. Then Ms. Hale left. “The Co. of it.” Lane ran to Bell; The man."
    uses = B.Uses()
    uses.add(text)
    n = uses.counts()
    assert n["Mr"][B.CAPITAL] == 1 and n["Lane"][B.BARE] == 2 and n["Lane"][B.NAME] == 0 and n["Fox"][B.NAME] == 0 and n["Bell"][B.NAME] == 1 and n["saw"][B.LOWER] == 1
    assert n["Co"][B.SMALL] == 1 and n["Co"][B.BARE] == 0 and n["man"][B.FINAL] == 1 and n["left"][B.BARE] == 0
    telling = uses.counts(telling=True)
    assert "saw" not in telling and all(telling[w] == n[w] for w in telling if w in n)
