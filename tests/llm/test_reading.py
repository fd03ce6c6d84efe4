"""Problem 4."""

from __future__ import annotations

import random

from lectern.llm import reading

LEVELS = ["The {0} sat. The {1} was red.", "The {0} sat by the wall, but the {1} ran to the old house.", "When the {0} travelled beyond the valley, the {1} remembered its journey until October.", "Although the {0} discovered a melancholy beside the library, the {1}, which precipitated an obligation, promised the garden.", "That the {0} exacerbated the imperceptible deterioration, and that the {1} corroborated their jurisdiction, vindicated the capricious incivility."]
NAMES = ["cat", "dog", "fox", "hen", "cow", "boy", "girl", "bird"]


def passage(band: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(LEVELS[band - 1].format(*r.sample(NAMES, 2)) for _ in range(6))


def test_held_out_accuracy(spark, data):
    graded = spark.read.parquet(f"{data}/graded.parquet")
    exact, near = reading.fit(graded).held_out
    assert exact > 0.85 and near > 0.98


def test_levels(spark):
    graded = spark.createDataFrame([(k, passage(b, k), b, "g") for k, b in enumerate([1, 2, 3, 4, 5] * 12)], "passage_id bigint, text string, band int, grader string")
    rows = [("b", b, p, 0, s, "x") for b in range(1, 6) for p, s in enumerate(passage(b, 999 + b).split(". "))]
    rows += rows[:3] + [("b", 9, 0, 0, "Die Köchin verkaufte den blauen Vorhang.", "x"), ("b", 9, 1, 0, None, "x"), ("b", 9, 2, 0, "", None), ("c", None, None, None, "The cat sat on the wall by the tree.", None)]
    df = spark.createDataFrame(rows, "book_id string, spine_idx int, para_idx int, sent_idx int, text string, band string")
    out = {r.spine_idx: r for r in reading.levels(df, graded).collect()}
    assert [out[b].band for b in range(1, 6)] == [1, 2, 3, 4, 5]
    assert out[9].band is None and out[9].share_english == 0.0
    assert out[None].band in (1, 2)
    assert abs(sum(out[1][f"p{k}"] for k in range(1, 6)) - 1) < 1e-6
    assert reading.levels(df.limit(0), graded).count() == 0


def test_word_shares_equal_whole_vectors():
    grader = reading.Grader([(passage(b, k), b) for k, b in enumerate([1, 2, 3, 4, 5] * 3)])
    for b in range(1, 6):
        s = LEVELS[b - 1].format("cat", "dog")
        p = grader.grade(["", "Die Köchin verkaufte Brot", s])
        assert (p[:2, :5] == 0).all() and p[1, 6] > 0 and p[2, 8] == 1
        assert abs(p[2, :5] - reading.softmax(reading.features(s) @ grader.sentence)).max() < 1e-4
