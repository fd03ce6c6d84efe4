"""Problems 1 and 3."""

from __future__ import annotations

import pytest

from lectern.llm import pairs

ASKED = "Her crowded parcel gathered this honest lantern across the faded bridge."
NOTE = "分析：crowded parcel（拥挤的包裹）。整体翻译：她的拥挤的包裹收集诚实的灯笼穿过褪色的桥。单词解释：parcel指“包裹”，lantern的意思是“灯笼”。"
SCHEMA = "book_id string, spine_idx int, para_idx int, sent_idx int, text string, note_content string, note_error boolean, loaded_at string, _piece int"


@pytest.mark.parametrize(
    "note, defect",
    [
        (NOTE, ""),
        (NOTE[:-1], ""),  # only the last full stop is missing
        (NOTE[: NOTE.index("单词")], ""),  # a section left out
        (NOTE[: NOTE.index("单词") - 4], "open"),
        (NOTE[:-3], "open"),
        (NOTE[:20], "open"),
        (NOTE[:-2] + "�", "open"),
        (NOTE.replace("：", ":"), ""),
        ("好的，" + NOTE, ""),
        (None, "empty"),
        ("", "empty"),
        ("​", "empty"),
        ("……", "empty"),
        ("分析：\n整体翻译：\n单词解释：", "empty"),
        (ASKED, "copy"),
        (ASKED.upper(), "copy"),
        ("“" + ASKED.lower().rstrip(".") + "”", "copy"),
        (f"分析：{ASKED}整体翻译：{ASKED}单词解释：", "copy"),
        (ASKED + "（原文）", "copy"),
        (ASKED.rstrip(".") + "（原文）", "copy"),
        ("（" + ASKED + "）", "copy"),
        ("抱歉，我无法解释这个句子（内容敏感）。", "refusal"),
        ("这个句子我帮不了你，请换一个。", "refusal"),
        ("解释这样的内容超出了我的能力范围。", "refusal"),
        ("This is beyond what I am able to do here.", "refusal"),
        ("Translating this sentence is not something I can do; it is outside my scope, sorry.", "refusal"),
        ("整体翻译：拥挤的包裹收集灯笼，不能穿过桥。单词解释：parcel指“包裹”。", ""),
        ("抱歉，我无法解释这句话。", "refusal"),
        ("作为一个语言模型，我没有办法完成这个请求，因为它可能涉及不适当的内容。", "refusal"),
        ("I'm sorry, but I can't help with that sentence.", "refusal"),
        ("这句话说的是：我抱歉，我不能回答，她说。其中crowded parcel（拥挤的包裹）。", ""),
        ("The main clause is “crowded parcel gathered”, and the rest only qualifies it. Overall someone did what was long expected.", "language"),
        ("“parcel”는 여기서 옛 뜻으로 쓰였습니다. 전체 뜻은 오래 기다린 일을 했다는 것입니다.", "language"),
        ("「crowded parcel」が主節で、残りはそれを修飾しています。長く待たれたことをした、という意味です。", "language"),
    ],
)
def test_judge(note, defect):
    assert pairs.judge(ASKED, note)[0] == defect


def test_glossed_denial_is_no_refusal():
    note = "分析：cannot explain this sentence（无法解释这个句子）。整体翻译：我无法解释这个句子。单词解释：explain指“解释”。"
    assert pairs.judge("I cannot explain this sentence.", note)[0] == ""


def test_prefix_keys_against_brute_force():
    notes = [NOTE, NOTE[:40], "分析：a（甲乙），b（甲乙丙）。整体翻译：甲乙丙丁", "", "没有标点"]
    each = [u for n in notes for u in pairs.units(n)[0]]
    longer = each + [pairs.units(n)[1] for n in notes]
    got = pairs.prefixes(notes).set_index("_piece")
    for tail in ("甲乙", "甲", "很甲乙丙", "parcel甲乙丙丁", "她的拥挤的包裹", "b", "单词解", "xa"):
        starts = [k for k in range(len(tail)) if not (k and tail[k].isascii() and tail[k - 1].isascii())]
        keys = pairs.endings(tail)
        assert len(keys) == len(starts)
        for k, key in zip(starts, keys):
            row = got.loc[key] if key in got.index else {"whole": 0, "longer": 0}
            assert row["whole"] == each.count(tail[k:]) and row["longer"] == sum(u.startswith(tail[k:]) and u != tail[k:] for u in longer), (tail, k)
    assert pairs.endings("") == []


def test_tiles_against_brute_force():
    import random

    random.seed(1)
    for _ in range(200):
        a, b = ([random.choice("xyz") for _ in range(random.randrange(12))] for _ in range(2))
        covered, _ = pairs.tiles(a, b, 3)
        least = max(1, min(3, len(a), len(b)))
        runs = {tuple(b[j : j + n]) for n in range(least, len(b) + 1) for j in range(len(b) - n + 1)}
        common = [(n, i) for n in range(least, len(a) + 1) for i in range(len(a) - n + 1) if tuple(a[i : i + n]) in runs] if a and b else []
        # nothing but words of common runs is covered, and one of the longest is covered wholly
        assert all(any(i <= k < i + n for n, i in common) for k, c in enumerate(covered) if c)
        if common:
            top = max(n for n, _ in common)
            assert any(all(covered[i : i + n]) for n, i in common if n == top)


def test_judged(spark):
    other = NOTE.replace("parcel", "letter").replace("包裹", "信件")
    rows = [("b", 0, 0, k, ASKED, n, e, "x", 1) for k, (n, e) in enumerate([(NOTE, False), (NOTE[:-6], False), (NOTE[: NOTE.index("单词") - 4], None), (None, False), (ASKED, False), ("Ollama请求失败: x", True), (other, False)])]
    rows += [rows[1], ("b", None, 0, None, None, NOTE[:-3], False, None, None), ("b", 0, 0, 9, "", NOTE * 200, False, "x", 1)]
    found = pairs.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.sent_idx: r.defect for r in found}
    assert len(found) == 9
    assert by == {0: None, 1: "truncated", 2: "truncated", 3: "empty", 4: "copy", 5: None, 6: None, None: "truncated", 9: None}
    assert all(r.longer > 0 for r in found if r.defect == "truncated")


def test_missing_stop_is_complete(spark):
    whole = "整体翻译：她的包裹收集灯笼"
    asked = "Her parcel gathered a lantern."
    rows = [("b", 0, 0, 0, ASKED, NOTE, False, "x", 1), ("b", 0, 0, 1, asked, whole, False, "x", 1), ("b", 0, 0, 2, asked, whole[:-3], False, "x", 1)]
    by = {r.sent_idx: r.defect for r in pairs.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by == {0: None, 1: None, 2: "truncated"}


def test_hot_endings(spark):
    # every note ends in the same open unit; it goes on in one of them
    rows = [("b", 0, 0, k, ASKED, f"整体翻译：第{k}个她的拥挤的包", False, "x", 1) for k in range(300)]
    rows += [("b", 1, 0, 0, ASKED, NOTE, False, "x", 1), ("b", 1, 0, 1, None, "整体翻译：从未见过", False, "x", 1), ("b", 1, 0, 2, None, None, None, None, None)]
    by = {(r.spine_idx, r.sent_idx): r.defect for r in pairs.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(by[0, k] == "truncated" for k in range(300)) and by[1, 0] is None and by[1, 1] is None and by[1, 2] == "empty"


def test_empty_table(spark):
    assert pairs.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_by_source(spark):
    rows = [("b", 0, 0, k, ASKED, NOTE[: len(NOTE) - 6 * (k % 2)], k == 9, m) for k, m in enumerate(["m"] * 4 + [None] * 4 + ["m", "m"])]
    df = spark.createDataFrame(rows, "book_id string, spine_idx int, para_idx int, sent_idx int, text string, note_content string, note_error boolean, model string")
    assert {(r.model, r.n_notes, r.n_truncated) for r in pairs.by_source(df).collect()} == {("m", 5, 2), (None, 4, 2)}
