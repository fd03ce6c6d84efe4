"""Problem 7, against a search by brute force."""

from __future__ import annotations

import random

import numpy as np

from lectern.llm import leakage as L

WORDS = [f"w{k}" for k in range(400)]


def text(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def test_wu_manber_against_brute_force():
    r = np.random.default_rng(0)
    for m in (2, 4, 5):
        stream = r.integers(-2, 6, 5000)
        strings = np.array([stream[k : k + m] for k in r.integers(0, 4900, 40)] + [r.integers(0, 6, m) for _ in range(20)])
        start, which = L.WuManber(strings, m).search(stream)
        brute = {(k, j) for k in range(len(stream) - m + 1) for j in range(len(strings)) if (stream[k : k + m] == strings[j]).all()}
        assert set(zip(start.tolist(), which.tolist())) == brute


def test_common_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 12))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert L.common(a, b) == t[-1, -1]


def test_leaks(spark):
    r = random.Random(5)
    items = {k: text(r, 60) for k in range(20)}
    docs, truth = [], set()
    for k, words in items.items():
        filler = lambda: text(r, 80)
        edited = [w if j % 9 else "x" for j, w in enumerate(words)]
        chunks = [words[j : j + 5] for j in range(0, 60, 5)]
        shuffled = [w for k in (9, 10, 6, 11, 7, 3, 8, 4, 0, 5, 1, 2) for w in chunks[k]]
        for name, body, leak in (("whole", words, True), ("edited", edited, True), ("most", words[:42], True), ("some", words[20:40], False), ("shuffled", shuffled, False), ("inserted", [w for j, w in enumerate(words) for w in ([w, "note", "x"] if j % 12 == 0 else [w])], True)):
            docs.append((len(docs), ", ".join(filler() + [w.upper() for w in body] + filler()) + "!", name))
            if leak:
                truth.add((len(docs) - 1, k))
        spread = [w for j in range(0, 60, 10) for w in words[j : j + 10] + text(r, 40)]
        docs.append((len(docs), " ".join(spread), "spread"))
    docs += [(9001, None, None), (9002, "", None), (None, " ".join(items[0]), None), (9003, " ".join(items[1]) + " filler" * 100_000, "long")]
    truth |= {(None, 0), (9003, 1)}
    left = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string, item_id string")
    right = spark.createDataFrame([(k, "s", "en", " ".join(w)) for k, w in items.items()] + [(50, "s", "en", None), (51, "s", "en", "")], "item_id bigint, suite string, lang string, text string")
    out = {(None if d != d or d is None else int(d), int(i)) for d, i in L.leaks(left, right).toPandas().itertuples(index=False)}
    assert out == truth
    # in blocks of a few items each the result is the same
    again = {(None if d != d or d is None else int(d), int(i)) for d, i in L.leaks(left, right, block_chars=500).toPandas().itertuples(index=False)}
    assert again == truth
    assert L.leaks(left.limit(0), right).count() == 0 and L.leaks(left, right.limit(0)).count() == 0


def test_ideographs_and_short_items(spark):
    docs = spark.createDataFrame([(1, "前文。船长在桥边卖掉了\n红色的灯笼，后来走了。"), (2, "红色的灯笼卖掉了船长在桥边"), (3, "the word only")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "船长在桥边卖掉了红色的灯笼"), (2, "only"), (3, "word only")], "item_id bigint, text string")
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == {(1, 1), (3, 2), (3, 3)}


def test_leak_behind_a_shuffled_stretch():
    item = [f"w{k}" for k in range(60)]
    blocks = [item[k : k + 6] for k in range(0, 60, 6)]
    shuffled = [w for block in reversed(blocks) for w in (*block, "other")]
    text = " ".join([*shuffled, *(f"x{k}" for k in range(400)), *item[:31]])
    block = L.Block([(1, " ".join(item))])
    assert block.find([text, " ".join(shuffled), " ".join(item[:31])]) == [(0, 1), (2, 1)]


def found(body, item):
    r = random.Random(7)
    filler = lambda: [f"y{r.randrange(5000)}" for _ in range(200)]
    return bool(L.Block([(1, " ".join(item))]).find([" ".join([*filler(), *body, *filler()])]))


def test_few_windows_of_a_long_item():
    item = [f"w{k}" for k in range(480)]
    kept = [w for k, w in enumerate(item) if k % 16 < 12]
    assert len(kept) == 360 and found(kept, item)
    assert found([w for k, w in enumerate(item) if k % 4 < 3], item)


def test_decoy_beside_a_copy():
    item = [f"w{k}" for k in range(120)]
    decoy = [w for k in reversed(range(0, 120, 10)) for w in item[k : k + 10]]
    gap = [f"x{k}" for k in range(300)]
    copy = item[20:86]
    assert not found(decoy, item)
    for body in (copy, [*decoy, *gap, *copy], [*copy, *gap, *decoy], [*decoy, *gap, *copy, *gap, *decoy]):
        assert found(body, item)


def test_edits_every_few_words():
    item = [f"w{k}" for k in range(120)]
    assert found([w if k % 4 else f"z{k}" for k, w in enumerate(item)], item)
    assert found([w if k % 3 else f"z{k}" for k, w in enumerate(item)], item)
    assert found([w if k % 4 else f"z{k}" for k, w in enumerate(item[:87])], item)  # 65 of 120 words
    assert not found([w if k % 4 else f"z{k}" for k, w in enumerate(item[:70])], item)
    ideographs = [chr(0x4E00 + 7 * k) for k in range(120)]
    assert found([c if k % 4 else "很" for k, c in enumerate(ideographs)], ideographs)


def test_every_dense_case_by_brute_force():
    r = random.Random(11)
    item = [f"w{k}" for k in range(90)]
    for _ in range(150):
        # half of the item or more, kept in runs of two words or more, a word between two runs
        body, k, kept = [], r.randrange(0, 12), 0
        while k < len(item):
            run = r.randrange(2, 9)
            body += [*item[k : k + run], f"z{k}"]
            kept += len(item[k : k + run])
            k += run + r.randrange(0, 3)
        if kept >= 48:
            assert found(body, item), body
