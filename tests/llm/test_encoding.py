"""Problem 8: round trips through wrong encodings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from lectern.llm import encoding as E

CLEAN = {
    "fr": "La fleuriste a retrouvé la vieille lettre après la fête. Le pêcheur a brisé la clé rouillée à l'aube. Sa sœur a cherché l'étranger.",
    "de": "Die Köchin verkaufte den Schlüssel für die Großmutter. Der Nachtwächter öffnete die hölzerne Kiste früh am Morgen.",
    "ru": "Молодой учитель нашёл серебряные часы на чердаке. Повар спрятал бабушкину шаль после праздника. Сосед купил билет.",
    "zh": "船长在桥边卖掉了红色的灯笼。她的姐姐悄悄地打开了那本日记，邻居的孩子清晨忘记了半张车票。",
    "en": "The painter, called Öndrik, was at the café. “He said it was 21° at noon — and left.” The sign read SÃO TELMO, and she hummed “Âme et forêt”. It cost £3 ½.",
}


def swapped(text: str, true: str, wrong: str) -> str:
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(true))


GARBLED = [
    ("fr", swapped(CLEAN["fr"], "utf-8", "cp1252")),
    ("fr", swapped(swapped(CLEAN["fr"], "utf-8", "cp1252"), "utf-8", "latin-1")),
    ("de", CLEAN["de"].encode("utf-8").decode("mac_roman")),
    ("de", CLEAN["de"].encode("cp1252").decode("cp437")),
    ("ru", CLEAN["ru"].encode("cp1251").decode("latin-1")),
    ("ru", CLEAN["ru"].encode("koi8_r").decode("cp1251", "replace").replace("�", "Ј")),
    ("zh", CLEAN["zh"].encode("gb18030").decode("latin-1")),
    ("en", CLEAN["en"].replace("—", "â€”")),
]


@pytest.fixture(scope="module")
def corpus():
    texts = [(k, t) for k, t in CLEAN.items() for _ in range(60)] + GARBLED
    return [(n, t, "s" + str(n % 2) if n % 7 else None, "x") for n, (_, t) in enumerate(texts)]


def test_repaired(spark, corpus):
    rows = corpus + [(9001, None, "s0", "x"), (9002, "", None, "x"), (9003, "plain ascii", "s1", "x"), (9004, "lost caf�", "s1", "x"), (None, GARBLED[0][1], None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, restored string")
    out = {r.doc_id: r.restored for r in E.repaired(df).collect()}
    first = len(CLEAN) * 60
    assert set(out) == set(range(first, first + len(GARBLED))) | {9004, None}
    exact = [0, 1, 2, 3, 4, 6, 7]
    for k in exact:
        assert out[first + k] == CLEAN[GARBLED[k][0]], GARBLED[k][1][:40]
    assert E.repaired(df.limit(0)).count() == 0


def unnamed(text: str, seed: int = 5) -> str:
    """``text`` in a page that no table knows: the letters of three languages permuted over odd letters."""
    import random

    letters = "éèêàçùôîâûëïœäöüßñáíóú"
    symbols = random.Random(seed).sample("ąćęłńśźżđĺŕőűůťďčěňřšţ", len(letters))
    return text.translate(dict(zip(map(ord, letters), symbols)))


def test_unnamed_page(spark):
    import random

    r = random.Random(3)
    stems = "for,plan,mar,ven,cal,tor,lin,bas,ren,pol,cam,dor".split(",")
    ends = "é,ée,ère,ête,âge,ôle,ègue,éter,îtra,ûche,açon,ïde".split(",")
    vocabulary = [a + b for a in stems for b in ends]
    text = lambda: " ".join(r.choices(vocabulary, k=60))
    sound = [(k, text(), f"s{k % 3}") for k in range(150)]
    clean = [text() for _ in range(6)]
    rows = sound + [(1000 + k, unnamed(t), "s1") for k, t in enumerate(clean)] + [(2000, "Öndrik and Łukasz met Ysaür and Maëlor. Żaneta saw Śliwa.", "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {row.doc_id: row.restored for row in E.repaired(df).collect()}
    assert set(out) == {1000 + k for k in range(6)}
    # bigrams alone do not tell all letters apart: é and ê before t
    right = sum(a == b for k, t in enumerate(clean) for a, b in zip(t, out[1000 + k]) if not a.isascii())
    assert right >= 0.8 * sum(not c.isascii() for t in clean for c in t)


def test_learned_letters_override_a_page(spark):
    # written in cp1254 and read in cp850: Turkish letters where the nearest page known has Icelandic ones
    import random

    r = random.Random(4)
    vocabulary = [a + b for a in "kar,tas,bak,gel,sor,yaz,dur,kal,bil,gor".split(",") for b in "ış,lığı,ıyı,şı,ğını,çık,üş,öğü,ıştı,şığı".split(",")]
    text = lambda: " ".join(r.choices(vocabulary, k=60))
    clean = [text() for _ in range(8)]
    rows = [(k, text(), "a") for k in range(150)] + [(1000 + k, t.encode("cp1254").decode("cp850"), "b") for k, t in enumerate(clean)]
    out = {row.doc_id: row.restored for row in E.repaired(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert set(out) == {1000 + k for k in range(8)}
    right = sum(a == b for k, t in enumerate(clean) for a, b in zip(t, out[1000 + k]) if not a.isascii())
    assert right >= 0.9 * sum(not c.isascii() for t in clean for c in t)


def test_bulk_counts_equal_single_ones():
    words, n = pd.Series(["é", "Köchin", "译文参考", "“ab”x", "Ìî—é", "a😀b"]), pd.Series([3, 1, 2, 5, 1, 1])
    table = np.zeros(E.SIZE)
    for w, k in zip(words, n):
        for p in E.pairs(w):
            table[p] += k
    assert (table == E.pair_counts(words, n)).all()


def test_ciphers_read_back_every_letter():
    for (wrong, true), table in E.CIPHERS.items():
        for byte in range(0x80, 0x100):
            try:
                letter, misread = bytes([byte]).decode(true), bytes([byte]).decode(wrong)
            except UnicodeDecodeError:
                continue
            assert misread.translate(table) == letter


#: Beginnings of differing length: sound text, a digit, a Latin word.
BEFORE = ["她说", "邻居的孩子", "2024", "Ardwick", ""]


@pytest.fixture(scope="module")
def model():
    words = pd.Series([w for w in E.odd_words(CLEAN["zh"])] + [w for w in E.odd_words(CLEAN["fr"])])
    return E.Model(E.pair_counts(words, pd.Series([60] * len(words))))


@pytest.mark.parametrize("before", BEFORE)
@pytest.mark.parametrize(("wrong", "back"), [("gb18030", "船长在桥边卖掉了红色的灯�"), ("shift_jis", "船长在桥边卖掉�红色�灯笼")])
def test_garbled_part_of_a_run(model, before, wrong, back):
    misread = "船长在桥边卖掉了红色的灯笼".encode().decode(wrong, "replace")
    assert E.restore(before + misread, model, {}) == (True, before + back)


def test_lost_bytes_cost_only_their_letters(model):
    clean = CLEAN["zh"]
    garbled, text = E.restore("她说" + clean.encode().decode("gb18030", "replace"), model, {})
    assert garbled and E.LOST in text
    assert sum(text.count(c) for c in set(clean)) >= 0.85 * len(clean)


def test_one_byte_misreading_beside_sound_cjk(model):
    sound = "船长在桥边卖掉了红色的灯笼"
    assert E.restore(sound + "â€œ" + sound, model, {}) == (True, sound + "“" + sound)


def test_sound_cjk_stays(model):
    for text in (CLEAN["zh"], "2024年" + CLEAN["zh"], CLEAN["zh"] + "联通·很好Python联"):
        assert E.restore(text, model, {}) == (False, text)


def test_plain_words_are_not_tried_letter_by_letter():
    import time

    text = "Zoë\t" + "a" * 100_000 + " “naïve”\x1fcafé\x7f x\n" + "b" * 100_000
    began = time.process_time()
    assert list(E.odd_words(text)) == ["Zoë", "“naïve”", "café\x7f"]
    assert time.process_time() - began < 1


@pytest.mark.parametrize("wrong", E.WIDE_READ)
def test_pieces_of_sound_runs(wrong):
    # a long plain stretch counts only beside a piece that can be a misreading, and as one
    garbled = "船长".encode().decode(wrong, "replace")
    assert E.atoms("中" + "plain" * 20 + "中", wrong) == []
    pieces = E.atoms("中" + "plain" * 20 + garbled + "words", wrong)
    assert pieces[0] == (1, 101, "plain" * 20) and pieces[-1][2] == "words"
