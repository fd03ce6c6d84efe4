"""Evaluation passages inside a training corpus (problem 7).

Wu-Manber multi-pattern search over normalised tokens.  The test strings are
all windows of ``m`` consecutive tokens of the evaluation items.  A table of
two-token blocks says how far the cursor may jump; where it says zero, the
hash of the window's tokens selects a bucket of test strings and the tokens
are compared.  The confirmed occurrences of an item inside a document are then
chained in the item's order, within a stretch of text not much longer than the
item, and the item is reported if the chain holds at least half of its tokens.

The items are read in blocks of bounded size, each block against all
documents, so the tables sent to the executors never grow with the corpus or
with the size of the evaluation set.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One token: an ideograph or kana, or a run of other letters and digits.
TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿]")
#: (items in ideographs, tokens of a test string, share of the item's size that must occur as test strings in one place).
#: Of half of an item kept in runs of r tokens on average, test strings of m tokens are (r - m + 1) / 2r of its size: none is
#: missed whose kept words stand in runs of two, or ideographs in runs of three, on average.
PASSES = ((False, 3, 1 / 8), (False, 2, 1 / 4), (True, 3, 1 / 6))
SEP, UNKNOWN = -2, -1
#: Slots in which occurrences are counted before they are sorted.
SLOTS = 1 << 20
STRIPE = 256
#: Share of an item that a document must hold.
SHARE = 0.5
#: Least share of an occurrence's text that belongs to the item; the rest is edits and short insertions.
DENSE = 0.65

#: Most tokens of the item between two neighbours of a chain that still count.
GAP = 12


def tokens(text: str) -> list[str]:
    """Normalised tokens: case, punctuation, width and layout set aside."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return TOKEN.findall(text.casefold())


class WuManber:
    """Tables for test strings of ``m`` tokens, given as rows of ``strings``."""

    BITS = 18

    def __init__(self, strings: np.ndarray, m: int):
        self.m = m
        self.strings = strings
        keys = self.window_hash(strings.T)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order
        self.shift = np.full(1 << self.BITS, m - 1, np.int32)
        for end in range(1, m):  # a block that ends k tokens before the end allows a jump of k
            block = self.block_hash(strings[:, end - 1], strings[:, end])
            np.minimum.at(self.shift, block, m - 1 - end)

    def block_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA77) >> 7) & ((1 << self.BITS) - 1)

    @staticmethod
    def window_hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ (c.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in ``text`` and numbers of all test strings that occur there."""
        m, none = self.m, (np.empty(0, np.int64), np.empty(0, np.int64))
        if len(text) < m or not len(self.strings):
            return none
        ends = []
        cursor = np.arange(m - 1, len(text), STRIPE)
        limit = np.minimum(cursor + STRIPE, len(text))
        while len(cursor):
            jump = self.shift[self.block_hash(text[cursor - 1], text[cursor])]
            hit = cursor[jump == 0]
            if len(hit):
                ends.append(hit)
            cursor = cursor + np.maximum(jump, 1)
            alive = cursor < limit
            cursor, limit = cursor[alive], limit[alive]
        if not ends:
            return none
        start = np.concatenate(ends) - (m - 1)
        key = self.window_hash([text[start + k] for k in range(m)])
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        start, lo, n = start[n > 0], lo[n > 0], n[n > 0]
        which = self.order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        start = np.repeat(start, n)
        same = np.ones(len(start), bool)
        for k in range(m):
            same &= text[start + k] == self.strings[which, k]
        return start[same], which[same]


class Block:
    """A block of evaluation items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.texts, kinds = [], [], []
        for item_id, text in items:
            words = tokens(text or "")
            if words:
                self.ids.append(item_id)
                self.texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
                kinds.append(sum(bool(IDEOGRAPH.match(w)) for w in words) * 2 > len(words))
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.searches = []
        for cjk, most, share in PASSES:
            mine = [k for k, kind in enumerate(kinds) if kind == cjk and len(self.texts[k]) > 1]
            # items shorter than a test string are test strings themselves
            for m in sorted({min(most, len(self.texts[k])) for k in mine}):
                rows, owner, at = [], [], []
                for k in mine:
                    t = self.texts[k]
                    if min(most, len(t)) == m:
                        w = np.lib.stride_tricks.sliding_window_view(t, m)
                        rows.append(w)
                        owner.append(np.full(len(w), k))
                        at.append(np.arange(len(w)))
                if rows:
                    self.searches.append((WuManber(np.concatenate(rows), m), np.concatenate(owner), np.concatenate(at), share))
        self.single = {int(self.texts[k][0]): k for k in range(len(self.texts)) if len(self.texts[k]) == 1}

    def find(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index in ``texts``, item id) of each leak."""
        get, parts, begins, n = self.vocabulary.get, [], [], 0
        for text in texts:
            ids = [get(w, UNKNOWN) for w in tokens(text)] if text else []
            begins.append(n)
            parts.extend(ids)
            parts.append(SEP)
            n += len(ids) + 1
        stream, begins = np.array(parts, np.int64), np.array([*begins, n], np.int64)
        found: set[tuple[int, int]] = set()
        for matcher, owner, at, share in self.searches:
            start, which = matcher.search(stream)
            if not len(start):
                continue
            doc = np.searchsorted(begins, start, "right") - 1
            group = doc * len(self.texts) + owner[which]
            # most documents share only a phrase or two with an item; slots may be shared, so counts are never too low
            slot = group & (SLOTS - 1)
            likely = np.bincount(slot, minlength=SLOTS)[slot] >= share * self.sizes[owner[which]]
            group, start, which = group[likely], start[likely], which[likely]
            order = np.argsort(group * (n + 1) + start)
            group, start, pos = group[order], start[order], at[which][order]
            item = group % len(self.texts)
            # an occurrence lies in a stretch of `reach` tokens, with at least `share` of the item's size in test strings
            reach = (SHARE * self.sizes[item] + matcher.m + GAP) / DENSE
            place = group * (n + 1) + start
            last = np.searchsorted(place, np.minimum(place + reach.astype(np.int64), group * (n + 1) + n), "right")
            dense = np.flatnonzero(last - np.arange(len(place)) >= share * self.sizes[item])
            if not len(dense):
                continue
            # stretches that overlap are looked at together
            fresh = np.concatenate([[True], (dense[1:] >= np.maximum.accumulate(last[dense])[:-1]) | (np.diff(group[dense]) != 0)])
            for a, b in zip(dense[fresh], np.maximum.reduceat(last[dense], np.flatnonzero(fresh))):
                k = int(item[a])
                d = int(group[a]) // len(self.texts)
                if (d, self.ids[k]) not in found and occurs(stream, self.texts[k], start[a:b], pos[a:b], matcher.m, int(begins[d]), int(begins[d + 1]) - 1):
                    found.add((d, self.ids[k]))
        for word, k in self.single.items():
            for d in np.unique(np.searchsorted(begins, np.flatnonzero(stream == word), "right") - 1):
                found.add((int(d), self.ids[k]))
        return sorted(found)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short token strings."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        u = row & where.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def occurs(stream: np.ndarray, item: np.ndarray, start: np.ndarray, pos: np.ndarray, m: int, low: int, high: int) -> bool:
    """Whether the stretches of ``stream[low:high]`` that hold the occurrences ``start`` hold ``SHARE`` of ``item`` in order."""
    need = SHARE * len(item)
    reach = int((need + m + GAP) / DENSE)
    # long runs of stretches are cut into pieces, each stretch whole in one of them
    begin = 0
    while begin < len(start):
        end = int(np.searchsorted(start, start[begin] + 2 * reach, "right"))
        a, b = max(low, int(start[begin]) - GAP), min(high, int(start[end - 1]) + m + GAP)
        # no chain holds more than the longest common subsequence
        if common(item, stream[a:b]) >= need and holds(stream, item, start[begin:end], pos[begin:end], m, low, high):
            return True
        if end == len(start):
            return False
        begin = max(begin + 1, int(np.searchsorted(start, start[end - 1] - reach, "left")))
    return False


def holds(stream: np.ndarray, item: np.ndarray, start: np.ndarray, pos: np.ndarray, m: int, low: int, high: int) -> bool:
    """Whether one stretch of ``stream[low:high]`` holds ``SHARE`` of ``item`` in order.

    ``start`` and ``pos`` are occurrences of the item's test strings.  They are
    chained to the longest run that rises in both; what lies between two
    neighbours of the chain, if both gaps are short, and up to ``GAP`` tokens
    before and behind it, counts by longest common subsequence.
    """
    need = SHARE * len(item)
    s, p = start.tolist(), pos.tolist()
    tails, link, last = [], [-1] * len(s), []
    # longest chain rising in both; equal starts are visited from the highest position down
    for k in sorted(range(len(s)), key=lambda j: (s[j], -p[j])):
        j = bisect_left(tails, p[k])
        if j == len(tails):
            tails.append(p[k])
            last.append(k)
        else:
            tails[j], last[j] = p[k], k
        link[k] = last[j - 1] if j else -1
    chain, k = [], last[-1]
    while k >= 0:
        chain.append(k)
        k = link[k]
    chain.reverse()
    # steps of the chain: tokens held, and where in the text each begins and ends
    steps, ps, pp = [], None, None
    for k in chain:
        if ps is None or s[k] - ps > 16 or p[k] - pp > GAP:
            # nothing near before it: what stands at the edges may still be the item's
            floor, ground = 0, low
            if ps is not None:
                after = max(0, min(GAP, p[k] - pp, s[k] - ps))
                if after:
                    steps.append((common(item[pp : pp + after], stream[ps : ps + after]), ps, ps + after))
                floor, ground = pp + after, ps + after
            before = min(GAP, p[k] - floor, s[k] - ground)
            if before > 0:
                steps.append((common(item[p[k] - before : p[k]], stream[s[k] - before : s[k]]), s[k] - before, s[k]))
            gs = gp = 0
            ps, pp = s[k], p[k]
        gs, gp = s[k] - ps, p[k] - pp
        if gs >= 0 and gp >= 0:
            between = common(item[pp : p[k]], stream[ps : s[k]]) if gp and gs else 0
            steps.append((m + between, s[k], s[k] + m))
            ps, pp = s[k] + m, p[k] + m
        else:  # overlaps the last one: count only what is new on both sides
            new = min(s[k] + m - ps, p[k] + m - pp)
            if new > 0:
                steps.append((new, s[k], s[k] + m))
                ps, pp = s[k] + m, p[k] + m
    if (after := min(GAP, len(item) - pp, high - ps)) > 0:
        steps.append((common(item[pp : pp + after], stream[ps : ps + after]), ps, ps + after))
    # some stretch of the chain must hold enough, with no more than short insertions in between
    held, first = 0, 0
    for got, _, stop in steps:
        held += got
        while held - steps[first][0] >= need:
            held -= steps[first][0]
            first += 1
        if held >= need and held >= DENSE * (stop - steps[first][1]):
            return True
    return False


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that hold at least half of an item.

    Null and empty texts of either side match nothing; repeated rows count
    once; empty tables give no rows; other columns are ignored.  An item is
    split by no block; a block takes items of ``block_chars`` characters.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", items.schema[item_id].dataType)])
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    out = None
    for block in blocks(wanted.toLocalIterator(), block_chars):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ready = Block(shared.value)
            for b in batches:
                for lo in range(0, len(b), 2000):
                    part = b.iloc[lo : lo + 2000]
                    hits = ready.find(part["text"].tolist())
                    if hits:
                        ids = part["doc_id"].to_numpy()
                        yield pd.DataFrame({"doc_id": [ids[d] for d, _ in hits], "item_id": [i for _, i in hits]})

        part = docs.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def blocks(rows, most: int) -> Iterator[list[tuple[int, str]]]:
    """The rows (item_id, text) in lists of about ``most`` characters."""
    block, size = [], 0
    for row in rows:
        if block and size + len(row.text) > most:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block
