"""Filling fixed-capacity containers with whole documents (problem 6).

Documents are sized in tokens and dealt by hash into shards of bounded size,
so no task ever holds more than a shard's sizes.  Within a shard, shallow
combinations (of up to three lengths) that fill a window exactly on a grid of
lengths are enumerated and their repeat counts are solved against the shard's
length histogram by non-negative least squares, then rounded down.  Windows
grow threefold up to the capacity, so that combinations of combinations reach
containers of many documents.  What rounding leaves over, and a reserve of the
shortest documents, is packed greedily, longest first into the container with
least room.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Lengths are rounded up to this many steps of a window.
GRID = 64
#: Items of a shard.
SHARD = 50_000
#: Share of all tokens, in the shortest items, kept back to fill what is left open.
RESERVE = 0.04
#: Kinds of containers that are filled at a time; more are filled in turns.
KINDS = 1000


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the public tokenizers' package keeps ``name``."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def encoder(key: str, content: bytes):
    """The tokenizer of a file's content; a worker builds it once."""
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def sized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Distinct (doc_id, n_tokens) of each document; null and empty texts have 0 tokens."""
    with open(path or tokenizer_file(), "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, f.read()))
    kind = documents.schema[doc_id].dataType.simpleString()
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(*shared.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "_h": b["_h"], "n_tokens": [len(encode(t)) if t else 0 for t in b["text"]]})

    return own.mapInPandas(size, f"doc_id {kind}, _h bigint, n_tokens bigint").dropDuplicates(["doc_id", "_h"]).drop("_h")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= 1e-7 * max(1.0, abs(b).max()):
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                x = z
                break
            low = passive & (z <= 0)
            step = (x[low] / (x[low] - z[low])).min()
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def combinations(grid: int = GRID) -> list[tuple[int, ...]]:
    """All combinations of one to three steps that fill ``grid`` exactly."""
    out: list[tuple[int, ...]] = [(grid,)]
    out += [(a, grid - a) for a in range(1, grid // 2 + 1)]
    out += [(a, b, grid - a - b) for a in range(1, grid // 3 + 1) for b in range(a, (grid - a) // 2 + 1)]
    return out


COMBINATIONS = combinations()
MATRIX = np.zeros((GRID + 1, len(COMBINATIONS)))
for _j, _c in enumerate(COMBINATIONS):
    for _k in _c:
        MATRIX[_k, _j] += 1


def largest(classes: list[list], room: int, least: int, window: int):
    """Takes the longest unit of at most ``room`` from class ``least`` or above."""
    for k in range(min(GRID, -(-room * GRID // window)), least - 1, -1):
        at = bisect_right(classes[k], room, key=lambda u: u[0])
        if at:
            return classes[k].pop(at - 1)
    return classes[least].pop()


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; every size is between 1 and ``capacity``."""
    n = len(sizes)
    number = np.full(n, -1, np.int64)
    if not n:
        return number
    order = np.argsort(sizes, kind="stable")
    small = order[(np.cumsum(sizes[order]) <= RESERVE * sizes.sum()) & (sizes[order] <= capacity // 32)]
    kept = np.ones(n, bool)
    kept[small] = False
    units = [(int(sizes[k]), [int(k)]) for k in np.flatnonzero(kept)]
    windows = [capacity]
    while windows[-1] // 3 >= GRID:
        windows.append(windows[-1] // 3)
    closed: list[tuple[int, list[int]]] = []
    for window in reversed(windows):
        classes: list[list[tuple[int, list[int]]]] = [[] for _ in range(GRID + 1)]
        rest = []
        for u in sorted(units, key=lambda u: u[0]):
            if u[0] <= window:
                classes[-(-u[0] * GRID // window)].append(u)
            else:
                rest.append(u)
        repeats = nnls(MATRIX[1:], np.array([len(c) for c in classes[1:]], float))
        made = []
        for j in np.argsort(-repeats):
            combination = COMBINATIONS[j]
            need = {k: combination.count(k) for k in combination}
            times = int(repeats[j])
            for _ in range(times):
                if any(len(classes[k]) < m for k, m in need.items()):
                    break
                parts = [classes[k].pop() for k in combination[:-1]]
                # the last part makes up for what rounding lengths up to the grid has left open
                parts.append(largest(classes, window - sum(p[0] for p in parts), combination[-1], window))
                made.append((sum(p[0] for p in parts), [i for p in parts for i in p[1]]))
        left = [u for c in classes for u in c]
        if window == capacity:
            closed, units = made, left + rest
        else:
            units = made + left + rest
    # greedy: best fit of what is left over, longest first; combinations come apart only where they fit nowhere
    room: dict[int, list[int]] = {}
    mask = 0
    content: list[list[int]] = []

    def put(free: int, k: int) -> None:
        nonlocal mask
        room.setdefault(free, []).append(k)
        mask |= 1 << free

    for total, items in closed:
        content.append(items)
        put(capacity - total, len(content) - 1)
    singles = [(int(sizes[i]), i) for _, items in units for i in items] + [(int(sizes[i]), int(i)) for i in small]
    for s, i in sorted(singles, key=lambda p: (-p[0], p[1])):
        above = mask >> s
        if above:
            free = s + (above & -above).bit_length() - 1
            k = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            content[k].append(i)
            put(free - s, k)
        else:
            content.append([i])
            put(capacity - s, len(content) - 1)
    for k, items in enumerate(content):
        number[items] = k
    return number


def packed(documents: DataFrame, containers: DataFrame, shard: int = SHARD, path: str | None = None, **names) -> DataFrame:
    """(container_kind, container_no, doc_id, piece, start_token, n_tokens): every document's place in each kind.

    A document longer than the capacity is cut into pieces of full capacity
    and a rest; all others stay whole.  Documents without tokens need no room:
    they are listed with a null ``container_no`` and piece 0.  Kinds with null
    or non-positive capacity are left out.  Equal documents under different
    ids are different items; repeated rows count once.
    """
    sizes = durable(sized(documents, path=path, **names))
    kind = sizes.schema["doc_id"].dataType.simpleString()
    kinds = [(r.container_kind, int(r.capacity)) for r in containers.select("container_kind", "capacity").distinct().toLocalIterator() if r.capacity is not None and r.capacity > 0]
    schema = f"container_kind string, container_no bigint, doc_id {kind}, piece int, start_token bigint, n_tokens bigint"
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    shards = max(1, -(-sizes.count() // shard))
    sharded = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("bigint"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "n_tokens"], kind="stable")
        capacity, number = int(group["capacity"].iloc[0]), int(group["shard"].iloc[0])
        n = group["n_tokens"].to_numpy(np.int64)
        whole, rest = n // capacity, n % capacity
        pieces = np.where(n > 0, whole + (rest > 0), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[row] - piece * capacity)
        full, empty = size == capacity, size == 0
        place = np.zeros(len(row), np.int64)
        place[full] = np.arange(full.sum())
        open_ = ~full & ~empty
        place[open_] = fill(size[open_], capacity) + full.sum()
        out = pd.DataFrame({"container_kind": group["container_kind"].iloc[0], "container_no": pd.array(place + (number << 32), dtype="Int64"), "doc_id": group["doc_id"].to_numpy()[row], "piece": piece.astype("int32"), "start_token": piece * capacity, "n_tokens": size})
        out.loc[empty, "container_no"] = pd.NA
        return out

    out = None
    for lo in range(0, len(kinds), KINDS):
        each = F.explode(F.array(*[F.struct(F.lit(k).cast("string").alias("container_kind"), F.lit(c).alias("capacity")) for k, c in kinds[lo : lo + KINDS]]))
        rows = sharded.withColumn("_c", each).select("_c.container_kind", F.col("_c.capacity").cast("bigint").alias("capacity"), "shard", "doc_id", "n_tokens")
        part = rows.groupBy("container_kind", "capacity", "shard").applyInPandas(pack, schema)
        out = part if out is None else out.unionByName(part)
    return out


def report(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of each kind."""
    used = filled.where("container_no is not null").groupBy("container_kind").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(containers.select("container_kind", "capacity").distinct(), "container_kind").withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))
