"""Problem 6."""

from __future__ import annotations

import numpy as np
import pytest

from lectern.llm import packing


@pytest.mark.parametrize("capacity", [7, 64, 256, 1000, 12288])
@pytest.mark.parametrize("seed", [0, 1])
def test_fill(capacity, seed):
    r = np.random.default_rng(seed)
    sizes = np.minimum(np.maximum(1, r.lognormal(5, 1, 3000).astype(int)), capacity)
    number = packing.fill(sizes, capacity)
    held = np.bincount(number, weights=sizes)
    assert (number >= 0).all() and held.max() <= capacity and held.min() > 0
    assert len(held) * capacity - sizes.sum() <= max(0.06 * sizes.sum() + capacity, np.maximum(0, np.sum(sizes > capacity / 2) * capacity - sizes.sum()))


def test_fill_edges():
    assert len(packing.fill(np.array([], int), 10)) == 0
    assert packing.fill(np.array([10]), 10).tolist() == [0]
    assert len(set(packing.fill(np.full(1000, 5), 10).tolist())) == 500
    assert len(set(packing.fill(np.full(1000, 6), 10).tolist())) == 1000


def test_nnls_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(20):
        a, b = r.random((6, 4)), r.random(6) * 3 - 1
        x = packing.nnls(a, b)
        best = np.inf
        for mask in range(16):
            use = [k for k in range(4) if mask >> k & 1]
            z = np.zeros(4)
            if use:
                z[use] = np.linalg.lstsq(a[:, use], b, rcond=None)[0]
            if (z >= -1e-12).all():
                best = min(best, np.linalg.norm(a @ z - b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= best + 1e-6


def test_packed(spark):
    rows = [(k, "word " * n, "x") for k, n in enumerate([1, 5, 30, 400, 3000, 12, 12, 12])] + [(100, None, None), (101, "", None), (1, "word " * 5, "y"), (None, "lost", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, capacity string")
    kinds = spark.createDataFrame([("a", 256), ("b", 1024), ("a", 256), ("none", None), ("zero", 0)], "container_kind string, capacity int")
    out = packing.packed(docs, kinds).toPandas()
    assert set(out["container_kind"]) == {"a", "b"}
    for kind, capacity in (("a", 256), ("b", 1024)):
        own = out[out["container_kind"] == kind]
        assert own.groupby("container_no")["n_tokens"].sum().max() <= capacity
        sizes = packing.sized(docs).toPandas()
        total = own.groupby("doc_id")["n_tokens"].sum()
        assert {(d, n) for d, n in zip(sizes["doc_id"].dropna(), sizes.loc[sizes["doc_id"].notna(), "n_tokens"])} == set(total.items())
        split = own[own.groupby("doc_id")["piece"].transform("max") > 0]
        assert set(split["doc_id"].dropna()) == {d for d, n in total.items() if n > capacity}
        for _, p in split.groupby("doc_id"):
            p = p.sort_values("piece")
            assert (p["start_token"].to_numpy() == np.concatenate([[0], p["n_tokens"].cumsum()[:-1]])).all()
        assert own[own["doc_id"].isin([100, 101])]["container_no"].isna().all()
    assert packing.packed(docs.limit(0), kinds).count() == 0
    report = {r.container_kind: r for r in packing.report(packing.packed(docs, kinds), kinds).collect()}
    assert report["b"].n_containers >= 4


def test_kinds_in_turns(spark, monkeypatch):
    monkeypatch.setattr(packing, "KINDS", 2)
    docs = spark.createDataFrame([(k, "word " * (k + 1)) for k in range(20)], "doc_id bigint, text string")
    kinds = spark.createDataFrame([(f"k{c}", c) for c in (8, 16, 32, 64, 128)], "container_kind string, capacity int")
    out = packing.packed(docs, kinds).toPandas()
    assert out.groupby("container_kind")["n_tokens"].sum().nunique() == 1 and out["container_kind"].nunique() == 5
