"""op3: many blocks are answered and scored in parts, and probabilities take the place of the logits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

lm = pytest.importorskip("itemscope.llm.lm_scoring")


def test_many_blocks_are_scored_in_parts(spark, monkeypatch):
    tables = []
    stash = lm.stash

    def watched(df, *args, **kwargs):
        tables.append(stash(df, *args, **kwargs))
        return tables[-1]
    monkeypatch.setattr(lm, "stash", watched)
    many = 4 * spark.sparkContext.defaultParallelism
    rows = [(i, f"words of text {i % 5} and {'more ' * (i % 7)}") for i in range(3 * many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 7 != 2
    got = {r.doc_id: r for r in lm.score_documents(docs.repartition(many), train).collect()}
    parts = [t.count() for t in tables if "score" in t.columns]
    assert len(parts) == 2 and sum(parts) == len(rows) and max(parts) < len(rows)
    want = {r.doc_id: r for r in lm.score_documents(docs.coalesce(1), train).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert got[i].n_known == r.n_known and math.isclose(got[i].score, r.score, rel_tol=1e-9)


def _plain(x, bit):
    """One part, bit by bit."""
    f = np.float32
    weight = np.tile(np.array(lm.START, f), (x.shape[1], 1))
    lift, out = np.zeros(32, f), []
    for row, b in zip(x, bit):
        v, sign, gate = row.astype(f) * f(1 / lm.SCALE), f(2 * b - 1), int((row[1:] != 0).sum())
        dot = np.clip(np.sum(weight[gate] * v, dtype=f), f(-15), f(15))
        p = f(1) / (f(1) + np.exp(-sign * dot))
        slot = 16 + int(dot)
        q = f(1) / (f(1) + np.exp(-sign * (dot + lift[slot])))
        lift[slot] += f(lm.REFINE) * sign * (f(1) - q)
        weight[gate] += f(lm.RATE) * sign * (f(1) - p) * v
        out.append((p + q) / 2)
    return np.array(out)


def test_probabilities_take_the_place_of_logits():
    r = np.random.default_rng(3)
    size = np.array([1, 300, 64, 129, 300, 7])
    hi = np.cumsum(size)
    x = np.where(r.random((hi[-1], 4)) < 0.3, 0, r.integers(-5, 6, (hi[-1], 4))).astype(np.int8)
    bit = r.integers(0, 2, len(x)).astype(np.int8)
    held = x.copy()
    got = object.__new__(lm.Model)._mix(held, bit, hi - size, hi)
    assert np.shares_memory(got, held)
    for a, b in zip(hi - size, hi):
        assert np.allclose(got[a:b], _plain(x[a:b], bit[a:b]), rtol=1e-4)


def test_rows_of_contexts_by_index():
    r = np.random.default_rng(8)
    for known in (r.integers(0, 2**56, 5000, dtype=np.uint64), np.arange(3000, dtype=np.uint64), np.array([2**56 - 1], np.uint64)):
        known = np.unique(known) << np.uint64(8)
        asked = np.concatenate([known, r.integers(0, 2**56, 500, dtype=np.uint64) << np.uint64(8), known[-1:] + np.uint64(256)])
        at = dict(zip(known.tolist(), range(1, len(known) + 1)))
        assert lm.Model.row(asked, 0, known, lm.Model.index(known)).tolist() == [at.get(k, 0) for k in asked.tolist()]


def test_costs_are_summed_some_tokens_at_a_time(monkeypatch):
    """One sum over all bits copies them at twice their size, which an executor could not hold."""
    r = np.random.default_rng(2)
    texts = lm.words(lm.pa.array([" ".join("ab" * int(n) for n in r.integers(1, 9, 40)) for _ in range(30)] + [None, ""]))
    whole = lm.canonical(texts)
    data, off, token, _ = whole
    keys = lm._numbers(np.concatenate([c | data.astype(np.uint64) for c in lm.contexts(data, off)]))
    model = lm.Model(keys, lm.Tree(np.bincount(data, minlength=256)))
    want, longest, reduceat = model.cost(data, off, token), [], np.add.reduceat
    monkeypatch.setattr(lm, "SUMMED", 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, lm.canonical(texts)))

    class Add:
        def __call__(self, *args):
            return add(*args)

        def reduceat(self, x, at, dtype):
            longest.append(len(at))
            return reduceat(x, at, dtype=dtype)
    add = np.add
    monkeypatch.setattr(lm.np, "add", Add())
    got = model.cost(data, off, token)
    assert np.array_equal(got, want) and max(longest) == 50
