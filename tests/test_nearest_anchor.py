"""Nearest anchors by squares of growing width, against every pair."""

import numpy as np
import pytest

from itemscope.operators import select

PARAMS = "item_id long, vec array<double>"
ITEMS = "item_id long, item_pos long, scenario string, bal_w double"
SEL = "sampling string, n_items int, iter int, scenario string, item_id long, item_pos long"


def _run(spark, vec, scenario, weight, chosen):
    n = len(vec)
    params = spark.createDataFrame([(i, [float(x) for x in vec[i]]) for i in range(n)], PARAMS)
    items = spark.createDataFrame([(i, i, scenario[i], float(weight[i])) for i in range(n)], ITEMS)
    sel = spark.createDataFrame([("s", len(c), it, scenario[i], i, i) for it, c in enumerate(chosen) for i in c], SEL)
    got = {}
    for r in select.nearest_anchor_weights(params, sel, items).collect():
        assert (r.iter, r.item_id) not in got
        got[r.iter, r.item_id] = r.weight
    want = {}
    for it, c in enumerate(chosen):
        for i in c:
            want[it, i] = 0.0
        for i in range(n):
            near = [j for j in c if scenario[j] == scenario[i]]
            if near:
                dist = [round(float(np.sqrt(((vec[i] - vec[j]) ** 2).sum())), 12) for j in near]
                j = min(zip(dist, near))[1]
                want[it, j] += weight[i] / sum(w for w, s in zip(weight, scenario) if s == scenario[i])
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_against_every_pair(spark, dims):
    r = np.random.default_rng(dims)
    n = 240
    vec = r.normal(size=(n, dims)).round(2)
    vec[:12] *= 40  # far from everything
    vec[50:60] = vec[40]  # ties
    scenario = ["big" if x < 0.8 else "small" for x in r.random(n)]
    _run(spark, vec, scenario, r.random(n) + 0.1, [r.choice(n, k, replace=False).tolist() for k in (30, 3)])


def test_clustered_and_single_anchors(spark):
    """Anchors in one corner, one anchor alone, all items in one place."""
    r = np.random.default_rng(9)
    vec = r.random((120, 2)) * 100
    vec[:20] = r.random((20, 2)) * 1e-3
    _run(spark, vec, ["a"] * 120, np.ones(120), [list(range(20)), [77]])
    _run(spark, np.ones((10, 2)), ["a"] * 10, np.ones(10), [[3, 5]])


def test_empty(spark):
    params, items = spark.createDataFrame([(1, [0.0, 1.0])], PARAMS), spark.createDataFrame([(1, 1, "a", 1.0)], ITEMS)
    sel = spark.createDataFrame([("s", 1, 0, "a", 1, 1)], SEL)
    assert select.nearest_anchor_weights(params, sel.limit(0), items).count() == 0
    assert select.nearest_anchor_weights(params.limit(0), sel, items).count() == 0
    assert [r.weight for r in select.nearest_anchor_weights(params, sel, items).collect()] == [1.0]


def test_items_meet_only_near_anchors(spark, monkeypatch):
    """The first round joins on the square, not on the scenario alone, and settles most items."""
    r = np.random.default_rng(2)
    vec = r.random((400, 2))
    params = spark.createDataFrame([(i, vec[i].tolist()) for i in range(400)], PARAMS)
    items = spark.createDataFrame([(i, i, "a", 1.0) for i in range(400)], ITEMS)
    sel = spark.createDataFrame([("s", 100, 0, "a", i, i) for i in range(100)], SEL)
    sizes, keep = [], select.written_table

    def watch(df):
        out = keep(df)
        sizes.append((tuple(out.columns), out.count()))
        return out
    monkeypatch.setattr(select, "written_table", watch)
    select.nearest_anchor_weights(params, sel, items).count()
    first = next(n for c, n in sizes if "dist" in c)
    assert first > 360
