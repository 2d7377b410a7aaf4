"""K-means of many cells in one plan: against plain Lloyd rounds, bounds, hot scenarios, degenerate points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemscope.operators import anchors as an
from itemscope.session import written_table


def world(spark, n=240, dims=3, hot=0.7, seed=4):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, dims)) + 4 * r.integers(0, 3, (n, 1)), 6)
    scenario = ["hot" if v < hot else "cold" for v in r.random(n)]
    items = spark.createDataFrame([(i, i, scenario[i], float(w)) for i, w in enumerate(r.random(n) + 0.5)],
                                  "item_id long, item_pos long, scenario string, bal_w double")
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "item_id long, vec array<double>")
    return items, features


def plain(x, w, c, rounds):
    for _ in range(rounds):
        d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
        at = d.argmin(1)
        total = np.bincount(at, w, len(c))
        new = np.array([(x[at == j] * w[at == j, None]).sum(0) / total[j] if total[j] > 0 else c[j] for j in range(len(c))])
        if np.allclose(new, c, atol=0):
            break
        c = new
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    return c, (w * d.min(1) ** 2).sum()


def fitted(spark, items, features, cells, rounds=an.MAX_ROUNDS):
    points = written_table(an._points(features, items))
    blocks = written_table(an._blocks(points))
    table = spark.createDataFrame(cells, "split_id string, scenario string, n_items int, iter int, restart int")
    starts = an._starts(points, table)
    return points, blocks, starts, an.lloyd(blocks, starts, rounds)


def inertia(blocks, centres):
    return {tuple(r[k] for k in an.CELL): r.i for r in an.cell_clusters(blocks, centres).groupBy(*an.CELL).agg(
        F.sum("inertia").alias("i")).collect()}


def test_every_cell_equals_plain_lloyd(spark, monkeypatch):
    monkeypatch.setattr(an, "BLOCK_ITEMS", 16)
    items, features = world(spark)
    cells = [("", s, n, i, t) for s in ("hot", "cold") for n in (2, 5) for i in (0, 1) for t in (0, 1)]
    points, blocks, starts, centres = fitted(spark, items, features, cells)
    rows = points.collect()
    found = inertia(blocks, centres)
    assert set(starts) == set(cells)
    for cell in cells:
        own = [r for r in rows if r.scenario == cell[1]]
        x, w = np.array([r.vec for r in own]), np.array([r.nbw for r in own])
        c, best = plain(x, w, starts[cell], 300)
        assert np.allclose(centres[cell], c, atol=1e-9)
        assert found[cell] == pytest.approx(best, abs=1e-9)


def test_inertia_never_rises(spark):
    items, features = world(spark, n=150)
    cells = [("", s, 4, 0, t) for s in ("hot", "cold") for t in range(2)]
    runs = [inertia(*fitted(spark, items, features, cells, rounds)[1::2]) for rounds in (1, 2, 4, 300)]
    for before, after in zip(runs, runs[1:]):
        assert all(after[c] <= before[c] + 1e-12 for c in before)


def test_bounds_skip_points_and_change_nothing():
    r = np.random.default_rng(0)
    x, c = r.normal(size=(400, 4)), r.normal(size=(6, 4))
    state, moved = an._reassign(x, c, None, None)
    assert moved == 400
    for _ in range(12):
        new = c + r.normal(size=c.shape) * 0.05
        shift = np.sqrt(((new - c) ** 2).sum(1))
        state, _ = an._reassign(x, new, state, shift)
        full = an._distances(x, new)
        assert (state["at"] == full.argmin(1)).all()
        assert (state["upper"] >= full.min(1) - 1e-12).all()
        full[np.arange(400), state["at"]] = np.inf
        assert (state["lower"] <= full.min(1) + 1e-12).all()
        c = new
    calls = []
    an_distances = an._distances
    an._distances = lambda x, c: calls.append(len(x)) or an_distances(x, c)
    try:
        an._reassign(x, c, state, np.zeros(6))
    finally:
        an._distances = an_distances
    assert sum(calls) == 0


def test_waves_keep_the_result(spark, monkeypatch):
    items, features = world(spark, n=120)
    want = an.kmeans_anchors(features, items, [3, 6], iters=2, restarts=2).toPandas()
    monkeypatch.setattr(an, "WAVE_BYTES", 200)
    got = an.kmeans_anchors(features, items, [3, 6], iters=2, restarts=2).toPandas()
    key = ["n_items", "iter", "scenario", "item_pos"]
    assert got.sort_values(key).round(9).reset_index(drop=True).equals(want.sort_values(key).round(9).reset_index(drop=True))
    assert (want.groupby(["n_items", "iter", "scenario"]).weight.sum() - 1).abs().max() < 1e-9
    assert (want.groupby(["n_items", "iter", "scenario"]).size() == [3, 3, 3, 3, 6, 6, 6, 6]).all()


def test_equal_points_and_larger_grids(spark):
    items = spark.createDataFrame([(i, i, "s", 1.0) for i in range(6)], "item_id long, item_pos long, scenario string, bal_w double")
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "item_id long, vec array<double>")
    got = an.kmeans_anchors(same, items, [3, 6, 9]).toPandas()
    assert got.groupby("n_items").weight.sum().round(9).tolist() == [1.0, 1.0, 1.0]
    assert got.groupby("n_items").size().tolist() == [3, 6, 6]


def test_empty_cluster_moves_to_the_farthest_point(spark):
    items = spark.createDataFrame([(i, i, "s", 1.0) for i in range(6)], "item_id long, item_pos long, scenario string, bal_w double")
    features = spark.createDataFrame([(i, [v]) for i, v in enumerate([0.0, 0.0, 0.0, 0.0, 0.0, 9.0])], "item_id long, vec array<double>")
    blocks = written_table(an._blocks(written_table(an._points(features, items))))
    cell = ("", "s", 2, 0, 0)
    got = an.lloyd(blocks, {cell: np.array([[0.0], [0.0]])})
    assert sorted(got[cell].ravel().tolist()) == [0.0, 9.0]


def test_no_items(spark):
    items, features = world(spark, n=10)
    assert an.kmeans_anchors(features, items.limit(0), [2]).count() == 0
