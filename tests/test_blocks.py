"""Rounds of fits on kept blocks: same results, no table a round, splits of different D at once, one job a round."""

import os

import numpy as np
import pytest

from itemscope.operators import anchors, irt, irt_fit
from itemscope.session import checkpoint_dir


@pytest.fixture(scope="module")
def answers(spark):
    r = np.random.default_rng(21)
    rows = [(s, m, i, int(r.random() < 0.2 + 0.04 * m)) for s in ("p", "q") for m in range(14) for i in range(50) if (m + 2 * i) % 9]
    return spark.createDataFrame(rows, "split_id string, model_id int, item_id long, resp int")


def values(fit):
    items, abilities = fit
    return ({(r.split_id, r.dims, r.item_id): [*r.a, *r.b] for r in items.collect()},
            {(r.split_id, r.dims, r.model_id): r.theta for r in abilities.collect()})


def same(got, want):
    for g, w in zip(got, want):
        assert set(g) == set(w) and all(np.allclose(g[k], w[k], atol=1e-9) for k in w)


@pytest.fixture(scope="module")
def by_tables(answers):
    kept, irt_fit.TABLE_ROUNDS = irt_fit.TABLE_ROUNDS, 1000
    try:
        return values(irt_fit.fit_grid(answers, [1, 2], rounds=12, tol=1e-9))
    finally:
        irt_fit.TABLE_ROUNDS = kept


def test_later_rounds_write_no_table(answers, by_tables, monkeypatch):
    made = []
    real = irt_fit.Bucketed
    monkeypatch.setattr(irt_fit, "Bucketed", lambda *a: made.append(1) or real(*a))
    same(values(irt_fit.fit_grid(answers, [1, 2], rounds=12, tol=1e-9)), by_tables)
    assert len(made) == 1 + irt_fit.TABLE_ROUNDS


def test_blocks_are_cut_and_added_in_parts(spark, answers, by_tables, monkeypatch):
    monkeypatch.setattr(irt_fit, "CUT_EVERY", 2)
    monkeypatch.setattr(irt_fit, "FAN_IN", 2)
    monkeypatch.setattr(irt_fit, "MODEL_BLOCK", 5)
    monkeypatch.setattr(irt_fit, "ANSWERS_PER_BUCKET", 300)
    monkeypatch.setattr(irt_fit, "CHUNK", 100)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("rdd-")}
    same(values(irt_fit.fit_grid(answers, [1, 2], rounds=12, tol=1e-9)), by_tables)
    assert {f for f in os.listdir(folder) if f.startswith("rdd-")} == before


def test_every_split_has_its_own_dimension(answers, by_tables):
    items, abilities = irt_fit.fit_grid(answers, {"p": 2, "q": 1}, rounds=12, tol=1e-9)
    keep = lambda found: {k: v for k, v in found.items() if k[:2] in (("p", 2), ("q", 1))}
    same(values((items, abilities)), [keep(found) for found in by_tables])
    alone, _ = irt.fit_irt(answers, {"q": 2}, rounds=5)
    assert alone.select("split_id").distinct().collect() == [("q",)] and alone.columns == ["split_id", "item_id", "a", "b"]


def test_rows_without_a_split_or_item_leave_a_fit(spark, answers):
    more = answers.unionByName(spark.createDataFrame([("p", 3, None, 1), (None, 3, 7, 1)], answers.schema))
    got = values(irt_fit.fit_grid(more.where("split_id is null or item_id is not null"), [1], rounds=5, tol=1e-9))
    want = values(irt_fit.fit_grid(answers, [1], rounds=5, tol=1e-9))
    assert {k for k in got[0] if k[0]} == set(want[0])


def test_kmeans_rounds_are_one_job_over_kept_blocks(spark, monkeypatch):
    r = np.random.default_rng(17)
    x = np.concatenate([r.normal(c, 1.0, (40, 3)) for c in (0, 3, 6)])
    points = spark.createDataFrame([(s, "a", 1000 + i, i, 1 / 120, x[i].tolist()) for s in ("p", "q") for i in range(120)],
                                   "split_id string, scenario string, item_id long, item_pos long, nbw double, vec array<double>")
    monkeypatch.setattr(anchors, "BLOCK_ITEMS", 16)
    blocks = anchors._dealt(anchors._blocks(points))
    starts = {(s, "a", n, 0, t): x[t:t + n] for s in ("p", "q") for n in (3, 5) for t in range(2)}
    want = anchors.lloyd(blocks, starts)
    tracker, group = spark.sparkContext.statusTracker(), "kmeans-rounds"
    spark.sparkContext.setJobGroup(group, "")
    try:
        anchors.lloyd(blocks, starts, 4)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = tracker.getJobIdsForGroup(group)
    assert len(jobs) == 4 and all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)
    monkeypatch.setattr(anchors, "WAVE_BYTES", 1)       # sums added by cell, in two steps
    monkeypatch.setattr(anchors, "FAN_IN", 2)
    got = anchors.lloyd(blocks, starts)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
