"""Findings of round 3: fits that send no item table to the driver, abilities without sorting, distances by products."""

import numpy as np
from pyspark.sql import functions as F

from itemscope.operators import anchors, irt, irt_fit


def answers(spark, models=12, items=40):
    r = np.random.default_rng(11)
    right = r.random((models, items)) < 0.6
    rows = [(s, m, i, int(right[m, i])) for s in ("p", "q") for m in range(models) for i in range(items) if (m + 3 * i) % 7]
    return spark.createDataFrame(rows, "split_id string, model_id int, item_id long, resp int")


def test_rounds_of_a_fit_broadcast_no_items(spark, monkeypatch):
    plans = []
    step = irt_fit._round

    def watched(rows, *args):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return step(rows, *args)
    monkeypatch.setattr(irt_fit, "_round", watched)
    irt_fit.fit_grid(answers(spark), [1], rounds=3, tol=1e-9)
    assert len(plans) == 3
    assert all("SortMergeJoin" in p and "Broadcast" not in p and "Exchange" not in p for p in plans[1:])


def test_a_small_fit_is_dealt_out():
    assert irt_fit._buckets(1_000_000) >= 4


def test_round_steps_every_item_on_its_own_answers(spark):
    x = answers(spark).withColumn("x", F.col("resp").cast("double"))
    rows = irt_fit.by_item(x, irt_fit.model_index(x)).withColumn("par", F.lit(None).cast("array<double>"))
    dims, priors = [1, 2], (1.0, 1.0, 2.0)
    r = np.random.default_rng(5)
    thetas = {(s, d): r.normal(size=(12, d)) for s in ("p", "q") for d in dims}
    sent = spark.sparkContext.broadcast((thetas, set(thetas) - {("q", 2)}))
    out = irt_fit._round(rows, dims, sent, 2, priors).collect()
    par = {(o.split_id, o.item_id): np.array(o.par) for o in out if o.par}
    held = {(o.split_id, o.item_id): (o.m, o.x) for o in rows.collect()}
    assert set(par) == set(held) and len(held) == 80
    total = {}
    for (split, item), (m, values) in held.items():
        for d, at in zip(dims, irt_fit.par_columns(dims)):
            a, beta, theta = np.ones((1, d)), np.zeros(1), thetas[split, d][m]
            if (split, d) != ("q", 2):
                given = np.array(values)[None], np.ones((1, len(m)), bool)
                for _ in range(2):
                    a, beta = irt_fit.item_step(a, beta, theta, *given, priors)
                sums = total.setdefault((split, d), np.zeros((12, d + d * d)))
                sums[m] += irt_fit.ability_sums(a, beta, theta, *given)
            assert np.allclose(par[split, item][at], [*a[0], beta[0]])
    got = {}
    for o in out:
        if o.sums:
            got[o.split_id, o.dims] = got.get((o.split_id, o.dims), 0) + np.array(o.sums).reshape(12, -1)
    assert set(got) == set(total) and all(np.allclose(got[k], total[k]) for k in total)


def test_abilities_are_summed_without_sorting_answers(spark, monkeypatch):
    plans = []
    cut = irt.cut_lineage

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)
    monkeypatch.setattr(irt, "cut_lineage", watched)
    rows = answers(spark).where("split_id = 'p'").drop("split_id")
    items = spark.range(40).select(F.col("id").alias("item_id"), F.array(F.lit(1.2), F.lit(0.4)).alias("a"), F.array(F.lit(0.1), F.lit(0.0)).alias("b"))
    got = irt.estimate_abilities(rows, items, ["model_id"], 2)
    assert {len(r.theta) for r in got.collect()} == {2} and got.count() == 12
    assert plans and all("HashAggregate" in p and "SortAggregate" not in p for p in plans)


def test_near_ties_are_decided_by_differences():
    r = np.random.default_rng(2)
    for x in (r.integers(0, 2, (300, 30)).astype(float), r.normal(size=(300, 5)) + 1e6):
        c = np.concatenate([x[:6], x[:1], x[4:8] + 1e-13])
        full = anchors._distances(x, c)
        at, own, other = anchors._nearest(x, c)
        assert (at == full.argmin(1)).all() and np.allclose(own, full.min(1), rtol=1e-12, atol=0)
        assert (other <= np.sort(full, 1)[:, 1]).all()


def test_lloyd_rounds_write_nothing(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(200, 3))
    points = spark.createDataFrame([("", "s", i, i, 1 / 200, x[i].tolist()) for i in range(200)],
                                   "split_id string, scenario string, item_id long, item_pos long, nbw double, vec array<double>")
    blocks = anchors.written_table(anchors._blocks(points))
    monkeypatch.setattr(anchors, "written_table", lambda df: 1 / 0)
    cell = ("", "s", 4, 0, 0)
    got = anchors.lloyd(blocks, {cell: x[:4]})[cell]
    c = x[:4]
    while True:
        at = anchors._distances(x, c).argmin(1)
        new = np.array([x[at == k].mean(0) for k in range(4)])
        if np.allclose(new, c, atol=1e-13):
            break
        c = new
    assert np.allclose(got, c)


def test_a_missing_score_touches_its_own_cluster_only(spark):
    x = [[0.0], [0.2], [0.4], [None], [10.0], [10.2]]
    points = spark.createDataFrame([("", "s", i, i, 1 / 6, v) for i, v in enumerate(x)],
                                   "split_id string, scenario string, item_id long, item_pos long, nbw double, vec array<double>")
    got = anchors.lloyd(anchors.written_table(anchors._blocks(points)), {("", "s", 2, 0, 0): np.array([[0.0], [10.0]])})
    (centres,) = got.values()
    assert np.isnan(centres[0, 0]) and np.isclose(centres[1, 0], 10.1)
