"""Joint IRT fits: planted probabilities come back, splits and dimensions together, no exchange of answers."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemscope.operators import irt_fit as fit


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(7)
    m, n = 50, 160
    theta = r.normal(size=(m, 2))
    a = np.abs(r.normal(1.2, 0.4, (n, 2)))
    a[::2, 1] *= -1
    b = r.normal(size=n)
    p = 1 / (1 + np.exp(-(theta @ a.T - b)))
    return p, (r.random((m, n)) < p).astype(int)


@pytest.fixture(scope="module")
def fitted(spark, planted):
    _, x = planted
    rows = [(s, m, i, int(x[m, i])) for s in ("p", "q") for m in range(50) for i in range(160) if (m * 7 + i * 3) % 11 or s == "q"]
    answers = spark.createDataFrame(rows, "split_id string, model_id int, item_id long, resp int")
    items, abilities = fit.fit_grid(answers, [1, 2], tol=0.05)
    return answers, items, abilities


def curves(items, abilities, split, d):
    i = sorted((r.item_id, r.a, r.b) for r in items.collect() if (r.split_id, r.dims) == (split, d))
    t = sorted((r.model_id, r.theta) for r in abilities.collect() if (r.split_id, r.dims) == (split, d))
    a, beta, theta = np.array([x[1] for x in i]), np.array([sum(x[2]) for x in i]), np.array([x[1] for x in t])
    assert a.shape == (160, d) and theta.shape == (50, d)
    return 1 / (1 + np.exp(-(theta @ a.T - beta))), a


def test_two_dimensions_come_back(fitted, planted):
    _, items, abilities = fitted
    p, _ = planted
    for split in ("p", "q"):
        two, a = curves(items, abilities, split, 2)
        one, _ = curves(items, abilities, split, 1)
        assert np.corrcoef(two.ravel(), p.ravel())[0, 1] > 0.9
        assert np.abs(two - p).mean() < np.abs(one - p).mean()
        assert (a.mean(0) >= 0).all()


def test_abilities_with_fixed_items_agree(spark, fitted):
    answers, items, abilities = fitted
    got = fit.abilities_grid(answers.where("split_id = 'q'"), items.where("split_id = 'q'"), prior_sd=1.0)
    again = {(r.dims, r.model_id): r.theta for r in got.collect()}
    first = {(r.dims, r.model_id): r.theta for r in abilities.where("split_id = 'q'").collect()}
    assert set(again) == set(first)
    assert max(np.abs(np.array(again[k]) - np.array(first[k])).max() for k in first) < 0.2


def test_item_step_is_newton():
    r = np.random.default_rng(3)
    theta, x = r.normal(size=(40, 2)), (r.random((5, 40)) < 0.5).astype(float)
    mask = r.random((5, 40)) < 0.8
    a, beta = np.ones((5, 2)), np.zeros(5)
    def objective(a, beta):
        p = fit._curve(a, beta, theta)
        like = np.where(mask, x * np.log(p) + (1 - x) * np.log(1 - p), 0).sum(1)
        return like - ((a - 1) ** 2).sum(1) / 2 - beta ** 2 / 8
    for _ in range(25):
        before = objective(a, beta)
        a, beta = fit.item_step(a, beta, theta, x, mask, (1.0, 1.0, 2.0))
        assert (objective(a, beta) >= before - 1e-9).all()
    for k in range(3):      # the top: no direction climbs
        for e in (1e-4, -1e-4):
            da, db = a.copy(), beta.copy()
            if k < 2:
                da[:, k] += e
            else:
                db += e
            assert (objective(da, db) <= objective(a, beta) + 1e-9).all()


def test_rounds_move_no_answers(spark, fitted):
    answers, _, _ = fitted
    x = answers.withColumn("x", F.col("resp").cast("double"))
    rows = fit.Bucketed(fit.by_item(x, fit.model_index(x)), 3)
    par = fit.Bucketed(rows.read().select("split_id", "item_id", F.array(F.array(F.lit(1.0), F.lit(0.0))).alias("par")), 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            rows.read().join(par.read(), ["split_id", "item_id"]).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        rows.drop()
        par.drop()
    assert "SortMergeJoin" in out.getvalue() and "Exchange" not in out.getvalue()


def test_too_many_models_are_refused():
    with pytest.raises(ValueError, match="abilities"):
        fit._check(10_000_000, [15])
