"""What no seed enters is built once for all runs on an input."""

from __future__ import annotations

from itemscope.operators import estimate
from itemscope.plans import evaluate
from itemscope.plans.context import EvalContext

SF = "/root/testdata/sf0.001"


def test_two_runs_build_variants_and_constants_once(spark, monkeypatch):
    calls = []

    def counted(owner, name, result):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a: calls.append(name) or (real(*a) if result is None else result))
    constant = spark.createDataFrame([("iid", 0, "alpha", 0.5)], "split_id string, model_id int, scenario string, acc_hat double")
    counted(evaluate, "disagreement_variants", None)
    counted(estimate, "perfect_knn", constant)
    counted(estimate, "mean_train_score_est", constant)
    monkeypatch.setattr(estimate, "knn", lambda test, train, truth: estimate.expand_constant(
        constant, test.select("split_id", "n_items", "iter"), "KNN"))
    ctx = EvalContext(spark, SF, materialize=False)
    for seed in (0, 100):
        evaluate.fixture_estimates(ctx, ("random", "high-disagreement"), (10,), 1, seed=seed)
    assert sorted(calls) == ["disagreement_variants", "mean_train_score_est", "perfect_knn"]
    other = EvalContext(spark, SF, materialize=False)
    evaluate.run_selections(other, ("high-disagreement",), (10,), 1)
    evaluate.run_selections(other, ("high-disagreement",), (10,), 1, kind="jsd")
    assert calls.count("disagreement_variants") == 3    # a context and a kind have their own
