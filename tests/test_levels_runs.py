"""Both metric levels from one scan, and run results by dynamic partitions."""

import contextlib
import io
import json

import numpy as np
from pyspark.sql import functions as F

from itemscope.operators import metrics
from itemscope.sources import io as sio


def _tables(spark, seed=3):
    r = np.random.default_rng(seed)
    est = [("iid", m, "random", "naive", n, i, s, float(r.integers(0, 8)) / 8)
           for m in range(7) for n in (10, 20) for i in range(3) for s in ("a", "b", "c")]
    est += [("iid", m, "-", "flat", 10, 0, s, 0.5) for m in range(7) for s in ("a", "b", "c")]
    truth = [("iid", m, s, float(r.random())) for m in range(7) for s in ("a", "b", "c")]
    return (spark.createDataFrame(est, "split_id string, model_id long, sampling string, estimator string, n_items int, "
                                       "iter int, scenario string, acc_hat double"),
            spark.createDataFrame(truth, "split_id string, model_id long, scenario string, acc double"))


def _key(r, *more):
    return (r.estimator, r.n_items, *more)


def test_levels_equal_the_single_metrics(spark):
    est, truth = _tables(spark)
    got = {_key(r, r.scenario): r for r in metrics.metric_levels(est, truth).collect()}
    assert len(got) == 3 * 4
    for r in metrics.mae(est, truth).collect():
        x = got[_key(r, metrics.ALL)]
        assert abs(x.mae - r.mae) < 1e-12 and abs(x.spread - r.spread) < 1e-12
    for r in metrics.mae(est, truth, "scenarios").collect():
        assert abs(got[_key(r, metrics.ALL)].mae_scenarios - r.mae) < 1e-12
    for s in "abc":
        for r in metrics.mae(est.where(F.col("scenario") == s), truth.where(F.col("scenario") == s)).collect():
            x = got[_key(r, s)]
            assert abs(x.mae - r.mae) < 1e-12 and x.mae_scenarios is None
    both = [(metrics.ALL, metrics.spearman(est, truth))] + [
        (s, metrics.spearman(est, truth, per_scenario=True).where(F.col("scenario") == s)) for s in "abc"]
    for s, table in both:
        for r in table.collect():
            x = got[_key(r, s)].rank_corr
            assert (x is None) == bool(np.isnan(r.rank_corr)) and (x is None or abs(x - r.rank_corr) < 1e-12)


def test_levels_edge_rows(spark):
    est, truth = _tables(spark)
    assert metrics.metric_levels(est.limit(0), truth).count() == 0
    assert metrics.metric_levels(est, truth.limit(0)).count() == 0
    # a scenario named null is a scenario of its own kind without truth: it takes no part
    odd = est.withColumn("scenario", F.when(F.col("scenario") == "a", F.lit(None)).otherwise(F.col("scenario")))
    assert {r.scenario for r in metrics.metric_levels(odd, truth).collect()} == {metrics.ALL, "b", "c"}


def test_runs_replace_only_their_own(spark, tmp_path):
    root = str(tmp_path / "results")
    cols = "bench string, split_id string, family string, v int"
    sio.write_runs(spark.createDataFrame([("b", "iid", "x", 1), ("b", "iid", "y", 2), ("c", "ood", "x", 3)], cols), root)
    sio.write_runs(spark.createDataFrame([("b", "iid", "x", 10), ("b", "iid", "x", 11)], cols), root)
    sio.write_runs(spark.createDataFrame([], cols), root)
    cat = {"b": {"iid": {"x": root, "y": "elsewhere"}}, "c": {"ood": {"x": root, "z": root}, "iid": {}}, "d": {}}
    path = str(tmp_path / "catalog.json")
    with open(path, "w") as f:
        json.dump(cat, f, indent=1)
    runs = sio.read_run_catalog(spark, path)
    assert sorted(map(tuple, runs.collect())) == [("b", "iid", "x", root), ("b", "iid", "y", "elsewhere"),
                                                  ("c", "ood", "x", root), ("c", "ood", "z", root)]
    got = sio.read_runs(spark, root, runs.unionByName(runs))
    assert sorted((r.bench, r.split_id, r.family, r.v) for r in got.collect()) == [
        ("b", "iid", "x", 10), ("b", "iid", "x", 11), ("c", "ood", "x", 3)]


def test_runs_are_pruned_at_run_time(spark, tmp_path):
    root, path = str(tmp_path / "results"), str(tmp_path / "catalog.json")
    df = spark.range(40).select(F.lit("b").alias("bench"), F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("split_id"),
                                F.lit("x").alias("family"), "id")
    sio.write_runs(df, root)
    with open(path, "w") as f:
        json.dump({"b": {"s7": {"x": root}}}, f)
    got = sio.read_runs(spark, root, sio.read_run_catalog(spark, path))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain("formatted")
    assert "dynamicpruning" in text.getvalue().lower() and "Union" not in text.getvalue()
    assert sorted(r.id for r in got.collect()) == [7, 27]
