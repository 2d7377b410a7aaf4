"""Property, edge-case and metamorphic tests on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemscope.functions import softmax_array, with_softmax
from itemscope.operators import estimate, etl, items as items_ops, metrics, select, stats, tables


def _probs(spark, rows, n_classes=3):
    return spark.createDataFrame(rows, "model_id int, item_id bigint, probs array<double>")


# ------------------------------------------------------------------ softmax / gate
def test_softmax_rows_sum_to_one_and_neg_inf_is_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0, float("-inf")],), ([0.0, 0.0, 0.0],)], "x array<double>")
    out = with_softmax(df, "x", "p").select("p").collect()
    for r in out:
        assert math.isclose(sum(r.p), 1.0, rel_tol=1e-12)
    assert out[0].p[2] == 0.0
    single = df.select(softmax_array("x").alias("p")).collect()
    assert [round(v, 12) for v in single[0].p] == [round(v, 12) for v in out[0].p]


def test_gate_keeps_probabilities(spark):
    df = spark.createDataFrame([(0, 1, [0.2, 0.8]), (1, 1, [0.5, 0.5])],
                               "model_id int, item_id bigint, logits array<double>")
    assert stats.probs_are_normalised(df)
    kept = stats.to_probs(df, mode="auto").orderBy("model_id").collect()
    assert kept[0].probs == [0.2, 0.8]
    forced = stats.to_probs(df, mode="logits").orderBy("model_id").collect()
    assert forced[0].probs != [0.2, 0.8]
    with pytest.raises(ValueError):
        stats.to_probs(df, mode="bogus")


# ------------------------------------------------------------------ PDS / JSD
def _random_probs(spark, n_models=6, n_items=5, c=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(n_models):
        for i in range(n_items):
            p = rng.dirichlet(np.ones(c))
            rows.append((m, i, [float(v) for v in p]))
    return _probs(spark, rows)


def test_pds_and_jsd_ranges(spark):
    df = _random_probs(spark)
    p = {r.item_id: r.score for r in stats.disagreement(df, "pds").collect()}
    j = {r.item_id: r.score for r in stats.disagreement(df, "jsd").collect()}
    assert all(1.0 - 1e-12 <= v <= 4.0 + 1e-12 for v in p.values())
    assert all(-1e-12 <= v <= math.log(4) + 1e-12 for v in j.values())


def test_jsd_matches_direct_formula(spark):
    rng = np.random.default_rng(3)
    arr = rng.dirichlet(np.ones(3), size=(5, 2))   # models x items x classes
    rows = [(m, i, [float(v) for v in arr[m, i]]) for m in range(5) for i in range(2)]
    got = {r.item_id: r.score for r in stats.disagreement(_probs(spark, rows), "jsd").collect()}
    eps = 1e-12
    p = np.clip(arr, eps, None)
    p = p / p.sum(-1, keepdims=True)
    m = np.clip(p.mean(0), eps, None)
    m = m / m.sum(-1, keepdims=True)
    want = (p * (np.log(p) - np.log(m))).sum(-1).mean(0)
    for i in range(2):
        assert math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12)


def test_pds_metamorphic(spark):
    df = _random_probs(spark)
    full = {r.item_id: r.score for r in stats.pds(df).withColumnRenamed("pds", "score").collect()}
    sub = {r.item_id: r.pds for r in stats.pds(df.filter("model_id < 3")).collect()}
    assert all(full[i] >= sub[i] - 1e-12 for i in sub)
    dup = df.unionByName(df.filter("model_id = 0").withColumn("model_id", F.lit(99)))
    again = {r.item_id: r.pds for r in stats.pds(dup).collect()}
    assert all(math.isclose(full[i], again[i], rel_tol=1e-12) for i in full)
    shuffled = {r.item_id: r.pds for r in stats.pds(df.repartition(7)).collect()}
    assert all(math.isclose(full[i], shuffled[i], rel_tol=1e-12) for i in full)


def test_disagreement_unknown_kind(spark):
    with pytest.raises(ValueError):
        stats.disagreement(_random_probs(spark), "entropy")


# ------------------------------------------------------------------ items, quotas, selection
def _items(spark, sizes):
    rows = []
    iid = 0
    for s, (scen, n) in enumerate(sizes):
        for _ in range(n):
            rows.append((iid, scen, s))
            iid += 1
    it = spark.createDataFrame(rows, "item_id bigint, scenario string, sub int")
    cat = it.select("scenario", "sub").distinct().withColumn("scenario_ord", F.lit(0)) \
            .withColumn("sub_ord", F.col("sub"))
    return items_ops.build_items(it, cat)


def test_balance_weights_average_one(spark):
    it = _items(spark, [("a", 3), ("a", 7), ("a", 10)])
    tot = it.agg(F.sum("bal_w")).first()[0]
    assert math.isclose(tot, 20.0, rel_tol=1e-12)     # sum of weights = N per scenario
    pos = sorted(r.item_pos for r in it.collect())
    assert pos == list(range(20))


def test_quotas_edge_cases(spark):
    it = _items(spark, [("a", 3), ("a", 7), ("a", 10)])
    q = {(r.sub, r.n_items): r.quota for r in select.quotas(it, [0, 2, 4, 30]).collect()}
    assert [q[(s, 0)] for s in range(3)] == [0, 0, 0]
    assert [q[(s, 2)] for s in range(3)] == [1, 1, 0]
    assert [q[(s, 4)] for s in range(3)] == [2, 1, 1]
    # k larger than a stratum: the stratum gives all it has
    scores = it.select("item_id", F.lit(1.0).alias("score"))
    sel = select.select_disagreement(scores, it, [30], True, True).collect()
    by_sub = {}
    for r in sel:
        by_sub.setdefault(r.item_pos < 3, 0)
    assert len(sel) == 3 + 7 + 10


def test_ties_high_and_low_take_opposite_ends(spark):
    it = _items(spark, [("a", 6)])
    scores = it.select("item_id", F.lit(0.5).alias("score"))   # all equal
    hi = sorted(r.item_pos for r in select.select_disagreement(scores, it, [2], True, True).collect())
    lo = sorted(r.item_pos for r in select.select_disagreement(scores, it, [2], False, True).collect())
    assert hi == [0, 1] and lo == [4, 5]


def test_random_selection_quota_and_repeatable(spark):
    it = _items(spark, [("a", 5), ("a", 5), ("a", 5)])
    a = select.select_random(it, [4, 7], iters=2).collect()
    b = select.select_random(it.repartition(5), [4, 7], iters=2).collect()
    key = lambda r: (r.n_items, r.iter, r.item_id)
    assert sorted(map(key, a)) == sorted(map(key, b))
    for n in (4, 7):
        for i in (0, 1):
            cell = [r for r in a if r.n_items == n and r.iter == i]
            assert len(cell) == n
            assert math.isclose(sum(r.weight for r in cell), 1.0)


def test_unseen_is_complement(spark):
    it = _items(spark, [("a", 4), ("b", 6)])
    scores = it.select("item_id", (F.col("item_id") * 0.1).alias("score"))
    sel = select.select_disagreement(scores, it, [2], True, True)
    un = select.unseen_items(it, sel).collect()
    assert len(un) == 10 - 4


# ------------------------------------------------------------------ estimators
def test_naive_equals_mean_with_all_items(spark):
    it = _items(spark, [("a", 4), ("a", 4)])
    sc = spark.createDataFrame([(0, i, float(i % 2)) for i in range(8)],
                               "model_id int, item_id bigint, score double")
    sel = select.select_random(it, [8], iters=1)
    nv = estimate.naive(sc, sel).first().acc_hat
    assert math.isclose(nv, 0.5)


def test_pirt_equals_truth_when_all_seen_and_gpirt_between(spark):
    it = _items(spark, [("a", 4), ("a", 4)])
    sc = spark.createDataFrame([(0, i, float(i % 3 == 0)) for i in range(8)],
                               "model_id int, item_id bigint, score double") \
              .withColumn("split_id", F.lit("s"))
    params = it.select("item_id", F.array(F.lit(1.0)).alias("a"), F.array(F.lit(0.0)).alias("b"))
    sel = select.select_random(it, [8], iters=1, split_ids=["s"])
    ab = spark.createDataFrame([("s", 0, "random", 8, 0, [0.3])],
                               "split_id string, model_id int, sampling string, n_items int, iter int, "
                               "theta array<double>")
    truth = stats.true_accuracy(sc, it).first().acc
    pi = estimate.pirt(sc, sel, it, params, ab).first().acc_hat
    assert math.isclose(pi, truth, rel_tol=1e-12)
    # partial selection: gpirt lies between naive and pirt
    sel4 = select.select_random(it, [4], iters=1, split_ids=["s"])
    ab4 = ab.withColumn("n_items", F.lit(4))
    nv = estimate.naive(sc, sel4)
    pi4 = estimate.pirt(sc, sel4, it, params, ab4)
    lam = spark.createDataFrame([("s", "a", 4, "random", 0.3)],
                                "split_id string, scenario string, n_items int, kind string, lambda double")
    g = estimate.gpirt(nv, pi4, lam).first().acc_hat
    a, b = nv.first().acc_hat, pi4.first().acc_hat
    assert min(a, b) - 1e-12 <= g <= max(a, b) + 1e-12


def test_knn_zero_vector_is_floored(spark):
    sig = spark.createDataFrame(
        [("s", "x", 2, 0, 0, [0.0, 0.0]), ("s", "x", 2, 0, 1, [1.0, 0.0]), ("s", "x", 2, 0, 2, [0.0, 1.0])],
        "split_id string, sampling string, n_items int, iter int, model_id int, features array<double>")
    test = sig.filter("model_id = 0")
    train = sig.filter("model_id > 0")
    truth = spark.createDataFrame([("s", 1, 0, "a", 0.7), ("s", 2, 1, "a", 0.2)],
                                  "split_id string, model_id int, model_pos int, scenario string, acc double")
    # all similarities are 0: the lowest train position wins
    assert estimate.knn(test, train, truth).first().acc_hat == 0.7


# ------------------------------------------------------------------ metrics
def test_spearman_constant_input_is_nan(spark):
    est = spark.createDataFrame([("s", m, "x", "e", 10, 0, "a", 0.5) for m in range(5)],
                                "split_id string, model_id int, sampling string, estimator string, "
                                "n_items int, iter int, scenario string, acc_hat double")
    truth = spark.createDataFrame([("s", m, "a", m / 10) for m in range(5)],
                                  "split_id string, model_id int, scenario string, acc double")
    r = metrics.spearman(est, truth).first().rank_corr
    assert math.isnan(r)


def test_spearman_perfect_and_ties(spark):
    est = spark.createDataFrame([("s", m, "x", "e", 10, 0, "a", float(m // 2)) for m in range(6)],
                                "split_id string, model_id int, sampling string, estimator string, "
                                "n_items int, iter int, scenario string, acc_hat double")
    truth = spark.createDataFrame([("s", m, "a", float(m)) for m in range(6)],
                                  "split_id string, model_id int, scenario string, acc double")
    r = metrics.spearman(est, truth).first().rank_corr
    x = np.array([0.5, 0.5, 2.5, 2.5, 4.5, 4.5]); y = np.arange(6.0)
    assert math.isclose(r, np.corrcoef(x, y)[0, 1], rel_tol=1e-9)


# ------------------------------------------------------------------ tables
def test_table_diff_counts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 4.0)], "k int, v double")
    r = tables.table_diff(a, b, ["k"]).first()
    assert (r.only_a, r.only_b, r.n_diff, r.examples) == (1, 1, 1, ["2"])


def test_best_per_group_skips_nan(spark):
    long = spark.createDataFrame(
        [("s", 10, "high-disagreement", "e", float("nan")), ("s", 10, "high-disagreement@5", "e", 0.2),
         ("s", 10, "random", "e", 0.3)],
        "split_id string, n_items int, sampling string, estimator string, value double")
    out = {r.row_label: r.value for r in tables.best_per_group(long).collect()}
    assert out == {"highest": 0.2, "random": 0.3}


# ------------------------------------------------------------------ ETL
def test_parse_and_pad(spark):
    raw = spark.createDataFrame([(0, 1, [1.0, 0.0], ["[0.5, -1.25]", "[2.0, 3.0, 4.0]"])],
                                "model_id int, sub int, correctness array<double>, predictions array<string>")
    long = etl.pad_answers(etl.to_long(etl.parse_predictions(raw)), "logits", 4).orderBy("item_no").collect()
    assert long[0].logits == [0.5, -1.25, float("-inf"), float("-inf")]
    assert long[1].n_answers == 3
    assert etl.width_violations(etl.to_long(etl.parse_predictions(raw)), "logits", 2).count() == 1


def test_merge_prefers_primary(spark):
    a = spark.createDataFrame([(1, 0, [1.0])], "model_id int, sub int, correctness array<double>")
    b = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [0.5])], "model_id int, sub int, correctness array<double>")
    m = {r.model_id: (r.snapshot, r.correctness) for r in etl.merge_snapshots(a, b).collect()}
    assert m == {1: ("A", [1.0]), 2: ("B", [0.5])}


def test_threshold_search_equals_direct_form(spark):
    rng = np.random.default_rng(5)
    step = (0.99 - 0.01) / 999
    grid = np.array([0.01 + k * step for k in range(999)] + [0.99])
    rows = []
    for m in range(7):
        vals = list(rng.uniform(0, 1, size=25)) + [float(grid[rng.integers(0, 1000)]) for _ in range(5)]
        rows += [("s", "a", m, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "split_id string, scenario string, model_id int, score double")
    got = stats.threshold_search(df).first()
    sc = np.array([[r[3] for r in rows if r[2] == m] for m in range(7)])
    err = np.array([np.mean(np.abs((sc > c).mean(1) - sc.mean(1))) for c in grid])
    want = int(np.argmin(np.round(err, 12)))
    assert got.k == want and math.isclose(got.threshold, grid[want], rel_tol=1e-15)


def test_global_row_number_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("k"),
                                       (F.col("id") % 3).alias("g")).repartition(13)
        out = items_ops.global_row_number(df, ["g", "k"], "pos").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    out = out.sort_values(["g", "k"]).reset_index(drop=True)
    assert out.pos.tolist() == list(range(20000))
