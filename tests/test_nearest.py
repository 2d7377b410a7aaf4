"""KNN by blocks, nearest accuracy by a sorted merge, disagreement of many model sets in one scan."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemscope.operators import estimate, stats


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


def test_nearest_rows_drops_pairs_and_keeps_the_answer():
    r = np.random.default_rng(5)
    a, b = r.normal(size=(20, 512)), r.normal(size=(90, 512))
    a[:, 0] += 60 * np.repeat([1, -1], 10)      # most of a row's weight stands first
    b[:, 0] += 60 * np.where(np.arange(90) % 3 > 0, 1, -1)
    b[7] = b[3]                                 # equal rows: the lower position
    a[0] = b[3] * 2
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
    pos = r.permutation(90)
    best, first, done = estimate.nearest_rows(a[:10], b, pos, strip=16)
    sim = np.round(a[:10] @ b.T, 12)
    assert np.allclose(best, sim.max(1), atol=2e-12)
    assert first[0] == min(pos[3], pos[7])
    assert all(sim[i, list(pos).index(first[i])] >= sim[i].max() - 2e-12 for i in range(10))
    assert done < 90 * 32                       # 32 strips for all pairs without the bound


def signatures(spark, rows):
    return spark.createDataFrame([("s", "x", 5, i, m, f) for i, m, f in rows],
                                 "split_id string, sampling string, n_items int, iter int, model_id int, features array<double>")


def test_knn_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(estimate, "BLOCK_VALUES", 12)     # blocks of three signatures
    r = random.Random(2)
    sig = {(i, m): [r.choice([0.0, 1.0, 2.0]) for _ in range(4)] for i in (0, 1) for m in range(17)}
    sig[0, 3] = [0.0] * 4
    train = signatures(spark, [(i, m, f) for (i, m), f in sig.items() if m < 12])
    test = signatures(spark, [(i, m, f) for (i, m), f in sig.items() if m >= 12])
    truth = spark.createDataFrame([("s", m, 20 - m, sc, m / 100 + k) for m in range(12) for k, sc in enumerate("ab")],
                                  "split_id string, model_id int, model_pos long, scenario string, acc double")
    got = {(x.iter, x.model_id, x.scenario): x.acc_hat for x in estimate.knn(test, train, truth).collect()}
    for i in (0, 1):
        for m in range(12, 17):
            a = np.array(sig[i, m])
            best = max(range(12), key=lambda t: (round(float(a @ np.array(sig[i, t])) / max(np.linalg.norm(a), 1e-8)
                                                       / max(np.linalg.norm(sig[i, t]), 1e-8), 10), t))
            assert got[i, m, "a"] == best / 100 and got[i, m, "b"] == best / 100 + 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_nearest_accuracy_equals_brute_force(spark, partitions):
    r = random.Random(partitions)
    grid = [x / 20 for x in range(21)]
    train = [("p", m, m, s, r.choice(grid)) for m in range(40) for s in ("hot", "cold") if s == "hot" or m < 3]
    test = [("p", 100 + m, 100 + m, s, r.choice(grid) + r.choice([0, 0.025])) for m in range(60) for s in ("hot", "cold")]
    test += [("p", 500, 500, "none", 0.5)]
    schema = "split_id string, model_id int, model_pos int, scenario string, acc double"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {(x.model_id, x.scenario): x.acc_hat for x in estimate.perfect_knn(
            spark.createDataFrame(test, schema), spark.createDataFrame(train, schema)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for _, m, _, s, acc in test:
        near = [(round(abs(a - acc), 12), p, a) for _, _, p, x, a in train if x == s]
        if near:
            want[m, s] = min(near)[2]
    assert got == want


def test_scores_of_many_sets_equal_one_set_at_a_time(spark):
    r = random.Random(1)
    rows = []
    for m in range(9):
        for i in range(15):
            v = [r.random() for _ in range(2 + i % 3)]
            rows.append((m, i, [x / sum(v) for x in v]))
    probs = spark.createDataFrame(rows, "model_id int, item_id long, probs array<double>")
    sets = {("a", "all"): range(9), ("a", "@2"): (1, 5), ("b", "all"): (0, 2, 4, 8), ("b", "@1"): (3,), ("c", "none"): (77,)}
    members = spark.createDataFrame([(*k, m) for k, v in sets.items() for m in v], "split_id string, variant string, model_id int")
    for kind in ("pds", "jsd"):
        got = {(x.split_id, x.variant, x.item_id): x.score for x in stats.variant_scores(probs, members, kind).collect()}
        for (split, variant), models in sets.items():
            one = stats.disagreement(probs.where(F.col("model_id").isin(list(models))), kind)
            want = {(split, variant, x.item_id): x.score for x in one.collect()}
            assert {k: v for k, v in got.items() if k[:2] == (split, variant)} == pytest.approx(want, abs=1e-12)


def test_more_sets_than_one_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(stats, "COLUMNS_PER_PASS", 8)
    probs = spark.createDataFrame([(m, 0, [m / 10, 1 - m / 10]) for m in range(6)], "model_id int, item_id long, probs array<double>")
    members = spark.createDataFrame([(f"@{m}", m) for m in range(6)], "variant string, model_id int")
    got = {x.variant: round(x.score, 9) for x in stats.variant_scores(probs, members).collect()}
    assert got == {f"@{m}": 1.0 for m in range(6)}


def test_disagreement_reads_once_and_shuffles_once(spark):
    probs = spark.createDataFrame([(m, i, [0.5, 0.5]) for m in range(4) for i in range(5)], "model_id int, item_id long, probs array<double>")
    members = spark.createDataFrame([(s, v, m) for s in "ab" for v in ("all", "@2") for m in range(3)],
                                    "split_id string, variant string, model_id int")
    tree = plan_of(stats.variant_scores(probs, members, width=2)).split("\n\n")[0]
    assert tree.count("hashpartitioning") + tree.count("Exchange") - tree.count("BroadcastExchange") <= 4
    assert "Generate" in tree and tree.index("Generate") < tree.index("HashAggregate")  # only the finished scores are exploded
