"""Accuracy estimators (A1-A7, A12, A14, A15) and response signatures (B1, B2).

``estimates(split_id, model_id, sampling, estimator, n_items, iter, scenario, acc_hat)``.
Constant estimators carry sampling '-' (A14) and are repeated over the
(n_items, iter) cells, as the reference fills them per cell.

Selections are small (sum of n_items x iterations x samplings rows) and are
broadcast against the test responses; everything else is keyed joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.functions import broadcast_scalar, item_curve, r12, sum_array, with_softmax
from itemscope.session import written_table

CELL = ["sampling", "n_items", "iter"]
CONSTANT_ESTIMATORS = ("mean_train_score", "perfect_knn")


def _split_keys(a: DataFrame, b: DataFrame) -> list:
    return ["split_id"] if ("split_id" in a.columns and "split_id" in b.columns) else []


def _sel(selections: DataFrame) -> DataFrame:
    # bounded by sum(n_items) x iterations x samplings x splits: broadcast
    return F.broadcast(selections)


def naive(test_scores: DataFrame, selections: DataFrame) -> DataFrame:
    """A1: sum of weight x score over the seen items of each scenario."""
    sk = _split_keys(test_scores, selections)
    sel = _sel(selections.select(*sk, *CELL, "scenario", "item_id", "weight"))
    j = test_scores.select(*sk, "model_id", "item_id", "score").join(sel, [*sk, "item_id"])
    return (j.groupBy(*sk, "model_id", *CELL, "scenario")
             .agg(F.sum(F.col("weight") * F.col("score")).alias("acc_hat"))
             .withColumn("estimator", F.lit("naive")))


def _cells(selections: DataFrame) -> DataFrame:
    keys = ["split_id"] if "split_id" in selections.columns else []
    return selections.select(*keys, "n_items", "iter").distinct()


def mean_train_score_est(train_scores: DataFrame, test_truth: DataFrame) -> DataFrame:
    """A2: the unweighted grand mean of the split's train scores, for every
    (test model, scenario) row of the truth table."""
    mts = train_scores.groupBy("split_id").agg(F.avg("score").alias("acc_hat"))
    return test_truth.select("split_id", "model_id", "scenario").join(F.broadcast(mts), "split_id")


def perfect_knn(test_truth: DataFrame, train_truth: DataFrame) -> DataFrame:
    """A3: the train model accuracy closest to the test truth (first minimum by model_pos).

    truth tables: (split_id, model_id, model_pos, scenario, acc).  Test and train accuracies are
    sorted together once; every test row takes the last train value before it and the next one
    after it.  The sort is range-partitioned, so a scenario is not one task; what a partition
    lacks comes from a table of its neighbours' first and last train values (one row a partition
    and scenario).  Train models of equal accuracy count as the first of them."""
    group = ["split_id", "scenario"]
    value = r12(F.col("acc"))
    train = train_truth.withColumn("v", value).groupBy(*group, "v").agg(
        F.min(F.struct(F.col("model_pos").alias("pos"), "acc")).alias("t"))
    both = train.select(*group, "v", F.lit(0).alias("is_test"), F.lit(None).cast(test_truth.schema["model_id"].dataType).alias("model_id"),
                        F.lit(None).cast("double").alias("acc"), "t").unionByName(
        test_truth.select(*group, value.alias("v"), F.lit(1).alias("is_test"), "model_id", "acc",
                          F.lit(None).cast(train.schema["t"].dataType).alias("t")))
    order = [*group, "v", "is_test", "model_id"]
    line = written_table(both.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    here = Window.partitionBy("part", *group).orderBy("at")
    up = here.rowsBetween(Window.unboundedPreceding, 0)
    down = here.rowsBetween(0, Window.unboundedFollowing)
    near = line.select("*", F.last("t", ignorenulls=True).over(up).alias("below"),
                       F.first("t", ignorenulls=True).over(down).alias("above")).where("is_test = 1")
    ends = line.where("is_test = 0").groupBy(*group, "part").agg(
        F.min_by("t", "at").alias("first"), F.max_by("t", "at").alias("last"))
    parts = line.select(*group, "part").distinct().join(ends, [*group, "part"], "left")
    around = Window.partitionBy(*group).orderBy("part")
    edges = parts.select(*group, "part",
                         F.last("last", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                         F.first("first", ignorenulls=True).over(around.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    # one row a partition of the sort and group
    j = near.join(F.broadcast(edges), [*group, "part"])
    below, above = F.coalesce("below", "before"), F.coalesce("above", "after")

    def choice(t):
        return F.when(t.isNotNull(), F.struct(r12(F.abs(t["acc"] - F.col("acc"))).alias("d"), t["pos"].alias("pos"), t["acc"].alias("a")))
    return j.select(*group, "model_id", F.least(choice(below), choice(above)).alias("c")).where("c is not null").select(
        "split_id", "model_id", "scenario", F.col("c.a").alias("acc_hat"))


def expand_constant(per_model: DataFrame, selections: DataFrame, name: str) -> DataFrame:
    """Repeat a per (split, model, scenario) constant over the (n_items, iter) cells."""
    cells = F.broadcast(selections.select("split_id", "n_items", "iter").distinct())
    return per_model.join(cells, "split_id").select(
        "split_id", "model_id", F.lit("-").alias("sampling"), "n_items", "iter", "scenario",
        "acc_hat", F.lit(name).alias("estimator"))


def signatures(probs: DataFrame, selections: DataFrame, softmax: bool = False,
               col: str = "probs") -> DataFrame:
    """B1/B2: per (split, cell, model) the answers on the anchor items,
    concatenated in anchor (position) order.  A group holds n_items arrays."""
    sk = _split_keys(probs, selections)
    sel = _sel(selections.select(*sk, *CELL, "item_id", "item_pos").distinct())
    base = probs.select(*sk, "model_id", "item_id", col).join(sel, [*sk, "item_id"])
    j = with_softmax(base, col, "v") if softmax else base.withColumnRenamed(col, "v")
    g = j.groupBy(*sk, *CELL, "model_id").agg(
        F.array_sort(F.collect_list(F.struct("item_pos", "v"))).alias("_parts"))
    return g.select(*sk, *CELL, "model_id",
                    F.flatten(F.transform("_parts", lambda s: s["v"])).alias("features"))


#: Numbers in a block of signatures.
BLOCK_VALUES = 1 << 20
#: Columns of a signature that are multiplied before the bound is looked at again.
STRIP = 64


def _unit_blocks(sig: DataFrame, pos: str, cell: list) -> DataFrame:
    """Signatures divided by their norm (floored at 1e-8), packed by ``pos`` into blocks of BLOCK_VALUES numbers."""
    norm = F.greatest(F.sqrt(sum_array(F.transform("features", lambda x: x * x))), F.lit(1e-8))
    unit = F.zip_with("features", broadcast_scalar(F.col("features"), norm), lambda x, n: x / n)
    rows = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.size("features"), F.lit(1))))
    return (sig.withColumn("unit", unit).withColumn("block", F.floor(F.col(pos) / rows)).groupBy(*cell, "block")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), "model_id", "unit"))).alias("r"))
            .select(*cell, "block", F.transform("r", lambda r: r["pos"]).alias("pos"),
                    F.transform("r", lambda r: r["model_id"]).alias("model_id"), F.transform("r", lambda r: r["unit"]).alias("unit")))


def nearest_rows(a: np.ndarray, b: np.ndarray, pos: np.ndarray, strip: int = STRIP) -> tuple[np.ndarray, np.ndarray, int]:
    """For every unit row of ``a``: the largest cosine (12 places) among the unit rows of ``b``, the
    lowest ``pos`` that has it, and the number of multiplied strips.

    Columns are multiplied strip by strip; what is left of two rows adds at most the product of their
    remaining norms, so a pair whose bound is below the best lower bound of its row is dropped."""
    def rest(m):
        squares = np.add.reduceat(m * m, np.arange(0, m.shape[1], strip), axis=1)
        return np.sqrt(np.maximum(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], 0.0))
    rest_a, rest_b = rest(a), rest(b)
    dot = np.zeros((len(a), len(b)))
    live, done = np.arange(len(b)), 0
    for k in range(rest_a.shape[1]):
        cols = slice(k * strip, (k + 1) * strip)
        dot[:, live] += a[:, cols] @ b[live, cols].T
        done += len(live)
        if k + 1 < rest_a.shape[1]:
            slack = rest_a[:, k + 1, None] * rest_b[None, live, k + 1]
            least = (dot[:, live] - slack).max(1)
            # a row of b goes when no row of a can still want it
            live = live[(dot[:, live] + slack >= least[:, None] - 1e-9).any(0)]
    sim = np.round(dot[:, live], 12)
    best = sim.max(1)
    first = np.where(sim == best[:, None], pos[live][None], np.iinfo(np.int64).max).min(1)
    return best, first, done


def knn(test_sig: DataFrame, train_sig: DataFrame, train_truth: DataFrame) -> DataFrame:
    """A4: top-1 cosine neighbour among train signatures; returns its true accuracy.

    Norms are taken once a signature and floored at 1e-8; ties go to the lowest train model
    position.  A block of test signatures meets each train block of its cell by the train block's
    number, so pairs of blocks are dealt out one by one and only positions and cosines leave them."""
    cell = ["split_id", *CELL]
    pos = train_truth.select("split_id", "model_id", F.col("model_pos").cast("bigint").alias("tr_pos")).distinct()
    train = written_table(_unit_blocks(train_sig.join(pos, ["split_id", "model_id"]), "tr_pos", cell))
    # positions of one split are shared by train and test; only how they are packed hangs on them
    number = Window.partitionBy(*cell).orderBy("model_id")
    test = _unit_blocks(test_sig.withColumn("te_pos", F.row_number().over(number).cast("bigint") - 1), "te_pos", cell)
    numbers = train.groupBy(*cell).agg(F.collect_set("block").alias("blocks"))   # one row a cell
    pairs = test.join(numbers, cell).select(*cell, F.col("model_id").alias("te_model"), F.col("unit").alias("te_unit"),
                                            F.explode("blocks").alias("block"))
    both = pairs.join(train.select(*cell, "block", F.col("pos").alias("tr_pos"), F.col("unit").alias("tr_unit")), [*cell, "block"])
    model = test_sig.schema["model_id"].dataType.simpleString()
    types = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = (np.array([v for v in m.tolist()], float) for m in (r.te_unit, r.tr_unit))
                best, first, _ = nearest_rows(a, b, np.asarray(r.tr_pos, np.int64))
                out += [(*[getattr(r, k) for k in cell], m, s, p) for m, s, p in zip(r.te_model, best.tolist(), first.tolist())]
            yield pd.DataFrame(out, columns=[*cell, "model_id", "sim", "tr_pos"])
    schema = ", ".join([*(f"{k} {types[k]}" for k in cell), f"model_id {model}", "sim double", "tr_pos bigint"])
    found = both.select(*cell, "te_model", "te_unit", "tr_pos", "tr_unit").mapInPandas(run, schema)
    best = found.groupBy(*cell, "model_id").agg(F.max(F.struct("sim", (-F.col("tr_pos")).alias("neg")))["neg"].alias("neg"))
    best = best.select(*cell, "model_id", (-F.col("neg")).alias("tr_pos"))
    truth = train_truth.select("split_id", F.col("model_pos").cast("bigint").alias("tr_pos"), "scenario", F.col("acc").alias("acc_hat"))
    return best.join(truth, ["split_id", "tr_pos"]).select(*cell, "model_id", "scenario", "acc_hat").withColumn("estimator", F.lit("KNN"))


def pirt(test_scores: DataFrame, selections: DataFrame, items: DataFrame,
         item_params: DataFrame, abilities: DataFrame, thresh: float | None = None) -> DataFrame:
    """A5 (thresh=None) / A6 (thresh=0.5):
    lambda * mean(bal_w * score on seen) + (1 - lambda) * mean(bal_w * P on unseen),
    lambda = seen share of the scenario.

    The unseen mean is (scenario total - seen part) / (N - n_seen): no
    cells x items complement is built.  abilities(split_id, model_id, CELL..., theta)."""
    sk = ["split_id"]
    pk = ["split_id"] if "split_id" in item_params.columns else []   # parameters fitted per split
    it = items.select("item_id", "scenario", "bal_w").join(item_params.select(*pk, "item_id", "a", "b"), "item_id")
    n_scen = items.groupBy("scenario").agg(F.count(F.lit(1)).alias("N"))
    p = item_curve("theta", "a", "b")
    if thresh is not None:
        p = (p >= F.lit(thresh)).cast("double")
    # abilities are per (model, cell); give them the scenarios of their cell and
    # meet the items of each scenario (bounded side: test models x cells x scenarios)
    cell_scen = selections.select(*sk, *CELL, "scenario").distinct()
    ab = abilities.select(*sk, "model_id", *CELL, "theta")
    ab_scen = ab.join(F.broadcast(cell_scen), [*sk, *CELL])
    tot = it.join(F.broadcast(ab_scen), [*pk, "scenario"])
    tot = tot.groupBy(*sk, "model_id", *CELL, "scenario").agg(
        F.sum(F.col("bal_w") * p).alias("p_all"))
    sel = _sel(selections.select(*sk, *CELL, "scenario", "item_id"))
    seen = (test_scores.select(*sk, "model_id", "item_id", "score").join(sel, [*sk, "item_id"])
            .join(it, [*pk, "item_id", "scenario"])
            .join(ab, [*sk, "model_id", *CELL]))
    seen = seen.groupBy(*sk, "model_id", *CELL, "scenario").agg(
        F.count(F.lit(1)).alias("n_seen"),
        F.avg(F.col("bal_w") * F.col("score")).alias("data_part"),
        F.sum(F.col("bal_w") * p).alias("p_seen"))
    j = seen.join(tot, [*sk, "model_id", *CELL, "scenario"]).join(F.broadcast(n_scen), "scenario")
    lam = F.col("n_seen") / F.col("N")
    unseen_mean = F.when(F.col("N") > F.col("n_seen"),
                         (F.col("p_all") - F.col("p_seen")) / (F.col("N") - F.col("n_seen"))) \
        .otherwise(F.lit(0.0))
    return j.select(*sk, "model_id", *CELL, "scenario",
                    (lam * F.col("data_part") + (1 - lam) * unseen_mean).alias("acc_hat"),
                    F.lit("pirt" if thresh is None else "cirt").alias("estimator"))


def gpirt(naive_est: DataFrame, pirt_est: DataFrame, lambdas: DataFrame) -> DataFrame:
    """Lambda * naive + (1 - lambda) * pirt, lambda per (scenario, n_items, kind)."""
    k = ["split_id", "model_id", *CELL, "scenario"]
    a = naive_est.select(*k, F.col("acc_hat").alias("nv"))
    b = pirt_est.select(*k, F.col("acc_hat").alias("pi"))
    kind = F.when(F.col("sampling") == "random", "random").otherwise("other")
    j = a.join(b, k).withColumn("kind", kind)
    lam = F.broadcast(lambdas.select("split_id", "scenario", "n_items", "kind", "lambda"))
    j = j.join(lam, ["split_id", "scenario", "n_items", "kind"])
    return j.select(*k, (F.col("lambda") * F.col("nv") + (1 - F.col("lambda")) * F.col("pi"))
                    .alias("acc_hat"), F.lit("gpirt").alias("estimator"))


def method_name(sampling, estimator):
    """A14: '<sampling>_<estimator>'; constants have no sampling prefix."""
    return F.when(F.col(estimator).isin(*CONSTANT_ESTIMATORS), F.col(estimator)) \
            .otherwise(F.concat_ws("_", F.col(sampling), F.col(estimator)))


def dedupe_cells(selections: DataFrame) -> DataFrame:
    """One representative cell per identical selected item set.

    -> (split_id?, sampling, n_items, iter, rep_iter): cells whose selected
    sets hash equal share the fit of the first iteration."""
    sk = ["split_id"] if "split_id" in selections.columns else []
    h = selections.groupBy(*sk, *CELL).agg(
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.col("item_id").cast("string")))), 256)
        .alias("set_hash"))
    w = Window.partitionBy(*sk, "sampling", "n_items", "set_hash")
    return h.withColumn("rep_iter", F.min("iter").over(w))


def estimator_union(*parts: DataFrame) -> DataFrame:
    """Union of estimator outputs into the estimates table."""
    cols = ["split_id", "model_id", "sampling", "estimator", "n_items", "iter", "scenario", "acc_hat"]
    out = None
    for p in parts:
        p = p.select(*cols)
        out = p if out is None else out.unionByName(p)
    return out
