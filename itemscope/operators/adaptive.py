"""Adaptive item selection (L12-L14, L18), one-dimensional IRT.

All test models advance together: one step is (1) a Newton update of every
model's ability from its seen items, (2) for every model the unseen item of
the step's scenario that maximises det(I_seen + I_item), and (3) an append
to the ``seen`` table.  With D = 1 the information is a scalar and
det(M + w a^2) = M + w a^2, so the step ranks candidates by w a^2 =
P(1-P) a^2 at the model's ability (ties: lowest position).  The scenario of
a step cycles round-robin; snapshots at each requested size give weights
occ / count^2 per scenario (the reference's rule).  The seen table is
checkpointed every few steps to keep the plan short.

The start (L12) draws ``try_size`` md5-random subsets and keeps the one
with the largest sum over train models of the subset's information; for
D = 1 that sum separates over items, so each item's total information is
computed once and a subset's value is a sum over its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.functions import item_curve, md5_key
from itemscope.operators.irt import estimate_abilities
from itemscope.session import cut_lineage


def _info_col(theta="theta", a="a", b="b"):
    p = item_curve(theta, a, b)
    return p * (F.lit(1.0) - p) * F.element_at(a, 1) * F.element_at(a, 1)


def item_information(items: DataFrame, item_params: DataFrame, abilities: DataFrame) -> DataFrame:
    """I7 summed over models: per item sum_m P_m(1 - P_m) a^2 (D = 1).

    abilities(model_id, theta) has one row per train model (bounded): it is
    broadcast and joined on a constant key, an equi-join by construction."""
    ab = F.broadcast(abilities.select(F.lit(1).alias("_k"), "theta"))
    it = items.select("item_id", "item_pos").join(item_params.select("item_id", "a", "b"), "item_id") \
              .withColumn("_k", F.lit(1))
    return it.join(ab, "_k").groupBy("item_id", "item_pos").agg(F.sum(_info_col()).alias("info"))


def initial_items(items: DataFrame, item_params: DataFrame, train_abilities: DataFrame,
                  n_init: int, try_size: int = 2000, seed: int = 42) -> DataFrame:
    """The best of ``try_size`` random subsets of ``n_init`` items.
    -> (item_id, item_pos, draw) with ``draw`` the order inside the subset."""
    n_items = items.count()
    info = item_information(items, item_params, train_abilities)
    # each subset draws 2 n positions by hash; the first n distinct ones form it
    draws = items.sparkSession.range(try_size).select(
        F.col("id").alias("subset"),
        F.explode(F.sequence(F.lit(0), F.lit(2 * n_init - 1))).alias("draw"))
    h = F.conv(F.substring(md5_key(F.lit(seed), F.col("subset"), F.col("draw")), 1, 12), 16, 10)
    draws = draws.withColumn("item_pos", (h.cast("decimal(20,0)") % n_items).cast("bigint"))
    first = draws.groupBy("subset", "item_pos").agg(F.min("draw").alias("draw"))
    w = Window.partitionBy("subset").orderBy("draw")
    members = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_init).drop("_r")
    scored = members.join(info, "item_pos")
    value = scored.groupBy("subset").agg(F.sum("info").alias("value"), F.count(F.lit(1)).alias("n"))
    best = value.filter(F.col("n") == n_init).agg(
        F.max_by("subset", F.struct("value", (-F.col("subset")).alias("neg"))).alias("subset"))
    return members.join(best, "subset").join(info.select("item_id", "item_pos"), "item_pos") \
                  .select("item_id", "item_pos", "draw")


def adaptive_run(test_resp: DataFrame, items: DataFrame, item_params: DataFrame,
                 start: DataFrame, sizes: list, balance: bool = True,
                 newton_rounds: int = 4, checkpoint_every: int = 4) -> DataFrame:
    """L13 + L14 (+ L18: every model has its own sequence).

    test_resp(model_id, item_id, resp); start(item_id, item_pos, draw).
    -> selections (model_id, n_items, scenario, item_id, item_pos, weight)."""
    scenarios = [r.scenario for r in items.select("scenario").distinct().orderBy("scenario").collect()]
    n_scen = len(scenarios)
    targets = sorted({n_scen * int(n) for n in sizes})
    min_count, max_count = targets[0], targets[-1]
    keep = max(1, int(min_count / 3))
    st = start.orderBy("draw").limit(keep) if start.count() > keep else start
    models = test_resp.select("model_id").distinct()
    it = items.select("item_id", "item_pos", "scenario").join(item_params.select("item_id", "a", "b"),
                                                                "item_id")
    # every test model starts from the same (bounded) initial items
    seen = models.withColumn("_k", F.lit(1)).join(
        F.broadcast(st.select("item_id").withColumn("_k", F.lit(1))), "_k").drop("_k") \
        .withColumn("step", F.lit(0))
    seen = cut_lineage(seen)
    count = seen.select("item_id").distinct().count()
    snapshots = []
    step = 0
    while True:
        for scen in scenarios:
            if count in targets:
                snapshots.append((count, seen))
            if count >= max_count:
                return _snapshots_to_selections(snapshots, it, n_scen)
            step += 1
            # seen is bounded (test models x steps): broadcast it into both joins
            resp = test_resp.join(F.broadcast(seen.select("model_id", "item_id")), ["model_id", "item_id"])
            theta = estimate_abilities(resp.select("model_id", "item_id", "resp"), item_params,
                                       ["model_id"], 1, rounds=newton_rounds, checkpoint_every=10 ** 6)
            cand = _pair(it.filter(F.col("scenario") == scen) if balance else it, theta)
            cand = cand.join(F.broadcast(seen.select("model_id", "item_id")), ["model_id", "item_id"],
                             "left_anti")
            cand = cand.withColumn("gain", F.round(_info_col(), 12))
            nxt = cand.groupBy("model_id").agg(F.max_by("item_id", F.struct(
                "gain", (-F.col("item_pos")).alias("neg"))).alias("item_id"))
            seen = seen.unionByName(nxt.withColumn("step", F.lit(step)))
            if step % checkpoint_every == 0:
                seen = cut_lineage(seen.coalesce(1))
            count += 1


def _pair(cand: DataFrame, theta: DataFrame) -> DataFrame:
    """Candidates x test models: test abilities are one row per test model
    (bounded), broadcast on a constant key."""
    return cand.withColumn("_k", F.lit(1)).join(
        F.broadcast(theta.select("model_id", "theta").withColumn("_k", F.lit(1))), "_k").drop("_k")


def _snapshots_to_selections(snapshots, it: DataFrame, n_scen: int) -> DataFrame:
    out = None
    for count, seen in snapshots:
        s = seen.join(it.select("item_id", "item_pos", "scenario"), "item_id")
        occ = Window.partitionBy("model_id", "scenario")
        s = s.withColumn("weight", F.count(F.lit(1)).over(occ) / F.lit(float(count * count))) \
             .select("model_id", F.lit(count // n_scen).alias("n_items"), "scenario", "item_id",
                     "item_pos", "weight")
        out = s if out is None else out.unionByName(s)
    return out
