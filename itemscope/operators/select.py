"""Item selection.

Selections are one table ``selections(sampling, n_items, iter, scenario,
item_id, item_pos, weight)``; every n_items of the grid is a filter on one
ranking, and "unseen" items are an anti join, never stored.

Top-k windows first filter on a literal bound (the largest n of the grid),
which Spark plans as a WindowGroupLimit: each task keeps only its local
top-k before the shuffle, so a stratum holding a third of the items is cut
down map-side.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.functions import md5_key, r12
from itemscope.session import drop_table, written_table


def _grid_col(n_items_grid) -> F.Column:
    grid = [int(n) for n in dict.fromkeys(n_items_grid)]   # Q14: repeated sizes collapse
    return F.explode(F.array(*[F.lit(n) for n in grid]))


def quotas(items: DataFrame, n_items_grid, order_col: str = "sub_ord") -> DataFrame:
    """L1: per scenario and n: n // n_sub items per sub, +1 for the first
    n mod n_sub subs in catalogue order.  -> (scenario, sub, n_items, sub_rank, quota)."""
    subs = items.select("scenario", "sub", order_col).distinct()
    w = Window.partitionBy("scenario").orderBy(order_col, "sub")
    subs = subs.select("scenario", "sub", F.row_number().over(w).alias("sub_rank"),
                       F.count(F.lit(1)).over(Window.partitionBy("scenario")).alias("n_sub"))
    df = subs.select("*", _grid_col(n_items_grid).alias("n_items"))
    q = (F.floor(F.col("n_items") / F.col("n_sub"))
         + (F.col("sub_rank") <= F.col("n_items") % F.col("n_sub")).cast("int")).cast("int")
    return df.select("scenario", "sub", "n_items", "sub_rank", q.alias("quota"))


def _finish(ranked: DataFrame, keys: list) -> DataFrame:
    """Uniform weight 1/(seen items of the scenario) per selection cell."""
    w = Window.partitionBy(*keys, "sampling", "n_items", "iter", "scenario")
    return ranked.select(
        *keys, "sampling", "n_items", "iter", "scenario", "item_id", "item_pos",
    ).withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(w))


def select_disagreement(scores: DataFrame, items: DataFrame, n_items_grid,
                        high: bool = True, stratified: bool = True,
                        variant_col: str | None = "variant", iters: int = 1) -> DataFrame:
    """Top (high) or bottom (low) disagreement items.

    scores(variant?, item_id, score); items(item_id, scenario, sub, sub_ord, item_pos).
    Ties: high keeps the lower position first; low keeps the higher position
    first (the tail of a stable descending sort).  Deterministic, so every
    iteration repeats iteration 0."""
    grid = [int(n) for n in dict.fromkeys(n_items_grid)]
    bound = max(grid)
    vk = [c for c in ("split_id", variant_col) if c and c in scores.columns]
    df = scores.join(items.select("item_id", "scenario", "sub", "item_pos"), "item_id")
    s = r12(F.col("score"))
    order = [s.desc(), F.col("item_pos").asc()] if high else [s.asc(), F.col("item_pos").desc()]
    if stratified:
        w = Window.partitionBy(*vk, "scenario", "sub").orderBy(*order)
        ranked = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= bound)
        q = quotas(items, grid)
        ranked = ranked.join(F.broadcast(q.select("scenario", "sub", "n_items", "quota")),
                             ["scenario", "sub"])
        ranked = ranked.filter(F.col("rank") <= F.col("quota"))
    else:
        w = Window.partitionBy(*vk).orderBy(*order)
        ranked = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= bound)
        ranked = ranked.select("*", _grid_col(grid).alias("n_items")).filter(
            F.col("rank") <= F.col("n_items"))
    ranked = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("iter"))
    name = ("high" if high else "low") + "-disagreement"
    suffix = "" if stratified else "+nonstratified"
    if variant_col and variant_col in scores.columns:
        sampling = F.concat(F.lit(name), F.when(F.col(variant_col) == "all", F.lit(""))
                            .otherwise(F.col(variant_col)), F.lit(suffix))
    else:
        sampling = F.lit(name + suffix)
    keep = ["split_id"] if "split_id" in scores.columns else []
    return _finish(ranked.withColumn("sampling", sampling), keep)


def select_random(items: DataFrame, n_items_grid, iters: int = 1,
                  split_ids: list | None = None, seed: int = 0) -> DataFrame:
    """L2: stratified random sample, repeatable per iteration seed.

    Subs are shuffled by md5(iter, scenario, sub); the first n mod n_sub of
    the shuffled subs get one extra item; items inside a sub are drawn in
    md5(iter, item_id) order, without replacement.  ``seed`` offsets the
    iteration seeds (a second, independent copy of the same grid)."""
    grid = [int(n) for n in dict.fromkeys(n_items_grid)]
    its = F.explode(F.sequence(F.lit(0), F.lit(iters - 1)))
    subs = items.select("scenario", "sub").distinct().select("*", its.alias("iter"))
    w_sub = Window.partitionBy("iter", "scenario").orderBy(
        md5_key(F.col("iter") + seed, F.lit("sub"), F.col("scenario"), F.col("sub")), F.col("sub"))
    subs = subs.select("*", F.row_number().over(w_sub).alias("sub_rank"),
                       F.count(F.lit(1)).over(Window.partitionBy("iter", "scenario")).alias("n_sub"))
    subs = subs.select("*", _grid_col(grid).alias("n_items"))
    quota = (F.floor(F.col("n_items") / F.col("n_sub"))
             + (F.col("sub_rank") <= F.col("n_items") % F.col("n_sub")).cast("int")).cast("int")
    subs = subs.select("iter", "scenario", "sub", "n_items", quota.alias("quota"))
    it = items.select("item_id", "scenario", "sub", "item_pos").select("*", its.alias("iter"))
    w_it = Window.partitionBy("iter", "scenario", "sub").orderBy(
        md5_key(F.col("iter") + seed, F.col("item_id")), F.col("item_id"))
    ranked = it.withColumn("rank", F.row_number().over(w_it)).filter(F.col("rank") <= max(grid))
    ranked = ranked.join(F.broadcast(subs), ["iter", "scenario", "sub"]).filter(
        F.col("rank") <= F.col("quota")).withColumn("sampling", F.lit("random"))
    keys = []
    if split_ids:
        ranked = ranked.select("*", F.explode(F.array(*[F.lit(s) for s in split_ids])).alias("split_id"))
        keys = ["split_id"]
    return _finish(ranked, keys)


def unseen_items(items: DataFrame, selections: DataFrame) -> DataFrame:
    """Per selection cell and scenario, the scenario's items not selected.

    Cells meet items through an equi-join on scenario (cells are few: one row
    per sampling x n x iter x scenario); the complement is a keyed anti join.
    Estimators never need this table: sums over unseen items are computed as
    scenario total minus seen part."""
    sk = ["split_id"] if "split_id" in selections.columns else []
    cell = [*sk, "sampling", "n_items", "iter"]
    cells = F.broadcast(selections.select(*cell, "scenario").distinct())
    per_cell = items.select("item_id", "scenario", "item_pos").join(cells, "scenario")
    sel = selections.select(*cell, "item_id")
    return per_cell.join(sel, [*cell, "item_id"], "left_anti")


def _widest(params: DataFrame) -> list[int]:
    """The (at most) two dimensions of ``vec`` with the largest range; one row a dimension reaches the driver."""
    spans = params.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg((F.max("x") - F.min("x")).alias("span"))
    return [r.d for r in spans.orderBy(F.col("span").desc(), "d").limit(2).collect()]


def nearest_anchors(items: DataFrame, anchors: DataFrame, params: DataFrame, cell: list) -> DataFrame:
    """The nearest anchor of every item in every cell: (cell..., scenario, item_id, anchor_id, dist).

    items(scenario, item_id, vec); anchors(cell..., scenario, anchor_id, anchor_pos, avec).  Euclidean distance
    (12 places), lowest ``anchor_pos`` on ties, parameters finite.

    The two widest dimensions are cut into squares, about one an anchor.  An anchor is entered in its own square
    and the eight around it, an item looks into its own only.  What is not entered there lies further away than a
    square is wide, so a nearest one within that width is final.  The other items go on with squares four times as
    wide, until a square spans the whole scenario and so holds every anchor.  Items meet the anchors near them;
    no item meets all anchors unless it lies as far from them as they are spread."""
    dims = _widest(params)
    key = [*cell, "scenario"]
    if not dims:  # no parameters, no anchors
        return anchors.limit(0).select(*key, F.col("anchor_id").alias("item_id"), "anchor_id", F.lit(0.0).alias("dist"))

    def span(col):
        return [f(F.col(col)[d]).alias(f"{col}_{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    grid = anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *span("avec")).join(
        items.groupBy("scenario").agg(*span("vec")), "scenario")

    def greatest(cols):
        return F.greatest(*cols) if len(cols) > 1 else cols[0]
    spread = greatest([F.col(f"avec_hi{i}") - F.col(f"avec_lo{i}") for i in range(len(dims))])
    whole = greatest([F.greatest(F.col(f"avec_hi{i}"), F.col(f"vec_hi{i}")) - F.least(F.col(f"avec_lo{i}"), F.col(f"vec_lo{i}"))
                      for i in range(len(dims))])
    start = F.when(spread > 0, spread / F.sqrt("n")).when(whole > 0, whole).otherwise(F.lit(1.0))
    grid = written_table(grid.select(*key, start.alias("width"), whole.alias("whole")))
    place = written_table(anchors.join(grid, key))
    left = written_table(items.join(grid, "scenario"))
    shifts = F.array(*[F.array(*[F.lit(v) for v in near]) for near in itertools.product((-1, 0, 1), repeat=len(dims))])
    found, step = None, 1.0
    while not left.isEmpty():
        width = F.col("width") * F.lit(step)
        squares = [f"g{i}" for i in range(len(dims))]
        entered = place.select(*key, "anchor_id", "anchor_pos", "avec", "width", F.explode(shifts).alias("near")).select(
            *key, "anchor_id", "anchor_pos", "avec",
            *[(F.floor(F.col("avec")[d] / width) + F.col("near")[i]).alias(f"g{i}") for i, d in enumerate(dims)])
        looked = left.select("*", *[F.floor(F.col("vec")[d] / width).alias(f"g{i}") for i, d in enumerate(dims)])
        d2 = F.aggregate(F.zip_with("vec", "avec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
        met = looked.join(entered, [*key, *squares]).select(
            *key, "item_id", F.struct(r12(F.sqrt(d2)).alias("dist"), "anchor_pos", "anchor_id").alias("c"), width.alias("w"),
            (F.col("whole") <= width).alias("all"))
        best = met.groupBy(*key, "item_id").agg(F.min("c").alias("c"), F.first("w").alias("w"), F.first("all").alias("all"))
        done = written_table(best.where(F.col("all") | (F.col("c.dist") < F.col("w") * (1 - 1e-9))).select(
            *key, "item_id", "c.anchor_id", "c.dist"))
        found = done if found is None else found.unionByName(done)
        before, left = left, written_table(left.join(done.select(*key, "item_id"), [*key, "item_id"], "left_anti"))
        drop_table(before)
        step *= 4.0
    if found is None:
        found = place.limit(0).select(*key, F.col("anchor_id").alias("item_id"), "anchor_id", F.lit(0.0).alias("dist"))
    return found


def nearest_anchor_weights(params: DataFrame, selections: DataFrame, items: DataFrame) -> DataFrame:
    """Each item of a scenario goes to its nearest selected item (Euclidean
    distance in parameter space, lowest position on ties); an anchor's weight
    is the sum of the normalised balance weights of the items it attracts.

    params(item_id, vec ARRAY<DOUBLE>), one row an item.  A repeated item counts once a row."""
    it = items.select("item_id", "scenario", "bal_w").join(params, "item_id")
    # per-scenario totals: one row per scenario, aggregated then broadcast
    # (a window partitioned by scenario would put a hot scenario in one task)
    tot = items.groupBy("scenario").agg(F.sum("bal_w").alias("_tot"))
    it = it.join(F.broadcast(tot), "scenario").withColumn("nbw", F.col("bal_w") / F.col("_tot"))
    weight = it.groupBy("scenario", "item_id").agg(F.sum("nbw").alias("nbw"))
    sk = ["split_id"] if "split_id" in selections.columns else []
    cell = [*sk, "sampling", "n_items", "iter"]
    anchors = written_table(selections.select(*cell, "scenario", F.col("item_id").alias("anchor_id"),
                                              F.col("item_pos").alias("anchor_pos"))
                            .join(params.select(F.col("item_id").alias("anchor_id"), F.col("vec").alias("avec")), "anchor_id"))
    nearest = nearest_anchors(it.select("scenario", "item_id", "vec").dropDuplicates(["scenario", "item_id"]), anchors, params, cell)
    sums = nearest.join(weight, ["scenario", "item_id"]).groupBy(*cell, "scenario", "anchor_id").agg(F.sum("nbw").alias("weight"))
    # an anchor that attracts no item (a tie lost to a lower position) weighs 0
    return (anchors.select(*cell, "scenario", "anchor_id").join(sums, [*cell, "scenario", "anchor_id"], "left")
                   .fillna(0.0, ["weight"])
                   .withColumnRenamed("anchor_id", "item_id"))
