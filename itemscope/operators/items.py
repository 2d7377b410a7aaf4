"""Item dimension: positions (E14), balance weights (E16), sub filters (E3, E13),
scenario lookup (L15), stacking an attribute by position (E15).

The item table has one row per item (never per response).  Positions are
numbered without any single-task window: a range-partitioned sort spreads
even a sub holding a third of the items over many tasks, and per-partition
counts give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.session import cut_lineage


def global_row_number(df: DataFrame, order_cols: list, out: str) -> DataFrame:
    """0-based position in a total order, computed without a single-task window.

    ``orderBy`` range-partitions on sampled bounds, so a key holding a third of
    the rows is spread over many tasks; each task numbers its sorted slice
    (``monotonically_increasing_id`` low bits), and a tiny per-partition count
    table supplies the offsets.  ``order_cols`` must be a total order."""
    s = df.orderBy(*order_cols).select(
        "*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    s = cut_lineage(s)     # both uses below must see the same partitioning
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return s.join(F.broadcast(offsets), "_pid").withColumn(
        out, (F.col("_off") + local).cast("bigint")).drop("_pid", "_mid", "_off")


def item_positions(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """items(item_id, scenario, sub) + catalog(scenario, sub, scenario_ord, sub_ord)
    -> items with scenario_ord, sub_ord, item_pos (0-based, ordered by
    scenario_ord, sub_ord, item_id).  Items whose sub is not in the catalog
    are dropped (E13 semantics).  The offsets table has one row per output
    partition of the sort (bounded), so it is broadcast."""
    cat = catalog.select("scenario", "sub", "scenario_ord", "sub_ord")
    it = items.join(F.broadcast(cat), ["scenario", "sub"], "inner")
    return global_row_number(it, ["scenario_ord", "sub_ord", "item_id"], "item_pos")


def balance_weights(items: DataFrame) -> DataFrame:
    """Adds n_scenario (N), n_sub, n_i and bal_w = N / (n_sub * n_i)."""
    # one row per sub: bounded by the catalogue, safe to broadcast
    w_s = Window.partitionBy("scenario")
    per_sub = items.groupBy("scenario", "sub").agg(F.count(F.lit(1)).alias("n_i"))
    per_sub = per_sub.select(
        "scenario", "sub", "n_i",
        F.sum("n_i").over(w_s).alias("n_scenario"),
        F.count(F.lit(1)).over(w_s).alias("n_sub"))
    return (items.join(F.broadcast(per_sub), ["scenario", "sub"])
                 .withColumn("bal_w", F.col("n_scenario") / (F.col("n_sub") * F.col("n_i"))))


def build_items(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """E13 + E14 + E16: the item dimension every later operator joins to."""
    return balance_weights(item_positions(items, catalog))


def skip_subs(df: DataFrame, subs: list) -> DataFrame:
    """Drop listed sub-benchmarks."""
    if not subs:
        return df
    return df.filter(~F.col("sub").isin(list(subs)))


def keep_catalog_subs(catalog: DataFrame, data_subs: DataFrame) -> DataFrame:
    """Keep catalogue subs present in the data; scenarios left empty vanish."""
    return catalog.join(data_subs.select("scenario", "sub").distinct(), ["scenario", "sub"], "left_semi")


def scenario_of(df: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Attach the scenario of each item (NULL when not in any scenario)."""
    return df.join(items.select(key, "scenario"), key, "left")


def stack_attribute(values: DataFrame, items: DataFrame, value_col: str) -> DataFrame:
    """One long table (model_id, item_pos, scenario, value) over all chosen subs."""
    return values.join(items.select("item_id", "item_pos", "scenario", "sub", "bal_w"),
                       "item_id").select("model_id", "item_id", "item_pos", "scenario", "sub",
                                         "bal_w", value_col)
