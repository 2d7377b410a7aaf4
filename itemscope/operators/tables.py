"""Result tables.

Everything stays in long form ``(split_id, n_items, sampling, estimator, value)``
until the last step; a wide table is one ``pivot`` over a known column list
(a single aggregation, no extra pass to find the values).  NaN becomes NULL
before any min/max (pandas skips NaN; Spark would return it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.operators.metrics import nan_to_null

CELL = ["split_id", "n_items"]

# Display names of methods (label lookup of the reference tables).
DISPLAY_NAMES = {
    "random_naive": "random",
    "anchor_naive": "correct.",
    "anchor-irt_naive": "IRT",
    "random_pirt": "random+",
    "anchor_pirt": "correct.+",
    "anchor-irt_pirt": "IRT+",
    "random_gpirt": "random++",
    "anchor_gpirt": "correct.++",
    "anchor-irt_gpirt": "IRT++",
    "anchor": "correct.",
    "anchor-irt": "IRT",
    "mean_train_score": "mean train score",
}

# Rows of the main comparison table as
# (approach, condensation type, prediction type, condensation key, prediction key).
# Approach labels are neutral names for the three families of the reference table.
MAIN_TABLE_ROWS = [
    ("Baseline", "Random", "Eval", "random", "naive"),
    ("IRT baseline", "Random", "gp-IRT", "random", "gpirt"),
    ("IRT baseline", "anchor-IRT", "gp-IRT", "anchor-irt", "gpirt"),
    ("IRT baseline", "anchor-correctness", "gp-IRT", "anchor", "gpirt"),
    ("Baseline", "Random", "kNN", "random", "KNN"),
    ("Baseline", "Random", "fit", "random", "fit"),
    ("Disagreement", "High PDS", "kNN", "highest", "KNN"),
    ("Disagreement", "High PDS", "fit", "highest", "fit"),
]

# Regressor columns the row-wise "fit" considers, and the ones
# dropped before it (only the 100-tree forest stays).
FIT_CANDIDATES = ["MLP3_e700_lr0.001", "Ridge_10", "Lasso_e-4",
                  "RandomForestRegressor_100", "GradientBoostingRegressor_200"]
FIT_DROPPED = ["MLP3_e700_lr0.001", "Ridge_10", "Lasso_e-4", "GradientBoostingRegressor_200"]


def summary_long(summary: DataFrame, value: str) -> DataFrame:
    return summary.select(*CELL, "sampling", "estimator", F.col(value).alias("value"))


# ------------------------------------------------------------------ R1-R4
def perf_pivot(long: DataFrame, predictors: list) -> DataFrame:
    """row = (split, n_items, sampling), one column per predictor."""
    return long.groupBy(*CELL, "sampling").pivot("estimator", list(predictors)).agg(F.first("value"))


def sampling_metadata(samplings: DataFrame) -> DataFrame:
    """R2: guiding-model count, highest/lowest, stratified flag from the name."""
    s = F.col("sampling")
    dis = s.contains("disagreement")
    guiding = F.when(dis, F.when(s.contains("@"), F.regexp_extract(s, "@(\\d+)", 1))
                     .otherwise(F.lit("all")))
    pds_type = F.when(dis, F.when(s.contains("high"), F.lit("highest")).otherwise(F.lit("lowest")))
    strat = F.when(dis, ~s.contains("+nonstratified"))
    return samplings.select("sampling").distinct().select(
        "sampling", guiding.alias("guiding_models"), pds_type.alias("pds_type"),
        strat.alias("stratified"))


def text_cells(summary: DataFrame, predictors: list) -> DataFrame:
    """R3: 'mean+-std' text per cell, pivoted like R1."""
    txt = F.format_string("%.6f+-%.6f", F.col("mae"), F.col("spread"))
    long = summary.select(*CELL, "sampling", "estimator", txt.alias("value"))
    return perf_pivot(long, predictors)


def display_table(pivot: DataFrame, n_train: DataFrame) -> DataFrame:
    """Metadata first; guiding 'all' -> the real train-model count of the
    split; rows ordered by (type, stratified, guiding count), nulls last.
    n_train(split_id, n_train)."""
    meta = sampling_metadata(pivot)
    j = pivot.join(meta, "sampling").join(F.broadcast(n_train), "split_id")
    count = F.when(F.col("guiding_models") == "all", F.col("n_train")) \
             .otherwise(F.col("guiding_models").cast("int"))
    j = j.withColumn("guiding_count", count.cast("int"))
    w = Window.partitionBy(*CELL).orderBy(
        F.col("pds_type").asc_nulls_last(), F.col("stratified").asc_nulls_last(),
        F.col("guiding_count").asc_nulls_last(), F.col("sampling"))
    j = j.withColumn("row_order", F.row_number().over(w))
    first = [*CELL, "row_order", "sampling", "guiding_count", "pds_type", "stratified"]
    rest = [c for c in pivot.columns if c not in first]
    return j.select(*first, *rest)


# ------------------------------------------------------------------ R5
def merge_results(base: DataFrame, other: DataFrame, keys: list) -> DataFrame:
    """Rows of ``base`` win; ``other`` adds only methods base lacks."""
    return base.unionByName(other.join(base.select(*keys).distinct(), keys, "left_anti"))


# ------------------------------------------------------------------ R6-R9
def _with_key(long: DataFrame, key: str) -> DataFrame:
    meta = sampling_metadata(long)
    return long.join(meta, "sampling").withColumn("value", nan_to_null("value")) \
               .withColumn("group", F.col(key).cast("string"))


def best_per_group(long: DataFrame, key: str = "pds_type", lower_better: bool = True) -> DataFrame:
    """Min (or max) of every predictor over the samplings of each group;
    rows without a group are kept as they are.  -> (CELL, row_label, estimator, value)."""
    j = _with_key(long, key)
    agg = F.min("value") if lower_better else F.max("value")
    grouped = j.filter(F.col("group").isNotNull()).groupBy(*CELL, "group", "estimator") \
               .agg(agg.alias("value")).withColumnRenamed("group", "row_label")
    rest = j.filter(F.col("group").isNull()).select(
        *CELL, F.col("sampling").alias("row_label"), "estimator", "value")
    return grouped.unionByName(rest)


def select_report(source: DataFrame, target: DataFrame, key: str = "pds_type",
                  lower_better: bool = True) -> DataFrame:
    """The best sampling per group and predictor is chosen on ``source``;
    the value reported is ``target``'s at that (sampling, predictor).
    Ties go to the smaller sampling name."""
    s = _with_key(source, key).filter(F.col("group").isNotNull() & F.col("value").isNotNull())
    order = F.col("value").asc() if lower_better else F.col("value").desc()
    w = Window.partitionBy(*CELL, "group", "estimator").orderBy(order, F.col("sampling"))
    pick = s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1) \
            .select(*CELL, "group", "estimator", "sampling")
    t = target.withColumn("value", nan_to_null("value"))
    picked = pick.join(t, [*CELL, "sampling", "estimator"], "left").select(
        *CELL, F.col("group").alias("row_label"), "estimator", "value")
    tj = _with_key(target, key)
    rest = tj.filter(F.col("group").isNull()).select(
        *CELL, F.col("sampling").alias("row_label"), "estimator", "value")
    return picked.unionByName(rest)


def drop_predictors(long: DataFrame, drop: list = FIT_DROPPED) -> DataFrame:
    """Drop predictor columns before the row-wise best."""
    return long.filter(~F.col("estimator").isin(list(drop))) if drop else long


def rowwise_best(source_best: DataFrame, target_best: DataFrame, candidates: list,
                 lower_better: bool = True, keep_candidates: bool = False) -> DataFrame:
    """Per row, the best candidate predictor on ``source`` (NaN/NULL counts
    as worst; the first candidate wins ties) names the column whose ``target``
    value becomes ``fit``.  Candidate columns are dropped unless kept."""
    cand = list(candidates)
    if not cand:
        return target_best
    idx = F.array_position(F.array(*[F.lit(c) for c in cand]), F.col("estimator"))
    worst = float("inf") if lower_better else float("-inf")
    v = F.coalesce(F.col("value"), F.lit(worst))
    s = source_best.filter(F.col("estimator").isin(cand)).withColumn("_v", v).withColumn("_i", idx)
    w = Window.partitionBy(*CELL, "row_label").orderBy(
        F.col("_v").asc() if lower_better else F.col("_v").desc(), F.col("_i"))
    pick = s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1) \
            .select(*CELL, "row_label", "estimator")
    fit = pick.join(target_best, [*CELL, "row_label", "estimator"], "left") \
              .select(*CELL, "row_label", F.lit("fit").alias("estimator"), "value")
    keep = target_best if keep_candidates else target_best.filter(~F.col("estimator").isin(cand))
    return keep.unionByName(fit)


# ------------------------------------------------------------------ R11-R14
def main_table(mae_best: DataFrame, rank_best: DataFrame, benches: list, n_items: int) -> DataFrame:
    """The fixed row spec x benchmarks (splits here), MAE x 100 to 2 places
    and rank correlation to 3 places; a missing cell is NULL."""
    spec = mae_best.sparkSession.createDataFrame(
        [(i + 1, *r) for i, r in enumerate(MAIN_TABLE_ROWS)],
        "row_no int, approach string, condensation string, prediction string, "
        "row_label string, estimator string")
    m = mae_best.filter(F.col("n_items") == n_items).select(
        "split_id", "row_label", "estimator", F.round(F.col("value") * 100, 2).alias("mae"))
    r = rank_best.filter(F.col("n_items") == n_items).select(
        "split_id", "row_label", "estimator", F.round("value", 3).alias("rank"))
    both = m.join(r, ["split_id", "row_label", "estimator"], "full")
    j = F.broadcast(spec).join(both, ["row_label", "estimator"], "left")
    wide = j.groupBy("row_no", "approach", "condensation", "prediction").pivot(
        "split_id", list(benches)).agg(F.first("mae").alias("mae"), F.first("rank").alias("rank"))
    return wide.withColumn("n_items", F.lit(n_items))


def display_names(df: DataFrame, method_col: str = "method") -> DataFrame:
    """Human label per method (fixed lookup), falling back to the name."""
    lut = df.sparkSession.createDataFrame(sorted(DISPLAY_NAMES.items()), "method string, label string")
    lut = lut.withColumnRenamed("method", method_col)
    return df.join(F.broadcast(lut), method_col, "left").withColumn(
        "label", F.coalesce(F.col("label"), F.col(method_col)))


def largest_n(df: DataFrame) -> DataFrame:
    """Rows of the largest n_items (the table written as CSV)."""
    w = Window.partitionBy("split_id")
    return df.withColumn("_mx", F.max("n_items").over(w)).filter(
        F.col("n_items") == F.col("_mx")).drop("_mx")


# ------------------------------------------------------------------ S12
def table_diff(a: DataFrame, b: DataFrame, keys: list, sample: int = 3) -> DataFrame:
    """Full outer join on keys; per value column the number of rows only
    in a, only in b, and differing (NULL-safe); plus the ``sample`` smallest
    keys of differing rows.  -> (column, only_a, only_b, n_diff, examples).

    Examples come from a per-column top-k window (a WindowGroupLimit, cut
    map-side), never from collecting all differing keys."""
    cols = [c for c in a.columns if c not in keys and c in b.columns]
    aa = a.select(*keys, *[F.col(c).alias(f"a__{c}") for c in cols], F.lit(True).alias("_in_a"))
    bb = b.select(*keys, *[F.col(c).alias(f"b__{c}") for c in cols], F.lit(True).alias("_in_b"))
    j = aa.join(bb, keys, "full")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    key_txt = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    per_col = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 (both & ~F.col(f"a__{c}").eqNullSafe(F.col(f"b__{c}"))).alias("diff"))
        for c in cols]))
    flags = j.select(key_txt.alias("key"), F.col("_in_b").isNull().alias("only_a"),
                     F.col("_in_a").isNull().alias("only_b"), per_col.alias("d")) \
             .select("key", "only_a", "only_b", "d.column", "d.diff")
    counts = flags.groupBy("column").agg(
        F.sum(F.col("only_a").cast("int")).cast("bigint").alias("only_a"),
        F.sum(F.col("only_b").cast("int")).cast("bigint").alias("only_b"),
        F.sum(F.col("diff").cast("int")).cast("bigint").alias("n_diff"))
    w = Window.partitionBy("column").orderBy("key")
    ex = flags.filter("diff").withColumn("_rn", F.row_number().over(w)) \
              .filter(F.col("_rn") <= sample) \
              .groupBy("column").agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return counts.join(ex, "column", "left").select(
        "column", "only_a", "only_b", "n_diff",
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
