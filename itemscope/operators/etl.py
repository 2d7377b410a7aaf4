"""Cleaning, alignment and merge of raw logs.

The raw form is one row per (model, sub) with arrays; the aligned form is
long: one row per (model, sub, item).  Every step is a narrow projection,
a generator (posexplode) or a keyed semi/anti join; nothing goes through
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEG_INF = float("-inf")
MAX_ANSWERS = 31          # fixed width of the reference's answer vectors


# ------------------------------------------------------------------ S1-S4
def catalog_sample(catalog: DataFrame, bench_col: str, order_col: str,
                   threshold: float = 30.0, every: int = 5) -> DataFrame:
    """Keep rows whose benchmark column exceeds ``threshold``, then every
    ``every``-th surviving row in catalogue order (the first one included).
    The numbering window runs over the catalogue (one row per model)."""
    kept = catalog.filter(F.col(bench_col) > threshold)
    w = Window.orderBy(order_col)
    return kept.withColumn("_rn", F.row_number().over(w)) \
               .filter((F.col("_rn") - 1) % every == 0).drop("_rn")


def metric_for(sub) -> F.Column:
    """Metric per sub-benchmark name."""
    s = F.col(sub) if isinstance(sub, str) else sub
    return (F.when(s.contains("arc"), "acc_norm")
             .when(s.contains("hellaswag"), "acc_norm")
             .when(s.contains("truthfulqa"), "mc2")
             .otherwise("acc"))


def extract_correctness(raw: DataFrame, sub_col: str = "sub") -> DataFrame:
    """S3: nested ``metrics[*].<metric>``, else the flat ``<metric>`` column,
    else missing (NULL).  Adds ``metric`` and ``correctness``."""
    m = metric_for(sub_col)
    nested = F.when(m == "acc", F.transform("metrics", lambda s: s["acc"])) \
              .when(m == "acc_norm", F.transform("metrics", lambda s: s["acc_norm"])) \
              .otherwise(F.transform("metrics", lambda s: s["mc2"]))
    flat = F.when(m == "acc", F.col("acc")).when(m == "acc_norm", F.col("acc_norm")) \
            .otherwise(F.lit(None).cast("array<double>"))
    return raw.withColumn("metric", m).withColumn("correctness", F.coalesce(nested, flat))


def skipped_models(cells: DataFrame, value_col: str = "correctness") -> DataFrame:
    """Per model the number of missing cells; and the count of models with any."""
    per_model = cells.groupBy("model_id").agg(
        F.sum(F.col(value_col).isNull().cast("int")).alias("n_missing"))
    return per_model.agg(F.sum((F.col("n_missing") > 0).cast("int")).cast("bigint").alias("n_skipped"),
                         F.count(F.lit(1)).alias("n_models"))


# ------------------------------------------------------------------ E1, E2, E11, E12
def drop_models(df: DataFrame, models: list) -> DataFrame:
    """Drop listed models (anti join against a small literal list)."""
    if not models:
        return df
    return df.filter(~F.col("model_id").isin(list(models)))


def complete_models(raw: DataFrame, subs: DataFrame, value_col: str = "correctness") -> DataFrame:
    """Models having a non-missing cell for every sub of ``subs``."""
    n_subs = subs.select("sub").distinct().agg(F.count(F.lit(1)).alias("n_have"))
    have = raw.filter(F.col(value_col).isNotNull()).join(
        subs.select("sub").distinct(), "sub", "left_semi") \
        .groupBy("model_id").agg(F.countDistinct("sub").alias("n_have"))
    # one-row side: the hash join on the count is a filter against a scalar
    return have.join(F.broadcast(n_subs), "n_have").select("model_id")


def completeness_filter(raw: DataFrame, subs: DataFrame, value_col: str = "correctness") -> DataFrame:
    """E2 applied: keep only rows of complete models (semi join)."""
    return raw.join(complete_models(raw, subs, value_col), "model_id", "left_semi")


def merge_snapshots(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Models of the primary snapshot win; models only in the secondary
    are appended (per sub, for every measure carried in the rows)."""
    prim_models = primary.select("model_id").distinct()
    return primary.withColumn("snapshot", F.lit("A")).unionByName(
        secondary.join(prim_models, "model_id", "left_anti").withColumn("snapshot", F.lit("B")),
        allowMissingColumns=True)


def distinct_models(raw: DataFrame) -> DataFrame:
    """The model list has one entry per (model, sub) row; collapse repeats."""
    return raw.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------------ E4-E8
def parse_predictions(raw: DataFrame, col: str = "predictions") -> DataFrame:
    """Text lists such as '[0.1, -2.5]' -> ARRAY<DOUBLE> with a native
    JSON parser; typed arrays pass through unchanged."""
    dt = dict((f.name, f.dataType.simpleString()) for f in raw.schema.fields)[col]
    if dt == "array<string>":
        return raw.withColumn(col, F.transform(col, lambda s: F.from_json(s, "array<double>")))
    return raw


def pad_answers(df: DataFrame, col: str = "logits", width: int = MAX_ANSWERS) -> DataFrame:
    """E5: pad each answer vector to ``width`` with -inf (longer vectors are left
    as they are and reported by ``width_violations``)."""
    pad = F.greatest(F.lit(width) - F.size(col), F.lit(0))
    return df.withColumn("n_answers", F.size(col)).withColumn(
        col, F.concat(F.col(col), F.array_repeat(F.lit(NEG_INF), pad)))


def width_violations(df: DataFrame, col: str = "logits", width: int = MAX_ANSWERS) -> DataFrame:
    """E5 assertion as a table: rows whose answer vector is wider than ``width``."""
    return df.filter(F.size(col) > width).withColumn("width", F.size(col))


def max_answers(df: DataFrame, col: str = "logits") -> DataFrame:
    """Largest answer count per sub (taken before padding)."""
    return df.groupBy("sub").agg(F.max(F.size(col)).alias("max_answers"))


def to_long(raw: DataFrame) -> DataFrame:
    """(model, sub) rows of parallel arrays -> one row per item, with the
    item number inside the sub.  Missing cells produce no rows."""
    z = F.arrays_zip(F.col("correctness").alias("score"), F.col("predictions").alias("logits"))
    return raw.filter(F.col("correctness").isNotNull()).select(
        "model_id", "sub", F.posexplode(z).alias("item_no", "z")) \
        .select("model_id", "sub", "item_no", "z.score", "z.logits")


def with_optional(df: DataFrame, columns: list) -> DataFrame:
    """Project optional columns; an absent one becomes a NULL column."""
    present = set(df.columns)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in columns if c not in present])


def run_dates(raw: DataFrame) -> DataFrame:
    """Run date from the 'YYYY_MM_DD...' prefix of the first run name, per model."""
    d = F.to_date(F.substring(F.element_at("run_dates", 1), 1, 10), "yyyy_MM_dd")
    return raw.groupBy("model_id").agg(F.min(d).alias("run_date"))
