"""Nested raw logs (D1) derived from the fixtures, in the shapes the ETL reads.

``f4_raw_runs``: one row per (model, sub) with ``correctness ARRAY<DOUBLE>``,
``predictions`` as text lists (snapshot A) or ``ARRAY<ARRAY<DOUBLE>>``
(snapshot B) and ``run_dates ARRAY<STRING>``; a missing cell is a row whose
arrays are NULL.  ``raw_metrics``: per (model, sub) a nested
``metrics ARRAY<STRUCT<acc, acc_norm, mc2>>`` or a flat fallback column.

Building the nested form groups one (model, sub) cell - bounded by the size
of one sub-benchmark; the ETL itself only explodes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemscope.sources import fixtures as fx

# Fixed values of the fixture design.
SNAPSHOT_A_MODELS = (0, 39)
SNAPSHOT_B_MODELS = (30, 59)
MISSING_MOD, MISSING_REST, MISSING_SUB = 10, 7, 3   # model % 10 == 7 lacks sub 3
SHORT_SUB = 0                                        # sub 0 has its last answer removed


def f4_raw_runs(spark: SparkSession, sf_dir: str, snapshot: str = "A") -> DataFrame:
    lo, hi = SNAPSHOT_A_MODELS if snapshot == "A" else SNAPSHOT_B_MODELS
    preds = fx.f1_predictions(spark, sf_dir).filter(F.col("model_id").between(lo, hi))
    scores = fx.f1_scores(spark, sf_dir).select("model_id", "item_id", "score")
    models = fx.f1_models(spark, sf_dir)
    df = preds.join(scores, ["model_id", "item_id"]).join(F.broadcast(models), "model_id")
    logits = F.transform("logits", lambda x: F.round(x, 6))
    logits = F.when(F.col("sub") == SHORT_SUB, F.slice(logits, 1, fx.F1_CLASSES - 1)).otherwise(logits)
    score = F.col("score") if snapshot == "A" else F.lit(0.25) + F.col("score") * 0.5
    if snapshot == "A":
        pred = F.concat(F.lit("["), F.array_join(F.transform(logits, lambda x: x.cast("string")), ", "),
                        F.lit("]"))
    else:
        pred = logits
    cell = df.select("model_id", "sub", "item_id", "run_date", score.alias("score"), pred.alias("pred"))
    g = cell.groupBy("model_id", "sub").agg(
        F.first("run_date").alias("run_date"),
        F.sort_array(F.collect_list(F.struct("item_id", "score", "pred"))).alias("_c"))
    missing = (F.col("model_id") % MISSING_MOD == MISSING_REST) & (F.col("sub") == MISSING_SUB)
    run_name = F.concat(F.date_format("run_date", "yyyy_MM_dd"), F.lit("T00_00"))
    return g.select(
        "model_id", "sub",
        F.array(run_name).alias("run_dates"),
        F.when(~missing, F.transform("_c", lambda s: s["score"])).alias("correctness"),
        F.when(~missing, F.transform("_c", lambda s: s["pred"])).alias("predictions"))


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (model, sub) of the sparse log: nested metrics, or a flat fallback
    (model % 4 == 1), or neither (model % 9 == 2)."""
    log = fx.f2_log(spark, sf_dir)
    g = log.groupBy("model_id", "sub").agg(
        F.sort_array(F.collect_list(F.struct("item_id", "score"))).alias("_c"))
    nested = F.transform("_c", lambda s: F.struct(
        s["score"].alias("acc"), F.round(s["score"] * 0.9, 6).alias("acc_norm"),
        F.lit(None).cast("double").alias("mc2")))
    flat = F.transform("_c", lambda s: s["score"])
    flat_only = F.col("model_id") % 4 == 1
    none = F.col("model_id") % 9 == 2
    return g.select(
        "model_id", "sub",
        F.when(~flat_only & ~none, nested).alias("metrics"),
        F.when(flat_only & ~none, flat).alias("acc"),
        F.when(flat_only & ~none, F.transform(flat, lambda v: F.round(v * 0.9, 6))).alias("acc_norm"))
