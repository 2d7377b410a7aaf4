"""Evaluation-log tables derived from the given parquet files.

All fixtures are deterministic DataFrame expressions over the test data;
nothing is generated on the driver, and every table grows with its source.

F1  dense predictions/scores over ``embeddings`` (60 models x items x 4 answers)
F2  sparse graded log over ``lineitem`` join ``part``
F3  response events over ``events``
F4  nested raw runs (one row per model x sub) built from F1
F5  planted item-response parameters over ``embeddings`` items
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemscope.functions import argmax_array, hex_uniform, item_curve, softmax_array

# Fixed values of the fixture design (must equal the oracle SQL twins).
F1_MODELS = 60
F1_CLASSES = 4
F1_LOGIT_SCALE = 8.0
F1_NOISE_OFFSET = 5          # noise logits read embedding[5 + ((m*4 + c) % 60)]
F1_START_DATE = "2024-01-01"
F1_DATE_STEP = 37            # run_date = start + (model_id * 37) % 60 days
F5_MODELS = 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------- F1
def _f1_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings x model ids, as a generator (no join), one row per model x item."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return emb.select(
        F.explode(F.sequence(F.lit(0), F.lit(F1_MODELS - 1))).alias("model_id"),
        F.col("vec_id").alias("item_id"),
        F.when(F.col("label") < 5, "alpha").otherwise("beta").alias("scenario"),
        F.col("label").alias("sub"),
        "embedding",
    )


def _f1_logits_col() -> F.Column:
    m = F.col("model_id")
    share = m / F.lit(float(F1_MODELS))
    return F.transform(
        F.sequence(F.lit(0), F.lit(F1_CLASSES - 1)),
        lambda c: F.lit(F1_LOGIT_SCALE) * (
            (F.lit(1.0) - share) * F.element_at("embedding", c + 1).cast("double")
            + share * F.element_at(
                "embedding", F.lit(F1_NOISE_OFFSET) + ((m * F1_CLASSES + c) % F1_MODELS)
            ).cast("double")
        ),
    )


def _f1_gold_col() -> F.Column:
    return argmax_array(F.slice("embedding", 1, F1_CLASSES))


def f1_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id INT, item_id BIGINT, scenario STRING, sub INT, logits ARRAY<DOUBLE>."""
    return _f1_base(spark, sf_dir).select(
        "model_id", "item_id", "scenario", "sub", _f1_logits_col().alias("logits"))


def f1_predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per model x item x class (for presentation / export)."""
    return f1_predictions(spark, sf_dir).select(
        "model_id", "item_id", "scenario", "sub",
        F.posexplode("logits").alias("class_id", "logit"))


def f1_scores(spark: SparkSession, sf_dir: str, soft: bool = False) -> DataFrame:
    """model_id, item_id, scenario, sub, score.

    Hard score: 1.0 when the arg-max logit is the gold answer (arg-max of the
    first four embedding entries, lowest class on ties).  Soft score: the
    softmax probability of the gold answer.
    """
    base = _f1_base(spark, sf_dir).select(
        "model_id", "item_id", "scenario", "sub",
        _f1_logits_col().alias("logits"), _f1_gold_col().alias("gold"))
    if soft:
        score = F.element_at(softmax_array("logits"), F.col("gold") + 1)
    else:
        score = (argmax_array("logits") == F.col("gold")).cast("double")
    return base.select("model_id", "item_id", "scenario", "sub", score.alias("score"))


def f1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, scenario, sub (one row per embedding vector)."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return emb.select(
        F.col("vec_id").alias("item_id"),
        F.when(F.col("label") < 5, "alpha").otherwise("beta").alias("scenario"),
        F.col("label").alias("sub"))


def f1_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, sub, scenario_ord, sub_ord: the benchmark hierarchy, from the data."""
    subs = f1_items(spark, sf_dir).select("scenario", "sub").distinct()
    return subs.select(
        "scenario", "sub",
        F.when(F.col("scenario") == "alpha", 0).otherwise(1).alias("scenario_ord"),
        F.col("sub").cast("int").alias("sub_ord"))


def f1_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id INT, run_date DATE (all distinct: 37 and 60 are coprime)."""
    ids = f1_predictions(spark, sf_dir).select("model_id").distinct()
    return ids.select(
        "model_id",
        F.date_add(F.lit(F1_START_DATE).cast("date"),
                   ((F.col("model_id") * F1_DATE_STEP) % F1_MODELS).cast("int")).alias("run_date"))


# --------------------------------------------------------------------- F2
def f2_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse graded log: (supplier = model, part = item), 11-step score."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_shipdate")
    pt = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    return (j.groupBy("l_suppkey", "l_partkey", "p_brand", "p_type")
             .agg(F.round(F.max("l_discount") * 10, 6).alias("score"),
                  F.min("l_shipdate").alias("run_ts"),
                  F.count(F.lit(1)).alias("n_obs"))
             .select(F.col("l_suppkey").cast("bigint").alias("model_id"),
                     F.col("l_partkey").cast("bigint").alias("item_id"),
                     F.col("p_brand").alias("scenario"),
                     F.col("p_type").alias("sub"),
                     "score", "run_ts", "n_obs"))


# --------------------------------------------------------------------- F3
def f3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts",
        F.col("user_id").alias("model_id"),
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        F.round(F.least(F.col("value"), F.lit(100.0)) / 100.0, 6).alias("score"))


# --------------------------------------------------------------------- F5
def f5_item_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, a ARRAY<DOUBLE>, b ARRAY<DOUBLE> (D = 1), planted."""
    it = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    return it.select(
        "item_id",
        F.array(F.lit(0.5) + (F.col("item_id") % 10) / 10.0).alias("a"),
        F.array(((F.col("item_id") * 7) % 41 - 20) / 10.0).alias("b"))


def f5_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, item_id, p, resp: 60 planted abilities x items."""
    items = f5_item_params(spark, sf_dir)
    df = items.select(
        F.explode(F.sequence(F.lit(0), F.lit(F5_MODELS - 1))).alias("model_id"), "item_id", "a", "b")
    theta = F.array((F.col("model_id") - 30) / 15.0)
    p = item_curve(theta, "a", "b")
    return df.select(
        "model_id", "item_id", p.alias("p"),
        (p > hex_uniform("model_id", "item_id")).cast("int").alias("resp"))


def f5_abilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (f5_responses(spark, sf_dir).select("model_id").distinct()
            .select("model_id", F.array((F.col("model_id") - 30) / 15.0).alias("theta")))
