"""Model order and train/test splits.

Model tables have one row per model; ordering windows run over models only.
A split is a plain table ``splits(split_id, model_id, role)`` with role
``train`` / ``test`` / ``val``, so several test sets live in one plan (P6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.functions import md5_key


def model_order(models: DataFrame, date_col: str = "run_date") -> DataFrame:
    """model_pos, newest first; ties broken by model_id (quirk Q3)."""
    w = Window.orderBy(F.col(date_col).desc(), F.col("model_id").asc())
    return models.withColumn("model_pos", (F.row_number().over(w) - 1).cast("int"))


def first_models(ordered: DataFrame, n: int) -> DataFrame:
    """Keep the first ``n`` models of the order."""
    return ordered.filter(F.col("model_pos") < n)


def _roles(ordered: DataFrame, is_test, split_id: str) -> DataFrame:
    return ordered.select(
        F.lit(split_id).alias("split_id"), "model_id", "model_pos",
        F.when(is_test, "test").otherwise("train").alias("role"))


def split_systematic(ordered: DataFrame, n_test: int = 40, split_id: str = "iid",
                     n_models: int | None = None) -> DataFrame:
    """test = every k-th model (k = floor(n / n_test), at least 1)."""
    if n_models is None:
        n_models = ordered.count()
    k = max(1, n_models // n_test)
    return _roles(ordered, (F.col("model_pos") % k) == 0, split_id)


def split_chronological(ordered: DataFrame, n_test: int = 40, split_id: str = "noniid") -> DataFrame:
    """test = the n_test newest models."""
    return _roles(ordered, F.col("model_pos") < n_test, split_id)


def validation_carve_out(split: DataFrame, random: bool = True, seed: int = 0) -> DataFrame:
    """Drop the test models; choose as many validation models from the rest,
    md5-random (iid) or the first ones in model order (noniid).  Output roles
    are ``train`` and ``val`` (the validation set plays the test role)."""
    n_test = split.filter(F.col("role") == "test").groupBy("split_id").agg(
        F.count(F.lit(1)).alias("n_test"))
    rest = split.filter(F.col("role") == "train")
    order = md5_key(F.lit(seed), F.col("model_id")) if random else F.col("model_pos")
    w = Window.partitionBy("split_id").orderBy(order, F.col("model_id"))
    ranked = rest.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(n_test), "split_id")
    return ranked.select(
        "split_id", "model_id", "model_pos",
        F.when(F.col("_rn") <= F.col("n_test"), "val").otherwise("train").alias("role"))


def limit_train(split: DataFrame, n_source_models: int | None) -> DataFrame:
    """P5: keep only the first n train models (model order) per split."""
    if n_source_models is None:
        return split
    w = Window.partitionBy("split_id", "role").orderBy("model_pos")
    ranked = split.withColumn("_rn", F.row_number().over(w))
    return ranked.filter((F.col("role") != "train") | (F.col("_rn") <= n_source_models)).drop("_rn")


def project(df: DataFrame, split: DataFrame, role: str) -> DataFrame:
    """Rows of ``df`` belonging to ``role`` models, with split_id attached.

    The split table has one row per model and split: broadcast-sized."""
    keys = F.broadcast(split.filter(F.col("role") == role).select("split_id", "model_id"))
    return df.join(keys, "model_id")
