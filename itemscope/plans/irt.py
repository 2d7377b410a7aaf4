"""The IRT stage of a run on its own responses: thresholds, binarised answers, choice of D, final fit.

T3 and T4 turn the models' scores (the ones that the truth is taken from, 0 / 1 or continuous) into
right and wrong; I5 fits every candidate D on
the train models without each fifth of them, takes the held-out models' abilities from the items
at even positions and their error at the odd ones; I4 fits the chosen D on all train models.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemscope.operators import irt, irt_fit, stats
from itemscope.plans.context import EvalContext
from itemscope.session import checkpoint_dir, written_table
from itemscope.sources.io import cached_stage

#: Candidate dimensions and every how manieth train model validates.
DIMS = (2, 5, 10, 15)
VALIDATE = 5
#: Largest step of a parameter at which a fit is finished.
TOLERANCE = 0.05


@dataclass
class IrtStage:
    thresholds: DataFrame     # (split_id, scenario, k, threshold)
    errors: DataFrame         # (split_id, dims, scenario, b)
    chosen: DataFrame         # (split_id, dims, err)
    items: DataFrame          # (split_id, item_id, a, b) of the chosen D
    lambdas: DataFrame        # (split_id, scenario, n_items, kind, lambda)
    test: DataFrame           # (split_id, model_id, item_id, resp) of the test models


def binary_responses(ctx: EvalContext, role: str, thresholds: DataFrame) -> DataFrame:
    rows = ctx.train(ctx.scores) if role == "train" else ctx.test(ctx.scores)
    return stats.binarize(rows, thresholds).select("split_id", "model_id", "item_id", "resp")


def validation_models(ctx: EvalContext) -> DataFrame:
    """(split_id, model_id): every VALIDATE-th train model in model order."""
    from pyspark.sql import Window

    w = Window.partitionBy("split_id").orderBy("model_pos")     # one row a model
    return ctx.role("train").withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % VALIDATE == 0).select(
        "split_id", "model_id")


def dimension_errors(responses: DataFrame, held_out: DataFrame, items: DataFrame, dims=DIMS,
                     tol: float = TOLERANCE) -> DataFrame:
    """(split_id?, dims, scenario, b) of every candidate D, all fitted in the same rounds.

    responses(split_id?, model_id, item_id, resp); held_out(split_id?, model_id)."""
    on = [k for k in ("split_id", "model_id") if k in responses.columns]
    fit = responses.join(held_out, on, "left_anti")
    validate = responses.join(held_out, on, "left_semi")
    params, _ = irt_fit.fit_grid(fit, dims, tol=tol)
    even = items.filter(F.col("item_pos") % 2 == 0).select("item_id")
    odd = items.filter(F.col("item_pos") % 2 == 1).select("item_id")
    abilities = irt_fit.abilities_grid(validate.join(even, "item_id"), params)
    scores = validate.withColumn("score", F.col("resp").cast("double"))
    return irt.validation_error(scores, odd, items, params, abilities)


def irt_stage(ctx: EvalContext, grid, dims=DIMS, tol: float = TOLERANCE) -> IrtStage:
    """The stage's tables; a session builds them once for an input and reads them again (C4)."""
    root, key = f"{checkpoint_dir(ctx.spark)}/stages", {"sf": ctx.sf_dir, "dims": list(dims), "tol": tol}

    def kept(name: str, build) -> DataFrame:
        return cached_stage(ctx.spark, root, f"irt-{name}", build, **key)
    thresholds = kept("thresholds", lambda: stats.threshold_search(ctx.train(ctx.scores)))
    train = kept("train", lambda: binary_responses(ctx, "train", thresholds))
    errors = kept("errors", lambda: dimension_errors(train, validation_models(ctx), ctx.items, dims, tol))
    chosen = kept("chosen", lambda: irt.choose_dims(errors))

    def final() -> DataFrame:
        wanted = {r.split_id: r.dims for r in chosen.collect()}     # one row a split
        return irt.fit_irt(train, wanted, tol=tol)[0]     # splits of different D in the same rounds
    items = kept("items", final)
    bias = errors.join(chosen.select("split_id", "dims"), ["split_id", "dims"]).select("split_id", "scenario", "b")
    scored = train.join(ctx.items.select("item_id", "scenario"), "item_id").withColumn("score", F.col("resp").cast("double"))
    lambdas = written_table(stats.shrinkage_lambda(stats.score_variance(scored), bias, grid))
    test = kept("test", lambda: binary_responses(ctx, "test", thresholds))
    return IrtStage(thresholds, errors, chosen, items, lambdas, test)
