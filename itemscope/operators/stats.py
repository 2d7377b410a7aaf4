"""Item and model statistics.

Predictions are in array form ``(model_id, item_id, logits ARRAY<DOUBLE>)``:
softmax is row-local; disagreement is a grouped aggregate whose partial
(map-side) step collapses all models of an item before the shuffle, so a
model or item holding a third of the rows never lands in one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.functions import md5_key, normalise, r12, sum_array, with_softmax

EPS_JSD = 1e-12
# The threshold grid is linspace(0.01, 0.99, 1000).
GRID_START = 0.01
GRID_STOP = 0.99
GRID_SIZE = 1000


# ------------------------------------------------------------------ T8/T9
def probs_are_normalised(preds: DataFrame, col: str = "logits") -> bool:
    """T8 gate: min >= 0 and max <= 1 over the *whole* tensor (one scalar read)."""
    row = preds.agg(F.min(F.array_min(col)).alias("lo"),
                    F.max(F.array_max(col)).alias("hi")).first()
    return row is not None and row.lo is not None and row.lo >= 0 and row.hi <= 1


def to_probs(preds: DataFrame, col: str = "logits", mode: str = "auto",
             out: str = "probs") -> DataFrame:
    """T8 + T9: probabilities per (model, item).

    mode='auto' applies softmax unless the whole input already lies in [0,1];
    'logits' always applies it; 'probs' never does."""
    if mode not in ("auto", "logits", "probs"):
        raise ValueError(f"unknown input mode {mode!r}")
    use_softmax = mode == "logits" or (mode == "auto" and not probs_are_normalised(preds, col))
    if not use_softmax:
        return preds.withColumnRenamed(col, out) if col != out else preds
    df = with_softmax(preds, col, out)
    return df.drop(col) if col != out else df


# ------------------------------------------------------------------ T10-T14
def _with_variants(probs: DataFrame, variants: DataFrame | None) -> tuple[DataFrame, list]:
    if variants is None:
        return probs, []
    # variants([split_id,] variant, model_id): one row per member model - bounded
    on = [c for c in ("split_id", "model_id") if c in variants.columns and c in probs.columns]
    return probs.join(F.broadcast(variants), on), ["variant"]


def pds(probs: DataFrame, variants: DataFrame | None = None, col: str = "probs",
        keys=("item_id",)) -> DataFrame:
    """PDS(item) = sum over answers of the max over models of P(answer)."""
    df, vk = _with_variants(probs, variants)
    # posexplode_outer: no inferred size() > 0 filter re-evaluating the input array
    ex = df.select(*vk, *keys, F.posexplode_outer(col).alias("class_id", "p"))
    per_class = ex.groupBy(*vk, *keys, "class_id").agg(F.max("p").alias("pmax"))
    return per_class.groupBy(*vk, *keys).agg(F.sum("pmax").alias("pds"))


def jsd(probs: DataFrame, variants: DataFrame | None = None, col: str = "probs",
        keys=("item_id",), eps: float = EPS_JSD) -> DataFrame:
    """Mean over models of KL(p || m), p and m clamped at eps and renormalised.

    One pass over responses:  sum_c avg_models(p ln p) - sum_c m_raw ln clamp(m_raw)
    + (sum_c m_raw) ln (sum_c clamp(m_raw)), where m_raw = avg_models(p)."""
    df, vk = _with_variants(probs, variants)
    clamped = F.transform(col, lambda v: F.greatest(v, F.lit(eps)))
    df = df.select(*vk, *keys, normalise(clamped).alias("_pn"))
    ex = df.select(*vk, *keys, F.posexplode_outer("_pn").alias("class_id", "p"))
    per_class = ex.groupBy(*vk, *keys, "class_id").agg(
        F.avg("p").alias("m_raw"), F.avg(F.col("p") * F.log("p")).alias("plogp"))
    return per_class.groupBy(*vk, *keys).agg(
        (F.sum("plogp")
         - F.sum(F.col("m_raw") * F.log(F.greatest("m_raw", F.lit(eps))))
         + F.sum("m_raw") * F.log(F.sum(F.greatest("m_raw", F.lit(eps))))).alias("jsd"))


def disagreement(probs: DataFrame, kind: str = "pds", variants: DataFrame | None = None,
                 col: str = "probs", keys=("item_id",)) -> DataFrame:
    """Score-type switch; the result column is ``score``."""
    if kind == "pds":
        return pds(probs, variants, col, keys).withColumnRenamed("pds", "score")
    if kind == "jsd":
        return jsd(probs, variants, col, keys).withColumnRenamed("jsd", "score")
    raise ValueError(f"Disagreement type {kind} not supported")


#: Aggregates of one pass (variants x answers); more variants are scored in further passes.
COLUMNS_PER_PASS = 512
#: A table of model memberships is sent to all tasks only up to this many rows.
MEMBER_ROWS = 2_000_000


def variant_scores(probs: DataFrame, members: DataFrame, kind: str = "pds", col: str = "probs",
                   width: int | None = None, eps: float = EPS_JSD) -> DataFrame:
    """PDS or JSD of every item for every (split, variant) of ``members`` from one scan of ``probs``.

    probs(model_id, item_id, probs); members(split_id?, variant, model_id).  A model carries a bit for
    every set it belongs to, and the aggregate of an item holds a maximum (or sums) per set and answer:
    responses are neither repeated per split or variant nor exploded per answer, and one exchange by
    item adds the partial aggregates up.  ``width`` (answers per item) is read from the data when not
    given.  A set without answers to an item gives no row.  -> (split_id?, variant, item_id, score)"""
    if kind not in ("pds", "jsd"):
        raise ValueError(f"Disagreement type {kind} not supported")
    keys = [k for k in ("split_id", "variant") if k in members.columns]
    sets = [tuple(r) for r in members.select(*keys).distinct().orderBy(*keys).collect()]   # a key list
    if width is None:
        width = probs.agg(F.max(F.size(col))).first()[0] or 0
    step = max(1, min(62, COLUMNS_PER_PASS // max(1, width + 2)))
    out = None
    for lo in range(0, max(len(sets), 1), step):
        part = _scored_sets(probs, members, keys, sets[lo:lo + step], kind, col, width, eps)
        out = part if out is None else out.unionByName(part)
    return out


def _scored_sets(probs, members, keys, sets, kind, col, width, eps) -> DataFrame:
    spark = probs.sparkSession
    numbered = [(*s, i) for i, s in enumerate(sets)]
    types = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    table = spark.createDataFrame(numbered, ", ".join([*(f"{k} {types[k]}" for k in keys), "bit int"]))
    bits = members.join(F.broadcast(table), keys).select("model_id", "bit").distinct().groupBy("model_id").agg(
        F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("_in"))
    if bits.limit(MEMBER_ROWS + 1).count() <= MEMBER_ROWS:
        bits = F.broadcast(bits)
    df = probs.select("model_id", "item_id", col).join(bits, "model_id")
    if kind == "jsd":
        df = df.withColumn("_p", normalise(F.transform(col, lambda v: F.greatest(v, F.lit(eps)))))
        df = df.withColumn("_plogp", sum_array(F.transform("_p", lambda v: v * F.log(v))))
    else:
        df = df.withColumnRenamed(col, "_p")
    aggs = []
    for i in range(len(sets)):
        inside = F.col("_in").bitwiseAND(F.lit(1 << i)) != 0
        aggs.append(F.count(F.when(inside, 1)).alias(f"n{i}"))
        for c in range(width):
            value = F.when(inside, F.get("_p", F.lit(c)))
            aggs.append((F.max(value) if kind == "pds" else F.sum(value)).alias(f"v{i}_{c}"))
        if kind == "jsd":
            aggs.append(F.sum(F.when(inside, F.col("_plogp"))).alias(f"l{i}"))
    per = df.groupBy("item_id").agg(*aggs)
    cells = []
    for i, s in enumerate(sets):
        n, values = F.col(f"n{i}"), [F.col(f"v{i}_{c}") for c in range(width)]
        if kind == "pds":
            score = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
        else:
            m = F.array(*[F.coalesce(v, F.lit(0.0)) / n for v in values])
            m = F.filter(m, lambda x: x > 0)
            clamped = F.transform(m, lambda x: F.greatest(x, F.lit(eps)))
            score = (F.col(f"l{i}") / n - sum_array(F.transform(m, lambda x: x * F.log(F.greatest(x, F.lit(eps)))))
                     + sum_array(m) * F.log(sum_array(clamped)))
        cells.append(F.when(n > 0, F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, s)], score.alias("score"))))
    each = per.select("item_id", F.explode(F.array(*cells)).alias("s")).where("s is not null")
    return each.select(*[f"s.{k}" for k in keys], "item_id", "s.score")


def guiding_models(train_models: DataFrame, n_guiding: int | None, seed: int = 0,
                   variant: str | None = None) -> DataFrame:
    """G guiding models drawn without replacement, md5-ordered by (seed, variant, model).

    Returns (variant, model_id).  n_guiding=None keeps every model."""
    name = variant if variant is not None else ("all" if n_guiding is None else f"@{n_guiding}")
    sk = ["split_id"] if "split_id" in train_models.columns else []
    base = train_models.select(*sk, "model_id").distinct()
    if n_guiding is None:
        return base.select(*sk, F.lit(name).alias("variant"), "model_id")
    w = Window.partitionBy(*sk).orderBy(md5_key(F.lit(seed), F.lit(name), F.col("model_id")),
                                        F.col("model_id"))
    return (base.withColumn("_rn", F.row_number().over(w))
                .filter(F.col("_rn") <= n_guiding)
                .select(*sk, F.lit(name).alias("variant"), "model_id"))


def variant_table(train_models: DataFrame, guiding_counts: list, seed: int = 0) -> DataFrame:
    """One membership table for every distinct disagreement key."""
    out = None
    for g in dict.fromkeys(guiding_counts):
        part = guiding_models(train_models, g, seed)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ T1/T5/T6/T7
def true_accuracy(scores: DataFrame, items: DataFrame, keys=("model_id",)) -> DataFrame:
    """Mean over the scenario's items of bal_w * score (a plain mean, not / sum w)."""
    it = items.select("item_id", "scenario", "bal_w")
    return (scores.select(*keys, "item_id", "score").join(it, "item_id")
                  .groupBy(*keys, "scenario")
                  .agg(F.avg(F.col("bal_w") * F.col("score")).alias("acc")))


def mean_train_score(train_scores: DataFrame, keys=("split_id",)) -> DataFrame:
    """T5: unweighted grand mean of the train scores."""
    return train_scores.groupBy(*keys).agg(F.avg("score").alias("mean_train_score"))


def score_variance(train_scores: DataFrame, keys=("split_id",)) -> DataFrame:
    """Per scenario, mean over models of each model's population variance."""
    per_model = train_scores.groupBy(*keys, "scenario", "model_id").agg(
        F.var_pop("score").alias("v"))
    return per_model.groupBy(*keys, "scenario").agg(F.avg("v").alias("score_var"))


def shrinkage_lambda(variance: DataFrame, bias: DataFrame, n_items_grid: list,
                     keys=("split_id",)) -> DataFrame:
    """lambda = b^2 / (v/n + b^2) for random sampling, v/(4n) for the others.

    variance(keys, scenario, score_var), bias(keys, scenario, b)."""
    grid = F.explode(F.array(*[F.lit(int(n)) for n in dict.fromkeys(n_items_grid)]))
    kinds = F.explode(F.array(F.lit("random"), F.lit("other")))
    df = variance.join(bias, [*keys, "scenario"]).select(
        *keys, "scenario", "score_var", "b", grid.alias("n_items"))
    df = df.select("*", kinds.alias("kind"))
    denom_v = F.when(F.col("kind") == "random", F.col("score_var") / F.col("n_items")) \
               .otherwise(F.col("score_var") / (4 * F.col("n_items")))
    b2 = F.col("b") * F.col("b")
    return df.select(*keys, "scenario", "n_items", "kind", (b2 / (denom_v + b2)).alias("lambda"))


# ------------------------------------------------------------------ T3/T4
def grid_value(k):
    """Threshold k of linspace(GRID_START, GRID_STOP, GRID_SIZE) (last one exact)."""
    step = (GRID_STOP - GRID_START) / (GRID_SIZE - 1)
    return F.when(k == GRID_SIZE - 1, F.lit(GRID_STOP)).otherwise(
        F.lit(GRID_START) + k.cast("double") * F.lit(step))


def _bucket(score):
    """Number of grid points strictly below ``score`` (0..GRID_SIZE), exact.

    Estimate by division, then correct one step either way against the exact
    grid values, so strict ``score > c`` holds as in the direct form."""
    step = (GRID_STOP - GRID_START) / (GRID_SIZE - 1)
    k0 = F.least(F.greatest(F.ceil((score - F.lit(GRID_START)) / F.lit(step)), F.lit(0)),
                 F.lit(GRID_SIZE)).cast("int")
    down = F.when((k0 > 0) & (grid_value(k0 - 1) >= score), k0 - 1).otherwise(k0)
    return F.when((down < GRID_SIZE) & (grid_value(down) < score), down + 1).otherwise(down)


def threshold_search(train_scores: DataFrame, keys=("split_id",)) -> DataFrame:
    """Per scenario, the grid threshold c minimising the mean over models of
    |mean(score > c) - mean(score)|; the first minimum wins.

    Responses are read once and never joined: each score maps to its grid
    bucket; per (model, scenario) the bucket histogram (at most 1001 rows) is
    reverse-cumulated, and each present bucket b emits the span of thresholds
    k in [previous bucket, b - 1] on which #(score > c_k) is constant, plus a
    zero tail after the last bucket.  The spans tile k = 0..999 exactly once
    per model, so the final grouped mean over models is a partial aggregate."""
    s = train_scores.select(*keys, "scenario", "model_id", "score")
    grp = [*keys, "scenario", "model_id"]
    hist = (s.withColumn("bucket", _bucket(F.col("score")))
              .groupBy(*grp, "bucket")
              .agg(F.count(F.lit(1)).alias("cnt"), F.sum("score").alias("ssum")))
    whole = Window.partitionBy(*grp)
    down = Window.partitionBy(*grp).orderBy(F.col("bucket").desc()) \
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*grp).orderBy("bucket")
    h = hist.select(
        *grp, "bucket",
        F.sum("cnt").over(down).alias("at_or_above"),
        F.sum("cnt").over(whole).alias("n"),
        (F.sum("ssum").over(whole) / F.sum("cnt").over(whole)).alias("mean_score"),
        F.coalesce(F.lag("bucket").over(up), F.lit(-1)).alias("prev"),
        F.lead("bucket").over(up).isNull().alias("last"))
    spans = F.array(
        F.struct(F.col("prev").alias("lo"), (F.col("bucket") - 1).alias("hi"),
                 F.col("at_or_above").alias("above")),
        F.when(F.col("last"), F.struct(F.col("bucket").alias("lo"),
                                       F.lit(GRID_SIZE - 1).alias("hi"),
                                       F.lit(0).cast("long").alias("above"))))
    per = h.select(*grp, "n", "mean_score", F.explode(spans).alias("sp")).filter(F.col("sp").isNotNull())
    per = per.select(*grp, "n", "mean_score", "sp.above",
                     F.explode(F.sequence(F.greatest(F.col("sp.lo"), F.lit(0)), F.col("sp.hi"))).alias("k"))
    diff = F.abs(F.col("above") / F.col("n") - F.col("mean_score"))
    per_k = per.groupBy(*keys, "scenario", "k").agg(r12(F.avg(diff)).alias("err"))
    best = per_k.groupBy(*keys, "scenario").agg(
        F.min_by("k", F.struct("err", "k")).alias("k"))
    return best.select(*keys, "scenario", "k", grid_value(F.col("k")).alias("threshold"))


def binarize(scores: DataFrame, thresholds: DataFrame, keys=("split_id",)) -> DataFrame:
    """T4: resp = (score > c) as 0/1, c per scenario (one row per scenario: broadcast)."""
    th = F.broadcast(thresholds.select(*keys, "scenario", "threshold"))
    return scores.join(th, [*keys, "scenario"]).withColumn(
        "resp", (F.col("score") > F.col("threshold")).cast("int"))
