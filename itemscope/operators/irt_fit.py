"""Joint fits of many IRT models (I4, I5): every split and every number of dimensions in the same rounds.

The responses are stored as one row per (split, item) with the item's answers as
arrays, bucketed by (split, item).  Item parameters are written in the same buckets,
so a round joins them to the responses without moving a response.  After ``TABLE_ROUNDS``
such rounds the joined rows are kept as blocks of an RDD (memory, then disk): a later round
is one job that maps the blocks to blocks with new parameters and writes no table; every
``CUT_EVERY`` rounds they are checkpointed, so a lost executor's blocks are made again from there.

* a task reads its items' answers and current parameters and makes Newton steps
  for (a_1..a_D, beta) of every item, which has all its answers in one row;
* with the new parameters it sums gradient and Hessian of the abilities over its
  items, one row per task and block of models; those sums, not the responses,
  are sent on (of many tasks: shuffled and added first), added, and solved per model;
* the priors alone fix location and scale, so every step climbs one objective and
  the steps vanish at its top.

The abilities (models x D) are the only thing sent to all tasks; their size is
checked against ``ABILITY_BYTES``.  A (split, D) whose largest step falls under
``tol`` is finished and left out of later rounds.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemscope.session import checkpoint_dir, drop_table, written_table

ABILITY_BYTES = 256 << 20
MODEL_BLOCK = 256
ANSWERS_PER_BUCKET = 250_000
#: A table with fewer answers than that for every core is dealt to fewer of them.
LEAST_PER_BUCKET = 20_000
#: Answers (items x models) that numpy handles at once.
CHUNK = 1 << 20
MAX_STEP = 1.0
#: First rounds, which write their parameters as a table: a fit that ends in them does not pay for blocks.
TABLE_ROUNDS = 3
#: Rounds after which blocks are checkpointed.
CUT_EVERY = 25
#: Parts of a sum that the driver adds up.
FAN_IN = 64


class Bucketed:
    """A table in buckets of (split_id, item_id) under the checkpoint folder; readers join it in place."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark = df.sparkSession
        self.name = f"irt_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/{self.name}"
        (df.write.bucketBy(buckets, "split_id", "item_id").sortBy("split_id", "item_id")
         .option("path", self.path).format("parquet").saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _buckets(answers: int, cores: int = 1) -> int:
    """Buckets of a bounded size, and one for every core where the answers are enough."""
    return max(1, min(50_000, max(-(-answers // ANSWERS_PER_BUCKET), min(cores, -(-answers // LEAST_PER_BUCKET)))))


def _with_split(df: DataFrame) -> DataFrame:
    return df if "split_id" in df.columns else df.withColumn("split_id", F.lit(""))


def model_index(responses: DataFrame) -> DataFrame:
    """(split_id, model_id, m): models numbered from 0 within their split (one row a model)."""
    w = Window.partitionBy("split_id").orderBy("model_id")
    return responses.select("split_id", "model_id").distinct().withColumn("m", F.row_number().over(w) - 1)


def by_item(responses: DataFrame, models: DataFrame) -> DataFrame:
    """(split_id, item_id, m ARRAY<INT>, x ARRAY<DOUBLE>): an item's answers in model order."""
    j = responses.join(models, ["split_id", "model_id"])
    return j.groupBy("split_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("m", "x"))).alias("r")).select(
        "split_id", "item_id", F.transform("r", lambda r: r["m"]).alias("m"), F.transform("r", lambda r: r["x"]).alias("x"))


# ------------------------------------------------------------------ numpy steps
def _curve(a: np.ndarray, beta: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(a @ theta.T - beta[:, None], -30.0, 30.0)))


def _outer(v: np.ndarray) -> np.ndarray:
    """Products of every two coordinates, the upper triangle row by row."""
    i, j = np.triu_indices(v.shape[1])
    return v[:, i] * v[:, j]


def _square(upper: np.ndarray, d: int) -> np.ndarray:
    """D x D matrices from the rows of their upper triangles."""
    i, j = np.triu_indices(d)
    out = np.empty((len(upper), d, d))
    out[:, i, j] = out[:, j, i] = upper
    return out


def item_step(a, beta, theta, x, mask, priors) -> tuple[np.ndarray, np.ndarray]:
    """One Newton step of every item's (a, beta); x and mask are items x models."""
    d = a.shape[1]
    p = _curve(a, beta, theta)
    w = np.where(mask, p * (1 - p), 0.0)
    resid = np.where(mask, x - p, 0.0)
    a_mean, a_sd, b_sd = priors
    g = np.column_stack([resid @ theta - (a - a_mean) / a_sd ** 2, -resid.sum(1) - beta / b_sd ** 2])
    h = np.zeros((len(a), d + 1, d + 1))
    h[:, :d, :d] = _square(w @ _outer(theta), d) + np.eye(d) / a_sd ** 2
    h[:, :d, d] = h[:, d, :d] = -(w @ theta)
    h[:, d, d] = w.sum(1) + 1 / b_sd ** 2
    step = np.clip(np.linalg.solve(h, g[:, :, None])[:, :, 0], -MAX_STEP, MAX_STEP)
    return a + step[:, :d], beta + step[:, d]


def ability_sums(a, beta, theta, x, mask) -> np.ndarray:
    """Per model: gradient (D) and negative Hessian (D x D) of its log likelihood over the items."""
    p = _curve(a, beta, theta)
    w = np.where(mask, p * (1 - p), 0.0)
    resid = np.where(mask, x - p, 0.0)
    return np.column_stack([resid.T @ a, _square(w.T @ _outer(a), a.shape[1]).reshape(theta.shape[0], -1)])


def ability_step(theta: np.ndarray, sums: np.ndarray, sd: float | None) -> np.ndarray:
    d = theta.shape[1]
    prec = 0.0 if sd is None else 1.0 / sd ** 2
    h = sums[:, d:].reshape(-1, d, d) + np.eye(d) * (prec + 1e-9)
    step = np.linalg.solve(h, (sums[:, :d] - theta * prec)[:, :, None])[:, :, 0]
    return np.clip(step, -MAX_STEP, MAX_STEP)


# ------------------------------------------------------------------ one round
OUT = "split_id string, item_id bigint, par array<double>, dims int, block int, sums array<double>, step double"
OUT_TYPES = {"split_id": pa.string(), "item_id": pa.int64(), "par": pa.list_(pa.float64()), "dims": pa.int32(), "block": pa.int32(),
             "sums": pa.list_(pa.float64()), "step": pa.float64()}


def _out(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of ``OUT``; columns not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in OUT_TYPES.items()], names=list(OUT_TYPES))


def _lists(rows: np.ndarray) -> pa.Array:
    """One Arrow list per row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges) of a column of lists."""
    size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _chunks(length: np.ndarray, n_models: int) -> Iterator[slice]:
    size = max(1, CHUNK // max(1, min(n_models, int(length.max(initial=1)))))
    for lo in range(0, len(length), size):
        yield slice(lo, lo + size)


def par_columns(dims: list) -> list[slice]:
    """Where (a_1..a_D, beta) of every D stand in ``par``."""
    edge = np.concatenate([[0], np.cumsum([d + 1 for d in dims])]).tolist()
    return [slice(lo, hi) for lo, hi in zip(edge[:-1], edge[1:])]


def _answers(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(split, rows, models, x, mask) of a batch's rows of ``by_item``: answers as items x models that have any, ``CHUNK`` at most."""
    code = batch.column("split_id").dictionary_encode()
    split_of = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    (m, edge), (values, _) = _values(batch.column("m")), _values(batch.column("x"))
    for s, split in enumerate(code.dictionary.to_pylist()):
        at = np.flatnonzero(split_of == s)
        for part in _chunks(edge[at + 1] - edge[at], int(m.max(initial=0)) + 1):
            own = at[part]
            length = edge[own + 1] - edge[own]
            line = np.repeat(np.arange(len(own)), length)
            flat = np.arange(length.sum()) + np.repeat(edge[own] - (np.cumsum(length) - length), length)
            used, col = np.unique(m[flat], return_inverse=True)
            x = np.zeros((len(own), len(used)))
            mask = np.zeros(x.shape, bool)
            x[line, col] = values[flat]
            mask[line, col] = True
            yield split, own, used, x, mask


class Sums:
    """A task's ability sums and its items' largest step, per (split, D)."""

    def __init__(self, sent, dims: list, update: int, priors):
        self.thetas, self.active = sent.value
        self.dims, self.update, self.priors = dims, update, priors
        self.of: dict[tuple, list] = {}

    def add(self, split, used, x, mask, par) -> np.ndarray:
        """New parameters of the items; their answers enter the sums."""
        par = par.copy()
        for d, where in zip(self.dims, par_columns(self.dims)):
            key = split, d
            if key not in self.active:
                continue
            was = par[:, where]
            a, beta = was[:, :d], was[:, d]
            theta = self.thetas[key][used]
            for _ in range(self.update):
                a, beta = item_step(a, beta, theta, x, mask, self.priors)
            now = np.column_stack([a, beta])
            total = self.of.setdefault(key, [np.zeros((len(self.thetas[key]), d + d * d)), 0.0])
            total[0][used] += ability_sums(a, beta, theta, x, mask)
            total[1] = max(total[1], float(np.abs(now - was).max()))
            par[:, where] = now
        return par

    def parts(self) -> Iterator[tuple]:
        """((split, D, block of models), (sums, step))."""
        for (split, d), (total, step) in self.of.items():
            for lo in range(0, len(total), MODEL_BLOCK):
                yield (split, d, lo // MODEL_BLOCK), (total[lo:lo + MODEL_BLOCK], step)


def _round(rows: DataFrame, dims: list, sent, update: int, priors) -> DataFrame:
    """New item parameters (rows with ``par``) and each task's ability sums (rows with ``sums``).

    ``par`` holds (a_1..a_D, beta) of every D one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(sent, dims, update, priors)
        for batch in batches:
            if not batch.num_rows:
                continue
            par = _parameters(batch, dims)
            for split, own, *answers in _answers(batch):
                par[own] = sums.add(split, *answers, par[own])
            if update:
                known = batch.column("split_id").is_valid()
                yield _out(known.true_count, split_id=batch.column("split_id").filter(known),
                           item_id=batch.column("item_id").cast(pa.int64()).filter(known), par=_lists(par[known.to_numpy(zero_copy_only=False)]))
        for (split, d, block), (total, step) in sums.parts():
            yield _out(1, split_id=pa.array([split], pa.string()), dims=pa.array([d], pa.int32()), block=pa.array([block], pa.int32()),
                       sums=pa.array([total.ravel()], OUT_TYPES["sums"]), step=pa.array([step]))
    return rows.mapInArrow(run, OUT)


def _parameters(batch: pa.RecordBatch, dims: list) -> np.ndarray:
    old = batch.column("par")
    if old.null_count:
        return np.concatenate([np.r_[np.ones(d), 0.0] for d in dims])[None].repeat(batch.num_rows, 0)
    return old.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).copy()


# ------------------------------------------------------------------ rounds on blocks
def _blocks(rows: DataFrame, dims: list) -> RDD:
    """Rows with answers and parameters as blocks (split, items, models, x, mask, par)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            par, item = _parameters(batch, dims), batch.column("item_id").to_numpy(zero_copy_only=False)
            for split, own, *answers in _answers(batch):
                yield pa.RecordBatch.from_pydict({"block": [pickle.dumps((split, item[own], *answers, par[own]))]})
    return rows.select("split_id", "item_id", "m", "x", "par").mapInArrow(pack, "block binary").rdd.map(lambda r: (None, pickle.loads(r[0])))


def _block_round(blocks: RDD, dims: list, sent, update: int, priors) -> RDD:
    """(None, block) with new parameters, and each task's sums as ``Sums.parts``."""
    def run(held: Iterator[tuple]) -> Iterator[tuple]:
        sums = Sums(sent, dims, update, priors)
        for key, block in held:
            if key is None:
                par = sums.add(block[0], *block[2:])
                if update:
                    yield None, (*block[:5], par)
        yield from sums.parts()
    return blocks.mapPartitions(run, preservesPartitioning=True)


def _block_parameters(spark: SparkSession, blocks: RDD) -> DataFrame:
    """(split_id, item_id, par) of the blocks."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block").to_pylist():
                split, item, par = pickle.loads(data)
                yield pa.RecordBatch.from_arrays([pa.array([split] * len(item), pa.string()), pa.array(item, pa.int64()), _lists(par)],
                                                 names=["split_id", "item_id", "par"])
    packed = blocks.filter(lambda b: b[0] is None).map(lambda b: (pickle.dumps((b[1][0], b[1][1], b[1][5])),))
    return spark.createDataFrame(packed, "block binary").mapInArrow(unpack, "split_id string, item_id bigint, par array<double>")


def _uncut(spark: SparkSession, path: str | None) -> None:
    """Delete a checkpoint that a later one replaces."""
    if path is not None:
        context = spark.sparkContext
        old = context._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)


def _table_parts(done: DataFrame) -> RDD:
    """A table round's sums as ``Sums.parts``."""
    return done.where("sums is not null").select("split_id", "dims", "block", "sums", "step").rdd.map(
        lambda r: ((r.split_id, r.dims, r.block), (np.array(r.sums).reshape(-1, r.dims + r.dims ** 2), r.step)))


def _solved(parts: RDD, thetas: dict, sd: float | None, buckets: int) -> dict:
    """A round's sums -> (new abilities, largest step) per (split, D); one row a part or, of many, a block of models goes to the driver."""
    def plus(p, q):
        return p[0] + q[0], max(p[1], q[1])
    if buckets > FAN_IN:
        parts = parts.reduceByKey(plus, min(FAN_IN, buckets))
    blocks: dict = {}
    # in an order of their own, so that runs add the same numbers alike
    for key, part in sorted(parts.collect(), key=lambda p: (p[0], p[1][0].tobytes())):
        blocks[key] = plus(blocks[key], part) if key in blocks else part
    out: dict = {}
    for key in {k[:2]: None for k in blocks}:
        own = [blocks[k] for k in sorted(k for k in blocks if k[:2] == key)]
        step = ability_step(thetas[key], np.concatenate([total for total, _ in own]), sd)
        out[key] = thetas[key] + step, max(float(np.abs(step).max()), max(largest for _, largest in own))
    return out


def _check(n_models: int, dims: list) -> None:
    need = 8 * n_models * sum(d + d * d for d in dims)
    if need > ABILITY_BYTES:
        raise ValueError(f"abilities of {n_models} models need {need} bytes in every task, more than {ABILITY_BYTES}")


def _first_thetas(responses: DataFrame, models: DataFrame, dims: list) -> dict:
    """Start: dimension 0 the standardised share of right answers, the others a repeatable spread."""
    share = responses.groupBy("split_id", "model_id").agg(F.avg("x").alias("f")).join(models, ["split_id", "model_id"])
    pdf = share.select("split_id", "m", "f").toPandas().sort_values(["split_id", "m"])
    out = {}
    for split, g in pdf.groupby("split_id"):
        f = g["f"].to_numpy(float)
        z = (f - f.mean()) / max(f.std(), 1e-6)
        for d in dims:
            more = np.random.Generator(np.random.PCG64(d)).normal(size=(len(f), d - 1)) * 0.5
            out[split, d] = np.column_stack([z, more])
    return out


def _frame(spark: SparkSession, thetas: dict, models: DataFrame) -> DataFrame:
    rows = [(s, d, m, t.tolist()) for (s, d), theta in thetas.items() for m, t in enumerate(theta)]
    found = spark.createDataFrame(rows, "split_id string, dims int, m int, theta array<double>")
    return models.join(found, ["split_id", "m"]).select("split_id", "dims", "model_id", "theta")


def _orient(items: DataFrame, thetas: dict) -> DataFrame:
    """Mean discrimination positive in every dimension; thetas are flipped in place."""
    means = (items.select("split_id", "dims", F.posexplode("a").alias("k", "v")).groupBy("split_id", "dims", "k")
             .agg(F.avg("v").alias("v")).where("v < 0").collect())     # splits x dimensions
    signs = {key: np.ones(key[1]) for key in thetas}
    for r in means:
        signs[r.split_id, r.dims][r.k] = -1.0
        thetas[r.split_id, r.dims][:, r.k] *= -1.0
    table = items.sparkSession.createDataFrame([(s, d, v.tolist()) for (s, d), v in signs.items()],
                                               "split_id string, dims int, sign array<double>")
    return items.join(F.broadcast(table), ["split_id", "dims"]).withColumn(
        "a", F.zip_with("a", "sign", lambda x, s: x * s)).drop("sign")


def fit_grid(responses: DataFrame, dims, rounds: int = 200, tol: float = 1e-3, theta_sd: float = 1.0,
             a_mean: float = 1.0, a_sd: float = 1.0, b_sd: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """I4 for every D of ``dims`` and every split at once: 2PL by alternating MAP Newton steps.

    responses(split_id?, model_id, item_id, resp); a missing answer is a missing row.  ``dims`` may be a dict
    split_id -> D: then every split named there is fitted with its own D only, and other splits are left out.
    Returns items(split_id?, dims, item_id, a, b), abilities(split_id?, dims, model_id, theta);
    only sum b_d matters, it is spread evenly."""
    own = dims if isinstance(dims, dict) else None
    if own is not None:
        responses = responses.where(F.col("split_id").isin(list(own)))
    dims = sorted({int(d) for d in (dims if own is None else own.values())})
    keys = ["split_id"] if "split_id" in responses.columns else []
    spark = responses.sparkSession
    resp = written_table(_with_split(responses).select("split_id", "model_id", "item_id", F.col("resp").cast("double").alias("x")))
    models = written_table(model_index(resp))
    _check(models.count(), dims)
    buckets = _buckets(resp.count(), spark.sparkContext.defaultParallelism)
    rows = Bucketed(by_item(resp, models), buckets)
    thetas = {key: theta for key, theta in _first_thetas(resp, models, dims).items() if own is None or own[key[0]] == key[1]}
    drop_table(resp)
    active, table, blocks, cut = set(thetas), None, None, None
    priors = a_mean, a_sd, b_sd
    for r in range(rounds):
        if not active:
            break
        sent, last = spark.sparkContext.broadcast((thetas, active)), blocks
        if r == 0:
            held = rows.read().sortWithinPartitions("split_id", "item_id").withColumn("par", F.lit(None).cast("array<double>"))
        elif r <= TABLE_ROUNDS:
            held = rows.read().join(table.read().where("par is not null").select("split_id", "item_id", "par").hint("merge"), ["split_id", "item_id"])
        if r < TABLE_ROUNDS:
            done = Bucketed(_round(held, dims, sent, 2, priors), buckets)
            if table is not None:
                table.drop()
            table, parts = done, _table_parts(done.read())
        else:
            blocks = _block_round(_blocks(held, dims) if blocks is None else blocks, dims, sent, 2, priors).persist(StorageLevel.MEMORY_AND_DISK)
            if (r - TABLE_ROUNDS) % CUT_EVERY == CUT_EVERY - 1:
                blocks.checkpoint()
            parts = blocks.filter(lambda b: b[0] is not None)
        for key, (theta, step) in _solved(parts, thetas, theta_sd, buckets).items():
            thetas[key] = theta
            if step < tol:
                active = active - {key}
        if last is not None:
            last.unpersist()
        if blocks is not None and blocks.getCheckpointFile() is not None:
            _uncut(spark, cut)
            cut = blocks.getCheckpointFile()
    index = F.explode(F.array(*[F.struct(F.lit(at.start).alias("at"), F.lit(d).alias("dims")) for d, at in zip(dims, par_columns(dims))]))
    par = table.read().where("par is not null").select("split_id", "item_id", "par") if blocks is None else _block_parameters(spark, blocks)
    items = par.select("split_id", "item_id", "par", index.alias("i")).select(
        "split_id", "item_id", "i.dims", F.slice("par", F.col("i.at") + 1, F.col("i.dims") + 1).alias("v"))
    if own is not None:
        items = items.where(F.create_map(*[F.lit(v) for pair in own.items() for v in pair])[F.col("split_id")] == F.col("dims"))
    items = written_table(items.select(
        "split_id", "dims", "item_id", F.slice("v", 1, F.col("dims")).alias("a"),
        F.array_repeat(F.element_at("v", -1) / F.col("dims"), F.col("dims")).alias("b")))
    if blocks is not None:
        blocks.unpersist()
    _uncut(spark, cut)
    rows.drop()
    table.drop()
    items = _orient(items, thetas)
    abilities = _frame(spark, thetas, models)
    return (items.select(*keys, "dims", "item_id", "a", "b"), abilities.select(*keys, "dims", "model_id", "theta"))


def abilities_grid(responses: DataFrame, items: DataFrame, rounds: int = 50, tol: float = 1e-6,
                   prior_sd: float | None = 3.0) -> DataFrame:
    """I3 for every D at once: abilities of the models from their answers, item parameters fixed.

    responses(split_id?, model_id, item_id, resp); items(split_id?, dims, item_id, a, b)."""
    keys = ["split_id"] if "split_id" in responses.columns else []
    spark = responses.sparkSession
    resp = written_table(_with_split(responses).select("split_id", "model_id", "item_id", F.col("resp").cast("double").alias("x")))
    models = written_table(model_index(resp))
    beta = F.aggregate("b", F.lit(0.0), lambda s, v: s + v)
    par = _with_split(items).groupBy("split_id", "item_id").agg(F.array_sort(F.collect_list(F.struct(
        "dims", F.concat("a", F.array(beta)).alias("v")))).alias("p"))
    par = par.select("split_id", "item_id", F.flatten(F.transform("p", lambda r: r["v"])).alias("par"))
    dims = sorted(r.dims for r in items.select("dims").distinct().collect())
    _check(models.count(), dims)
    buckets = _buckets(resp.count(), spark.sparkContext.defaultParallelism)
    # as many files as buckets: a small table would else be one file, which a single task steps through every round
    rows = written_table(by_item(resp, models).join(par, ["split_id", "item_id"]).repartition(buckets, "split_id", "item_id"))
    drop_table(resp)
    blocks = _blocks(rows, dims).persist(StorageLevel.MEMORY_AND_DISK)
    per = models.groupBy("split_id").count().collect()
    thetas = {(r.split_id, d): np.zeros((r["count"], d)) for r in per for d in dims}
    active = set(thetas)
    for _ in range(rounds):
        if not active:
            break
        sent = spark.sparkContext.broadcast((thetas, active))
        for key, (theta, step) in _solved(_block_round(blocks, dims, sent, 0, None), thetas, prior_sd, buckets).items():
            thetas[key] = theta
            if step < tol:
                active = active - {key}
    blocks.unpersist()
    return _frame(spark, thetas, models).select(*keys, "dims", "model_id", "theta")
