"""Clustering anchors (L8-L10): weighted k-means of many cells in one plan.

Each item is a point whose coordinates are the train models' scores on it
(L8) or its IRT parameters [a; b] (L10), weighted by its normalised balance
weight.  A *cell* is one fit: (split and feature space, scenario, n_items,
iteration, restart).
All cells of all scenarios are fitted together:

* items are packed into blocks of at most ``BLOCK_ITEMS`` points of one
  scenario, written once;
* one Lloyd round is one job that writes nothing: every task reads its blocks,
  which Spark keeps (memory, then disk), and the centres, sums weight x point per
  (cell, cluster) over all its blocks, and the sums are added per cell.  Blocks never meet, so no item or scenario is
  hot.  Nearest centres come from matrix products; a point whose two nearest
  are closer to a tie than the products' rounding is decided by differences;
* a cell carries the sum of a hash of (point, cluster) over its points; it is
  finished when that sum stays, as then no point has moved;
* the centres (cells x n_items x coordinates) are the only data sent to all
  tasks.  Cells are dealt into waves of at most ``WAVE_BYTES`` of centres, so
  the size sent and collected is bounded whatever the grid (one fit larger
  than that is a wave of its own).

Starts are drawn without replacement with chances proportional to the weights
(md5 keys of 1000 * restart + iteration).  A cluster left without items moves
to the point farthest from its centre.  The restart of lowest inertia wins;
its anchors are the items nearest the centres (lower position on ties) and an
anchor weighs what its cluster's items weigh (L9).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.functions import hex_uniform
from itemscope.session import drop_table, written_table

BLOCK_ITEMS = 1024
WAVE_BYTES = 32 << 20
MAX_ROUNDS = 300
#: Parts of a cell that one task adds up.
FAN_IN = 64
CELL = ["split_id", "scenario", "n_items", "iter", "restart"]
SPACE = "\x1f"


def score_features(train_scores: DataFrame, models: DataFrame) -> DataFrame:
    """L8 input: per item (and split) the vector of train-model scores in model order.

    train_scores(split_id?, model_id, item_id, score); models(split_id?, model_id, model_pos).
    A row holds one value per train model (bounded by the model count)."""
    keys = ["split_id"] if "split_id" in train_scores.columns and "split_id" in models.columns else []
    j = train_scores.select(*keys, "model_id", "item_id", "score").join(
        F.broadcast(models.select(*keys, "model_id", "model_pos")), [*keys, "model_id"])
    g = j.groupBy(*keys, "item_id").agg(F.array_sort(F.collect_list(F.struct("model_pos", "score"))).alias("_s"))
    return g.select(*keys, "item_id", F.transform("_s", lambda s: s["score"].cast("double")).alias("vec"))


def irt_features(item_params: DataFrame) -> DataFrame:
    """L10 input: per item (and split) [a_1..a_D, b_1..b_D]."""
    keys = ["split_id"] if "split_id" in item_params.columns else []
    return item_params.select(*keys, "item_id", F.concat("a", "b").alias("vec"))


# ------------------------------------------------------------------ numpy steps of a block
def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, points x centres, by differences (no cancellation) in slices."""
    out = np.empty((len(x), len(centres)))
    step = max(1, (1 << 21) // max(1, centres.size))
    for lo in range(0, len(x), step):
        out[lo:lo + step] = np.sqrt(((x[lo:lo + step, None, :] - centres[None]) ** 2).sum(2))
    return out


def _squares(x: np.ndarray, centres: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, points x centres, by products, and how far those of each point may be off."""
    own = (x * x).sum(1) if own is None else own
    theirs = (centres * centres).sum(1)
    off = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (own + theirs.max(initial=0.0))
    d = x @ centres.T
    d *= -2
    d += theirs
    d += own[:, None]
    return d, off


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre of every point (the first of equal ones), its distance, and what every other is away at least."""
    d, off = _squares(x, centres)
    line = np.arange(len(x))
    at = d.argmin(1)
    least = d[line, at]
    d[line, at] = np.inf
    second = d.min(1) if d.shape[1] > 1 else np.full(len(x), np.inf)
    own, other = np.sqrt(((x - centres[at]) ** 2).sum(1)), np.sqrt(np.maximum(second - off, 0.0))
    close = np.flatnonzero(second <= least + 2 * off)
    if len(close):
        exact = _distances(x[close], centres)
        line = np.arange(len(close))
        at[close] = exact.argmin(1)
        own[close] = exact[line, at[close]]
        exact[line, at[close]] = np.inf
        other[close] = exact.min(1)
    return at.astype(np.int32), own, other


def _reassign(x: np.ndarray, centres: np.ndarray, state: dict | None, shift: np.ndarray | None) -> tuple[dict, int]:
    """Clusters and bounds of a block's points for one cell, and how many points changed cluster."""
    n = len(x)
    if state is None:
        at, upper, lower, todo = np.full(n, -1, np.int32), np.empty(n), np.empty(n), np.arange(n)
    else:
        at = state["at"].copy()
        upper = state["upper"] + shift[at]
        # the other centres came nearer by at most the largest shift
        lower = state["lower"] - (shift.max() if len(shift) else 0.0)
        todo = np.flatnonzero(upper > lower)
        if len(todo):
            upper[todo] = np.sqrt(((x[todo] - centres[at[todo]]) ** 2).sum(1))
            todo = todo[upper[todo] > lower[todo]]
    moved = 0
    if len(todo):
        best, own, other = _nearest(x[todo], centres)
        moved = int((best != at[todo]).sum())
        at[todo], upper[todo], lower[todo] = best, own, other
    return {"at": at, "upper": upper, "lower": lower}, moved


def _assigned(x: np.ndarray, own: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Nearest centre of every point (the first of equal ones), the point farthest from its own and its distance.

    ``own`` are the points' squared lengths.  Distances by differences are taken only where products do not decide."""
    d, off = _squares(x, centres, own)
    line = np.arange(len(x))
    at = d.argmin(1)
    least = d[line, at]
    if not np.isfinite(least).all():    # a coordinate is unknown
        got, _ = _reassign(x, centres, None, None)
        far = int(got["upper"].argmax())
        return got["at"], far, float(got["upper"][far])
    d[line, at] = np.inf
    close = np.flatnonzero(d.min(1) <= least + 2 * off)
    if len(close):
        at[close] = _distances(x[close], centres).argmin(1)
    far = np.flatnonzero(least + off >= (least - off).max())
    upper = np.sqrt(((x[far] - centres[at[far]]) ** 2).sum(1))
    return at.astype(np.int32), int(far[upper.argmax()]), float(upper.max())


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that sums of hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _mark(mixed: np.ndarray, at: np.ndarray) -> int:
    """A sum over the points (mixed positions) that stays only while every point keeps its cluster."""
    with np.errstate(over="ignore"):
        return int(_mixed(mixed + at.astype(np.uint64)).sum(dtype=np.uint64).view(np.int64))


# ------------------------------------------------------------------ the plan
def _points(features: DataFrame, items: DataFrame) -> DataFrame:
    """One row per point: split_id (with the feature space behind it, '' when there is neither), scenario,
    item, weight, vec."""
    it = items.select("item_id", "item_pos", "scenario", "bal_w").join(features, "item_id")
    it = it.withColumn("split_id", F.concat_ws(SPACE, *[c for c in ("split_id", "sampling") if c in features.columns]))
    tot = items.groupBy("scenario").agg(F.sum("bal_w").alias("_tot"))   # one row per scenario
    return it.join(F.broadcast(tot), "scenario").select(
        "split_id", "scenario", "item_id", "item_pos", (F.col("bal_w") / F.col("_tot")).alias("nbw"), "vec")


def _blocks(points: DataFrame) -> DataFrame:
    """Points packed by position: a group holds at most BLOCK_ITEMS positions."""
    key = F.floor(F.col("item_pos") / BLOCK_ITEMS)
    return points.groupBy("split_id", "scenario", key.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("item_pos", "item_id", "nbw", "vec"))).alias("p")).select(
        "split_id", "scenario", "block", F.transform("p", lambda r: r["item_id"]).alias("item_id"),
        F.transform("p", lambda r: r["item_pos"]).alias("item_pos"),
        F.transform("p", lambda r: r["nbw"]).alias("w"), F.transform("p", lambda r: r["vec"]).alias("x"))


def _dealt(blocks: DataFrame) -> DataFrame:
    """The blocks written, in a file for every core at least: a small table would else be one file, and every round one task."""
    table = written_table(blocks)
    cores = min(table.sparkSession.sparkContext.defaultParallelism, table.count())
    if table.rdd.getNumPartitions() >= cores:
        return table
    spread = written_table(table.repartitionByRange(cores, "split_id", "scenario", "block"))
    drop_table(table)
    return spread


def _starts(points: DataFrame, cells: DataFrame) -> dict:
    """Starting centres of every cell: its first n_items points by the key -ln(u) / weight."""
    largest = cells.groupBy("split_id", "scenario", "iter", "restart").agg(F.max("n_items").alias("top"))
    u = hex_uniform(F.col("restart") * 1000 + F.col("iter"), F.lit("start"), F.col("item_id"))
    drawn = points.join(F.broadcast(largest), ["split_id", "scenario"]).withColumn(
        "key", -F.log(u + F.lit(2.0 ** -33)) / F.greatest("nbw", F.lit(1e-300)))
    w = Window.partitionBy("split_id", "scenario", "iter", "restart").orderBy("key", "item_pos")
    bound = cells.agg(F.max("n_items")).first()[0]
    ranked = drawn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= bound).where("rank <= top")
    # every n_items of one (iteration, restart) starts from a prefix of the same draw
    per = ranked.join(F.broadcast(cells), ["split_id", "scenario", "iter", "restart"]).where("rank <= n_items")
    rows = per.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("rank", "vec"))).alias("c")).select(
        *CELL, F.transform("c", lambda r: r["vec"]).alias("c")).collect()   # bounded by the wave
    return {tuple(r[k] for k in CELL): np.array(r.c, float) for r in rows}


def _kept(blocks: DataFrame) -> RDD:
    """Blocks as ((split_id, scenario), positions, weights, points), kept by Spark (memory, then disk) for all rounds."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = zip(batch.column("split_id").to_pylist(), batch.column("scenario").to_pylist())
            for i, key in enumerate(names):
                points = batch.column("x")[i].values
                x = points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)
                w, pos = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("w", "item_pos"))
                yield pa.RecordBatch.from_pydict({"block": [pickle.dumps((key, pos, w, x))]})
    packed = blocks.select("split_id", "scenario", "item_pos", "w", "x").mapInArrow(pack, "block binary")
    return packed.rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _round(kept: RDD, centres, cells: list) -> RDD:
    """One Lloyd round: the task's sums of every cell of ``centres``, as (cell, [sums, mark, (distance, farthest point)])."""
    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        now = centres.value
        of: dict[tuple, list] = {}
        for c in sorted(now):
            of.setdefault(cells[c][:2], []).append(c)
        sums: dict[int, list] = {}
        for key, pos, w, x in blocks:
            if key not in of:
                continue
            weighed = np.column_stack([x * w[:, None], w])
            length, mixed = (x * x).sum(1), _mixed(pos.astype(np.uint64))
            for c in of[key]:
                size, dims = now[c].shape
                at, far, away = _assigned(x, length, now[c])
                total = sums.setdefault(c, [np.zeros((size, dims + 1)), 0, (-1.0, x[0])])
                # 16-bit numbers are sorted by radix
                order = np.argsort(at.astype(np.int16) if size < 1 << 15 else at, kind="stable")
                placed = at[order]
                first = np.flatnonzero(np.r_[True, placed[1:] != placed[:-1]])
                total[0][placed[first]] += np.add.reduceat(weighed[order], first)
                total[1] = _wrapped(total[1] + _mark(mixed, at))
                total[2] = max(total[2], (away, x[far]), key=lambda t: t[0])
        yield from sums.items()
    return kept.mapPartitions(run)


def _wrapped(total: int) -> int:
    """Modulo 2^64, as a signed number."""
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


def _plus(p: list, q: list) -> list:
    return [p[0] + q[0], _wrapped(p[1] + q[1]), max(p[2], q[2], key=lambda t: t[0])]


def _added(parts: RDD, tasks: int, size: int) -> dict:
    """Sums of the cells over the tasks.  ``size`` bytes of every task go to the driver together when they fit a wave;
    else they are added by cell first, those of many tasks in two steps, and one row a cell goes to the driver."""
    if tasks * size > WAVE_BYTES:
        cores = parts.context.defaultParallelism
        if tasks > FAN_IN:
            parts = parts.mapPartitionsWithIndex(lambda i, rows: (((c, i % FAN_IN), v) for c, v in rows)).reduceByKey(_plus, cores).map(
                lambda r: (r[0][0], r[1]))
        parts = parts.reduceByKey(_plus, cores)
    out: dict = {}
    for c, part in parts.collect():
        out[c] = _plus(out[c], part) if c in out else part
    return out


def lloyd(blocks: DataFrame, starts: dict, max_rounds: int = MAX_ROUNDS) -> dict:
    """Centres of every cell of ``starts`` after Lloyd rounds until no point of the cell moves."""
    sc = blocks.sparkSession.sparkContext
    cells = sorted(starts)
    centres = {c: starts[key] for c, key in enumerate(cells)}
    active, marks = sorted(centres), {}
    kept = _kept(blocks)
    tasks = kept.getNumPartitions()
    for _ in range(max_rounds):
        now = {c: centres[c] for c in active}
        sent = sc.broadcast(now)
        added, active = _added(_round(kept, sent, cells), tasks, sum(c.nbytes for c in now.values())), []
        sent.unpersist()
        for c, (total, mark, (away, far)) in sorted(added.items(), key=lambda cell: cell[0]):
            weight = total[:, -1]
            new = np.where(weight[:, None] > 0, total[:, :-1] / np.maximum(weight, 1e-300)[:, None], centres[c])
            moved = marks.get(c) != mark
            empty = np.flatnonzero(weight <= 0)
            if len(empty) and away > 0:
                new[empty[0]] = far
                moved = True
            known = not np.isnan(new - centres[c]).any()    # a cell with unknown coordinates stays as it is
            centres[c], marks[c] = new, mark
            if moved and known:
                active.append(c)
        if not active:
            break
    kept.unpersist()
    return {key: centres[c] for c, key in enumerate(cells)}


def cell_clusters(blocks: DataFrame, centres: dict) -> DataFrame:
    """(CELL, cluster, weight, inertia, nearest STRUCT(d, item_pos, item_id)) with exact distances.

    A task sends one row per cell and cluster, whatever its number of items."""
    sent = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                x, w = np.array(r.x.tolist(), float), np.asarray(r.w, float)
                for key, c in sent.value.items():
                    if key[:2] != (r.split_id, r.scenario):
                        continue
                    d = _distances(x, c)
                    at = d.argmin(1)
                    weight = np.bincount(at, w, len(c))
                    inertia = np.bincount(at, w * d[np.arange(len(x)), at] ** 2, len(c))
                    near = np.round(d, 12).argmin(0)   # positions ascend within a block
                    for j, i in enumerate(near):
                        best = (round(float(d[i, j]), 12), int(r.item_pos[i]), int(r.item_id[i]))
                        had = found.setdefault((*key, j), [0.0, 0.0, best])
                        had[0] += weight[j]
                        had[1] += inertia[j]
                        had[2] = min(had[2], best)
        if found:
            yield pd.DataFrame([(*k, v[0], v[1], *v[2]) for k, v in found.items()],
                               columns=[*CELL, "cluster", "weight", "inertia", "d", "item_pos", "item_id"])
    schema = ("split_id string, scenario string, n_items int, iter int, restart int, cluster int, weight double, "
              "inertia double, d double, item_pos bigint, item_id bigint")
    return blocks.mapInPandas(run, schema).groupBy(*CELL, "cluster").agg(
        F.sum("weight").alias("weight"), F.sum("inertia").alias("inertia"),
        F.min(F.struct("d", "item_pos", "item_id")).alias("nearest"))


def _waves(cells: list, dims: int) -> list[list]:
    waves, size = [[]], 0
    for c in cells:
        own = 8 * c[2] * dims
        if waves[-1] and size + own > WAVE_BYTES:
            waves.append([])
            size = 0
        waves[-1].append(c)
        size += own
    return waves


def kmeans_anchors(features: DataFrame, items: DataFrame, n_items_grid, iters: int = 1,
                   restarts: int = 5, sampling: str = "anchor", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """L8/L9 (L10 with IRT features): selections
    (split_id?, sampling, n_items, iter, scenario, item_id, item_pos, weight).

    ``features(split_id?, sampling?, item_id, vec)``: rows that carry ``sampling`` belong to that feature
    space, and all spaces are fitted in the same rounds.  A cell that asks for at least as many
    items as its scenario has gets them all with their own weights.  Two clusters
    with the same nearest item keep it twice, each with its own weight."""
    spark = items.sparkSession
    points = written_table(_points(features, items))
    sizes = {(r.split_id, r.scenario): r["count"] for r in points.groupBy("split_id", "scenario").count().collect()}
    grid = [int(n) for n in dict.fromkeys(n_items_grid)]
    whole = [(*g, n, i) for g in sizes for n in grid if n >= sizes[g] for i in range(iters)]
    cells = [(*g, n, i, t) for g in sorted(sizes) for n in grid if n < sizes[g] for i in range(iters) for t in range(restarts)]
    parts_of = F.split("split_id", SPACE)
    spaces = "sampling" in features.columns
    keys = [F.element_at(parts_of, 1).alias("split_id")] if "split_id" in features.columns else []
    name = F.element_at(parts_of, -1) if spaces else F.lit(sampling)
    out_cols = [*keys, name.alias("sampling"), "n_items", "iter", "scenario", "item_id", "item_pos", "weight"]
    parts = []
    if whole:
        every = spark.createDataFrame(whole, "split_id string, scenario string, n_items int, iter int")
        parts.append(points.withColumnRenamed("nbw", "weight").join(F.broadcast(every), ["split_id", "scenario"]).select(*out_cols))
    if cells:
        blocks = _dealt(_blocks(points))
        dims = points.agg(F.max(F.size("vec"))).first()[0]
        clusters = None
        for wave in _waves(cells, dims):
            table = spark.createDataFrame(wave, "split_id string, scenario string, n_items int, iter int, restart int")
            found = written_table(cell_clusters(blocks, lloyd(blocks, _starts(points, table), max_rounds)))
            clusters = found if clusters is None else clusters.unionByName(found)
        fit = [c for c in CELL if c != "restart"]
        won = (clusters.groupBy(*CELL).agg(F.sum("inertia").alias("inertia")).groupBy(*fit)
               .agg(F.min(F.struct(F.round("inertia", 12).alias("i"), "restart"))["restart"].alias("restart")))
        parts.append(clusters.join(won, CELL).select("*", "nearest.item_id", "nearest.item_pos").select(*out_cols))
    if not parts:
        return points.withColumns({"n_items": F.lit(0), "iter": F.lit(0), "weight": F.lit(0.0)}).select(*out_cols).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
