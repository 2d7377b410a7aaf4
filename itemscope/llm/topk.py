"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum over ``slices`` blocks of dimensions, each a list of its own.

1. gather: every row block sends the best ``k`` entries of each list for each
   query; their exact scores give a cutoff that k candidates reach;
2. the cutoff goes to every row block with the query.  A vector whose score
   reaches it has, in at least one list, a partial score of cutoff / slices or
   more: only those entries are collected;
3. collected entries whose known partial scores plus the threshold for each
   unknown list can still reach the cutoff are resolved exactly.

Work runs in blocks of rows against blocks of queries (a stated query set).
Equal vectors are one candidate with its k + 1 smallest ids, so a very common
vector costs one candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.llm.common import stash

ROWS, QUERIES = 4096, 512
_LONG = 2**63 - 1


def quantise(table: DataFrame, scale: int = 1024) -> DataFrame:
    """``(vec_id, vec)``: floor(scale * x) of each component as array<bigint>; invalid vectors are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
            .select(F.col("vec_id").cast("bigint"), F.transform(x, lambda v: F.floor(v * scale)).alias("vec")))


def _pack(size: int, width: int, first: str):
    """Rows (id, vec) -> blocks (block, ids, data), at most ``size`` rows each."""
    def run(batches):
        ids, vecs = [], []
        part = 0
        def block():
            m = np.zeros((len(ids), width), np.int64)
            for i, v in enumerate(vecs):
                m[i, :len(v)] = v
            return pa.RecordBatch.from_arrays(
                [pa.array([list(ids)], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "data"])
        for batch in batches:
            col = batch.column("vec")
            off, flat = col.offsets.to_numpy(), col.flatten().to_numpy()
            off = off - off[0]
            for i, x in enumerate(batch.column(first).to_pylist()):
                ids.append(x), vecs.append(flat[off[i]:off[i + 1]])
                if len(ids) == size:
                    yield block()
                    ids, vecs, part = [], [], part + 1
        if ids:
            yield block()
    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T; beyond 64 bits the nearest long."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def _matrices(batch: pa.RecordBatch, i: int, width: int):
    rows = np.array(batch.column("ids")[i].as_py(), np.int64)
    query = np.array(batch.column("qids")[i].as_py(), np.int64)
    a = np.frombuffer(batch.column("data")[i].as_py(), np.int64).reshape(len(rows), width)
    b = np.frombuffer(batch.column("qdata")[i].as_py(), np.int64).reshape(len(query), width)
    return rows, query, a, b


def _entries(q, r, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (q, r, s)],
                                      names=["query_id", "cid", "score"])


def _gather(width: int, cuts: list[int], k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, query, a, b = _matrices(batch, i, width)
                total = _products(b, a)
                q, r, s = [], [], []
                for lo, hi in zip(cuts, cuts[1:]):
                    part = _products(b[:, lo:hi], a[:, lo:hi])
                    n = min(k + 1, len(rows))
                    best = np.argpartition(-part, n - 1, axis=1)[:, :n]
                    q.append(np.repeat(query, n)), r.append(rows[best].ravel())
                    s.append(np.take_along_axis(total, best, 1).ravel())
                yield _entries(q, r, s)
    return run


def _collect(width: int, cuts: list[int]):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, query, a, b = _matrices(batch, i, width)
                cutoff = np.array(batch.column("cutoff")[i].as_py(), np.float64)
                m = len(cuts) - 1
                least = (cutoff / m)[:, None]
                known, missing = np.zeros((len(query), len(rows))), np.zeros((len(query), len(rows)), np.int8)
                for lo, hi in zip(cuts, cuts[1:]):
                    part = _products(b[:, lo:hi], a[:, lo:hi])
                    sent = part >= least
                    known += np.where(sent, part, 0)
                    missing += ~sent
                able = (missing < m) & (known + missing * least >= cutoff[:, None] - 1)
                at, of = np.nonzero(able)
                exact = np.zeros(len(at), np.int64)
                for j in np.unique(at):  # the remaining scores, for the survivors only
                    mine = at == j
                    exact[mine] = _products(a[of[mine]], b[j:j + 1])[:, 0]
                keep = exact >= cutoff[at]
                if keep.any():
                    yield _entries([query[at[keep]]], [rows[of[keep]]], [exact[keep]])
    return run


def _best(scored: DataFrame, twins: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: candidates' ids, own id left out, ties to the smaller id."""
    every = (scored.join(twins, "cid").select("query_id", F.explode("twins").alias("vec_id"), "score")
             .where("vec_id <> query_id"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, slices: int = 4) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest inner products among ``vectors``.

    Both tables hold ``(vec_id, vec)`` with array<bigint> vectors; a shorter
    vector counts as padded with zeros.  The row with the query's own id is no
    candidate.  Ties go to the smaller id; fewer candidates give fewer rows.
    Repeated rows (same id and vector) count once.  Empty tables give an empty
    result.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("vec is not null")
    first = Window.partitionBy("vec").orderBy("vec_id")
    classes = stash(vectors.distinct().withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)
                    .groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("twins"))
                    .select(F.element_at("twins", 1).alias("cid"), "vec", "twins"))
    ask = stash(queries.where("vec is not null").dropDuplicates(["vec_id"]).select("vec_id", "vec"))
    width = max([0] + [r[0] or 0 for r in (classes.agg(F.max(F.size("vec"))).first(), ask.agg(F.max(F.size("vec"))).first())])
    m = max(1, min(slices, width))
    cuts = [width * i // m for i in range(m + 1)]
    blocks = classes.select("cid", "vec").mapInArrow(_pack(ROWS, width, "cid"), "ids array<bigint>, data binary")
    packed = ask.repartition(8).mapInArrow(_pack(QUERIES, width, "vec_id"), "qids array<bigint>, qdata binary")
    asked = stash(packed.withColumn("qb", F.monotonically_increasing_id()))
    names = asked.agg(F.sort_array(F.collect_list("qb"))).first()[0]  # one id per block of queries
    if not names:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pairs = stash(blocks).withColumn("qb", F.explode(F.array(*[F.lit(n) for n in names])))
    entry = "query_id bigint, cid bigint, score bigint"
    gathered = pairs.join(asked, "qb").mapInArrow(_gather(width, cuts, k), entry).distinct()
    twins = classes.select("cid", "twins")
    cutoff = stash(_best(gathered, twins, k).groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).alias("cutoff")))
    each = (asked.select("qb", F.posexplode("qids").alias("pos", "query_id")).join(cutoff, "query_id", "left")
            .select("qb", F.struct("pos", F.coalesce(F.col("cutoff").cast("double"), F.lit(-1e300)).alias("c")).alias("p")))
    safe = each.groupBy("qb").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["c"]).alias("cutoff"))
    found = pairs.join(asked.join(safe, "qb"), "qb").mapInArrow(_collect(width, cuts), entry)
    return _best(found, twins, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
