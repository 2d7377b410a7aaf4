"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

* examples: a bounded sample of the labelled training documents (the smallest
  md5 of the id first), toxic or not, each with every term of its text;
* weights: log(1 + tf) * idf, the document frequencies counted over all documents;
* vectors: examples and texts are taken by all their terms.  Terms that no
  example holds add nothing to a product but belong to a text's length; their
  frequencies come from a grouped sum and go back to the texts by a join;
* index: frequent terms as columns over all examples, multiplied for many texts
  at once, the others as inverted lists.  These sums are single precision; every
  example that their error bound leaves among the nearest is summed again in
  double precision, so the nearest examples are exact;
* votes: similarity-weighted labels of the nearest examples, with the rate of
  the examples as prior.  The neighbours are the evidence.

Only texts enter a score; labels of training documents only make the examples.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemscope.llm.common import (LOWER, Words, clean_names, lists, signed, slices, stash, text_bytes, unstash,
                                  with_arrow_columns)

#: Most labelled training documents that examples are drawn from, neighbours, texts multiplied at once.
EXAMPLES, NEIGHBOURS, BLOCK = 20_000, 15, 64
#: Terms in at least one of so many examples are columns and come first.
FIRST = 16
#: Example terms that are weighed at once.
WEIGHED = 1 << 19
#: Weight of the prior against a neighbour of similarity 1.
PRIOR = 0.5
_CUT = np.ones(256, bool)
_CUT[48:58] = _CUT[65:91] = _CUT[97:123] = _CUT[128:] = False

NEW = [T.StructField("score", T.DoubleType()), T.StructField("neighbours", T.ArrayType(T.LongType())),
       T.StructField("similarities", T.ArrayType(T.DoubleType()))]
PRODUCTS = [T.StructField("own", T.DoubleType()), T.StructField("near", T.ArrayType(T.LongType())),
            T.StructField("products", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.DoubleType())]


def terms_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term: runs of letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    data, off = text_bytes(col)
    w = Words(LOWER[data], off, _CUT)
    return w.hashes(), w.doc


def _counted(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the different terms of every row, in that order."""
    h, row = terms_of(col)
    h = signed(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, int)
    return row[new], h[new], np.diff(np.r_[new, len(h)])


def _among(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``h`` in sorted ``terms``, and whether they stand there."""
    if not len(terms):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return at, terms[at] == h


def _example_terms(chosen):
    def run(batches):
        ids = chosen.value
        for part in slices(batches):
            doc = np.array([-1 if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
            mine = _among(ids, doc)[1] & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            if not mine.any():
                continue
            row, h, tf = _counted(part.column("text").filter(pa.array(mine)))
            edge = np.searchsorted(row, np.arange(mine.sum() + 1))
            cut = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[mine]), pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()),
                 pa.array([tf[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary())],
                names=["doc_id", "terms", "tf"])
    return run


def _distinct_terms(batches):
    for batch in batches:
        h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h))], names=["term"])


def _placed_terms(terms):
    """Terms as places in ``terms`` (4 bytes each), so that the driver holds no hash of every example's term."""
    def run(batches):
        for batch in batches:
            at = [np.searchsorted(terms.value, np.frombuffer(h, np.int64)).astype(np.int32).tobytes()
                  for h in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at, pa.binary()), batch.column("tf")],
                                             names=["doc_id", "at", "tf"])
    return run


def _frequencies(terms):
    """Documents of each of ``terms`` (no key), and every text's other terms."""
    def run(batches):
        seen = np.zeros(len(terms.value), np.int64)
        for part in slices(batches):
            row, h, tf = _counted(part.column("text"))
            at, hit = _among(terms.value, h)
            seen += np.bincount(at[hit], minlength=len(seen))
            row, h, tf = row[~hit], h[~hit], tf[~hit]
            many = np.bincount(row, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(row)), pa.array(h), pa.array(tf.astype(np.int64)), pa.array(many[row])],
                names=["key", "term", "tf", "many"])
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.array(terms.value[k]), pa.array(seen[k]),
                                          pa.nulls(len(k), pa.int64())], names=["key", "term", "tf", "many"])
    return run


class Index:
    """Examples by unit TF-IDF vectors over all their terms."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, vectors: dict[int, dict[int, float]],
                 toxic: dict[int, int], base: float):
        ids = sorted(vectors)
        self._hold(terms, idf, np.array(ids, np.int64), np.array([len(vectors[d]) for d in ids], np.int64),
                   np.array([t for d in ids for t in vectors[d]], np.int32),
                   np.array([v for d in ids for v in vectors[d].values()], np.float64), toxic, base)

    @classmethod
    def of_examples(cls, ids: np.ndarray, size: np.ndarray, at: np.ndarray, tf: np.ndarray, terms: np.ndarray, idf: np.ndarray,
                    toxic: dict[int, int], base: float) -> Index:
        """The examples ``ids`` have ``size`` terms each: the places ``at`` in sorted ``terms``, ``tf`` times.
        Weights are made where they are used, so that neither the driver nor a broadcast holds them."""
        index = cls.__new__(cls)
        index.tf = tf.astype(np.min_scalar_type(int(tf.max(initial=0))))
        index._hold(terms, idf, ids, size, at, None, toxic, base)
        return index

    def _weigh(self):
        """Unit weights of all examples, some examples at a time."""
        self.weight = np.empty(len(self.at))
        n = len(self.ids)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.off, self.off[lo] + WEIGHED, "right")) - 1)
            a, b = self.off[lo], self.off[hi]
            v = np.log1p(self.tf[a:b].astype(np.int32)) * self.idf[self.at[a:b]]
            length = np.sqrt(np.add.reduceat(v * v, self.off[lo:hi] - a))
            self.weight[a:b] = v / np.repeat(length, np.diff(self.off[lo:hi + 1]))
            lo = hi
        del self.tf

    def _hold(self, terms, idf, ids, size, at, weight, toxic, base):
        self.terms, self.idf, self.ids, self.base = terms, idf, ids, base
        self.off, self.at, self.weight = np.r_[0, np.cumsum(size)], at, weight
        self.label = np.array([toxic[d] for d in ids.tolist()], np.float64)
        self.start = None

    def _invert(self):
        """Columns and inverted lists; made where they are used, so that only the vectors are sent."""
        if self.weight is None:
            self._weigh()
        n, places = len(self.ids), len(self.at)
        size = np.zeros(len(self.terms), np.int64)
        for a in range(0, places, WEIGHED):  # some places at a time: only the results are as large as the index
            size += np.bincount(self.at[a:a + WEIGHED], minlength=len(size))
        self.column = np.full(len(self.terms), -1, np.int32)
        first = np.flatnonzero(size * FIRST >= max(n, 1))
        self.column[first] = np.arange(len(first))
        self.columns = np.zeros((len(first), n), np.float32)
        for a in range(0, places, WEIGHED):
            column = self.column[self.at[a:a + WEIGHED]]
            here = np.flatnonzero(column >= 0)
            self.columns[column[here], np.searchsorted(self.off, a + here, "right") - 1] = self.weight[a + here]
        size[first] = 0
        self.start = np.r_[0, np.cumsum(size)]
        self.example, self.light = np.empty(self.start[-1], np.int32), np.empty(self.start[-1], np.float32)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + WEIGHED, "right")) - 1)
            own = slice(self.start[lo], self.start[hi])
            here = np.flatnonzero((self.at >= lo) & (self.at < hi))
            here = here[self.column[self.at[here]] < 0]
            here = here[np.argsort(self.at[here], kind="stable")]
            self.example[own], self.light[own] = np.searchsorted(self.off, here, "right") - 1, self.weight[here]
            lo = hi
        self.text = np.zeros(len(self.terms))
        self.cache: dict[bytes, tuple] = {}

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf) * self.idf[at]
        return v / np.sqrt((v * v).sum())

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact k most similar examples (ties to the earlier place) with a positive similarity."""
        return self.nearest_of([(at, v)], k)[0]

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several texts."""
        if self.start is None:
            self._invert()
        first = np.zeros((len(texts), len(self.columns)), np.float32)
        for i, (at, v) in enumerate(texts):
            c = self.column[at]
            first[i, c[c >= 0]] = v[c >= 0]
        sums = first @ self.columns
        return [self._exact(sums[i], at, v, k) for i, (at, v) in enumerate(texts)]

    def _exact(self, sums: np.ndarray, at: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(sums)
        lo, hi = self.start[at], self.start[at + 1]
        cut = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist()) if b > a]
        if cut:
            light = np.concatenate([self.light[c] for c in cut]) * np.repeat(v.astype(np.float32), hi - lo)
            sums = sums + np.bincount(np.concatenate([self.example[c] for c in cut]), light, n).astype(np.float32)
        least = float(np.partition(sums, n - k)[n - k]) if n > k else 0.0
        # all weights are positive, so a sum of m products errs by at most about m + 4 roundings of its size
        least *= max(0.0, 1 - 2 * (len(at) + 8) * float(np.finfo(np.float32).eps))
        near = np.flatnonzero((sums > 0) & (sums >= least))
        if not len(near):
            return np.zeros(0, np.int64), np.zeros(0)
        size = self.off[near + 1] - self.off[near]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(self.off[near] - begin, size)
        self.text[at] = v
        exact = np.add.reduceat(self.weight[place] * self.text[self.at[place]], begin)
        self.text[at] = 0
        top = np.lexsort((near, -exact))[:k]
        return near[top], exact[top]

    def products(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple]:
        """(squared length over the index's terms, neighbours, products with them, labels' part) of (terms, times)."""
        if self.start is None:
            self._invert()
        keys = [hashlib.blake2b(at.tobytes() + tf.tobytes(), digest_size=16).digest() for at, tf in texts]
        if len(self.cache) > 20_000:
            self.cache.clear()
        new = list({key: i for i, key in enumerate(keys) if key not in self.cache}.items())
        for a in range(0, len(new), BLOCK):
            some = [(texts[i][0], np.log1p(texts[i][1]) * self.idf[texts[i][0]]) for _, i in new[a:a + BLOCK]]
            for (key, _), (_, v), (i, s) in zip(new[a:a + BLOCK], some, self.nearest_of(some, k)):
                self.cache[key] = (float((v * v).sum()), self.ids[i], s, float((s * self.label[i]).sum()))
        return [self.cache[key] for key in keys]


def build_index(docs: DataFrame, labels: DataFrame, train, examples: int = EXAMPLES) -> tuple[Index | None, DataFrame | None]:
    """Index of the labelled documents for which ``train`` (a column of labels) holds; ``(key, beyond)``, the squared
    length of every text outside the index's terms, by the hash of the text.  Both None without example terms."""
    spark = docs.sparkSession
    docs = clean_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("key"))
    picked = (labels.where("doc_id is not null and toxic is not null").where(train)
              .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(examples).collect())
    label = {r.doc_id: int(r.toxic) for r in picked}
    chosen = spark.sparkContext.broadcast(np.array(sorted(label), np.int64))
    held = stash(docs.select("doc_id", "text").mapInArrow(_example_terms(chosen), "doc_id bigint, terms binary, tf binary")
                 .where("length(terms) > 0").distinct())
    chosen.destroy()
    terms = np.sort(held.select("terms").mapInArrow(_distinct_terms, "term bigint").distinct().toArrow().column(0).to_numpy())
    if not len(terms):
        unstash(held)
        return None, None
    sent = spark.sparkContext.broadcast(terms)
    found = (held.mapInArrow(_placed_terms(sent), "doc_id bigint, at binary, tf binary").toArrow()
             .sort_by([(c, "ascending") for c in ("doc_id", "at", "tf")]))
    unstash(held)
    ids = found.column("doc_id").to_numpy()
    at, tf = (np.frombuffer(b"".join(x.as_buffer() for x in found.column(c)), np.int32) for c in ("at", "tf"))
    size = pc.binary_length(found.column("at")).to_numpy().astype(np.int64) // 4
    del found
    total = docs.count()
    held = stash(docs.select("text", "key").mapInArrow(_frequencies(sent), "key bigint, term bigint, tf bigint, many bigint"))
    sent.destroy()
    known = held.where("key is null").groupBy("term").agg(F.sum("tf").alias("n")).toArrow()
    df = np.zeros(len(terms))
    df[np.searchsorted(terms, known.column("term").to_numpy())] = known.column("n").to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    other = held.where("key is not null")
    weight = F.log1p("tf") * (F.log(F.lit(1.0 + total) / (1 + F.col("n"))) + 1)
    # equal texts have equal rows: the mean over the rows of a key, times the terms of one text
    beyond = stash(other.join(other.groupBy("term").agg(F.count("*").alias("n")), "term")
                   .groupBy("key").agg((F.avg(weight * weight) * F.max("many")).alias("beyond")))
    unstash(held)
    return Index.of_examples(ids, size, at, tf, terms, idf, label, sum(label.values()) / len(label)), beyond


def _make(index, k: int):
    def make(part: pa.RecordBatch) -> list[pa.Array]:
        x: Index = index.value
        row, h, tf = _counted(part.column(0))
        at, hit = _among(x.terms, h)
        row, at, tf = row[hit], at[hit], tf[hit]
        n = part.num_rows
        own, near, sims, toxic = np.zeros(n), [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n, np.zeros(n)
        rows = np.unique(row)
        edge = np.searchsorted(row, np.r_[rows, n]).tolist()
        for i, got in zip(rows.tolist(), x.products([(at[a:b], tf[a:b]) for a, b in zip(edge, edge[1:])], k)):
            own[i], near[i], sims[i], toxic[i] = got
        return [pa.array(own), lists(near), lists(sims, np.float64), pa.array(toxic)]
    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, train=None, k: int = NEIGHBOURS, examples: int = EXAMPLES) -> DataFrame:
    """Every row of ``docs`` with ``(score, neighbours, similarities)``.

    ``score`` (0 to 1) is the vote of the ``k`` nearest examples; ``neighbours``
    their ids, the most similar first, with their ``similarities``, the cosines of
    the whole texts.  A null or empty text, or one that shares no term with an
    example, scores the rate of the examples and has no neighbours.  An id with
    several texts is an example by each of them.  Equal texts score alike.
    Without labels every score is 0.  Own columns with those names are dropped;
    an empty table gives an empty table.
    """
    index, beyond = build_index(docs, labels, F.lit(True) if train is None else train, examples)
    own = [c for c in docs.columns if c not in [f.name for f in NEW]]
    if index is None:
        none = [F.lit(0.0).alias("score"), F.array().cast("array<bigint>").alias("neighbours"),
                F.array().cast("array<double>").alias("similarities")]
        return docs.select(*[F.col(f"`{c}`") for c in own], *none)
    held = docs.select(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(own)], F.xxhash64("text").alias("key"))
    made = with_arrow_columns(held, [f"o{own.index('text')}"], _make(docs.sparkSession.sparkContext.broadcast(index), k), PRODUCTS)
    length = F.sqrt(F.col("own") + F.coalesce("beyond", F.lit(0.0)))
    share = F.when(F.size("near") > 0, 1 / length).otherwise(0.0)
    every = F.aggregate("products", F.lit(0.0), lambda a, b: a + b)
    return (made.join(beyond, "key", "left")
            .select(*[F.col(f"o{i}").alias(c) for i, c in enumerate(own)],
                    ((F.col("toxic") * share + PRIOR * index.base) / (every * share + PRIOR)).alias("score"),
                    F.col("near").alias("neighbours"),
                    F.transform("products", lambda x: x * share).alias("similarities")))
