"""N-gram Jaccard join: exact size-aware heavy-light set-similarity join.

A document's set holds its distinct k-word shingles.  Two documents link when
``100 * |A & B| >= percent * |A | B|``.

* equal sets are one class: every later step runs on classes;
* a class below the size boundary (light) enumerates the subsets of the sizes
  that a link with a possible partner must share, so linked light classes meet
  in one key;
* inverted lists are scanned for every pair with a class at or above the
  boundary (heavy): a class lists its rarest shingles, as many as a link cannot
  avoid sharing one of;
* the boundary is the size with the least cost, counted over the size
  histogram: subsets enumerated below it against list entries above it.

Before whole sets are compared, a pair must pass an exact test on parity bitmaps:
the bits in which two bitmaps differ never outnumber the shingles in which the
sets differ, so no link is lost.

Shingles are ordered by a count sketch of fixed size over the whole corpus,
which puts frequent lines and passages last; any order gives the same links.

For classes (``link_components``) a list is compared with its leader (the member
with the most frequent shingles, usually what the others were copied from);
then every member outside the leader's component is compared with all members
of other components, so no chain of links is lost and a list whose members all
reach the leader costs one pair a member.  ``similar_pairs`` gives every link.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemscope.llm.common import (clean_names, lists, mix, numbered, restored, shingle_sets, signed,
                                  slices, stash, unstash, words)
from itemscope.llm.graph import connected_components

#: Buckets of the count sketch that orders the shingles: a bounded broadcast.
SKETCH = 1 << 18
#: Largest set size that may be light; the histogram brought to the driver ends here.
MAX_LIGHT = 48
#: 64-bit words of a class's parity bitmap.
BITMAP = 8


def overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets with a and b members."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of n members shares with any possible partner."""
    low, high = -(-percent * n // 100), 100 * n // percent
    return sorted({overlap(n, m, percent) for m in range(max(1, low), high + 1)})


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent) if c <= n)


def prefix_size(n: int, percent: int) -> int:
    """Rarest shingles to list: a partner shares at least one of them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def boundary(histogram: dict[int, int], percent: int) -> int:
    """Size from which classes are heavy: least subsets plus list entries (written and scanned)."""
    costs = {}
    for x in range(1, MAX_LIGHT + 1):
        light = sum(c * subset_count(n, percent) for n, c in histogram.items() if 0 < n < x)
        heavy = sum(2 * c * prefix_size(n, percent) for n, c in histogram.items()
                    if n >= -(-percent * x // 100))
        costs[x] = light + heavy
    return min(costs, key=lambda x: (costs[x], x))


def _sketch(k: int):
    def run(batches):
        seen, sizes = np.zeros(SKETCH, np.int64), np.zeros(MAX_LIGHT + 1, np.int64)
        for part in slices(batches):
            for _, s in shingle_sets(words(part.column("text")), k):
                np.add.at(seen, (s >> np.uint64(46)).astype(np.int64), 1)
                if 0 < len(s) <= MAX_LIGHT:
                    sizes[len(s)] += 1
        at, of = np.flatnonzero(seen), np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, -of]).astype(np.int32)),
             pa.array(np.concatenate([seen[at], sizes[of]]))], names=["bucket", "n"])
    return run


def _keys(s: np.ndarray, rank: np.ndarray, x: int, percent: int) -> np.ndarray:
    n = len(s)
    out = []
    if n >= -(-percent * x // 100):
        order = np.lexsort((s, rank))[:prefix_size(n, percent)]
        out.append(s[order])
    if n < x:
        with np.errstate(over="ignore"):
            own = mix(s * np.uint64(0xD6E8FEB86659FD93))
            total = own.sum(dtype=np.uint64)
            for c in subset_sizes(n, percent):
                if c > n:
                    continue
                gone = [sum((own[i] for i in left), np.uint64(0)) for left in combinations(range(n), n - c)]
                out.append(mix(total - np.array(gone, np.uint64) + np.uint64(c) * np.uint64(0xA0761D6478BD642F)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        v = mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([v], np.uint64)).view(np.int64)[0])


def _parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _features(k: int, percent: int, x: int, counts):
    def run(batches):
        seen = counts.value
        for part in slices(batches):
            sid, size, score, keys, bits = [], [], [], [], []
            with np.errstate(over="ignore"):
                for _, s in shingle_sets(words(part.column("text")), k):
                    rank = seen[(s >> np.uint64(46)).astype(np.int64)]
                    sid.append(_set_id(s))
                    size.append(len(s))
                    score.append(float(np.log1p(rank).mean()) if len(s) else 0.0)
                    keys.append(signed(_keys(s, rank, x, percent)))
                    bits.append(_parity(s))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_id"), pa.array(sid, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(score, pa.float32()), lists(keys), lists(bits)],
                names=["doc_id", "text_id", "node", "n", "score", "keys", "bits"])
    return run


def _prepare(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(class of each row, list entries of classes that have a partner of a size that may link)."""
    spark = docs.sparkSession
    docs = clean_names(docs, ["doc_id", "text"]).withColumn("text_id", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = stash(docs.select("text").mapInArrow(_sketch(k), "bucket int, n bigint")
                 .groupBy("bucket").agg(F.sum("n").alias("n")))
    rows = sums.collect()  # at most SKETCH + MAX_LIGHT rows
    unstash(sums)
    seen, histogram = np.zeros(SKETCH, np.int64), {}
    for r in rows:
        if r.bucket < 0:
            histogram[-r.bucket] = r.n
        else:
            seen[r.bucket] = r.n
    x = boundary(histogram, percent)
    counts = spark.sparkContext.broadcast(seen)
    feats = stash(docs.mapInArrow(_features(k, percent, x, counts),
                                  f"doc_id {kind}, text_id bigint, node bigint, n bigint, score float, "
                                  "keys array<bigint>, bits array<bigint>"))
    classes = feats.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    posts = classes.select("node", "n", F.explode("keys").alias("key"))
    by_size = Window.partitionBy("key").orderBy("n", "node")
    paired = stash(posts.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
                    .where((F.col("n") * percent <= F.col("less") * 100) | (F.col("more") * percent <= F.col("n") * 100))
                    .select("key", "node"))
    about = feats.where("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.first("score").alias("score"), F.first("bits").alias("bits"))
    entries = stash(paired.join(about, "node"))
    rows = stash(feats.select("doc_id", "text_id", "node", "n"))
    unstash(feats, paired)
    return rows, entries


def _near(na: str, nb: str, xa: str, xb: str, percent: int):
    """Sizes and parity bitmaps allow a link."""
    apart = sum(F.bit_count(F.get(xa, F.lit(i)).bitwiseXOR(F.get(xb, F.lit(i)))) for i in range(BITMAP))
    return ((F.col(na) * percent <= F.col(nb) * 100) & (F.col(nb) * percent <= F.col(na) * 100)
            & (apart * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that link, with the size of their intersection."""
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(_compared, "a bigint, b bigint, common bigint, together bigint")
            .where(F.col("common") * 100 >= F.col("together") * percent))


def _pack(s: np.ndarray) -> bytes:
    """The upper seven bytes of every hash: a set on its way to a comparison.

    Two different shingles of a pair of sets meet with probability
    ``len(a) * len(b) / 2^56``.
    """
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(packed, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _compared(batches):
    """Intersection and union sizes of the packed sets x and y."""
    for part in batches:
        common, together = [], []
        for x, y in zip(part.column("x"), part.column("y")):
            x, y = _unpack(x.as_py()), _unpack(y.as_py())
            common.append(len(np.intersect1d(x, y, assume_unique=True)))
            together.append(len(x) + len(y) - common[-1])
        yield pa.RecordBatch.from_arrays(
            [part.column("a"), part.column("b"), pa.array(common, pa.int64()), pa.array(together, pa.int64())],
            names=["a", "b", "common", "together"])


def _whole_sets(docs: DataFrame, feats: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Whole shingle sets of the classes in ``nodes``, each from the text of one row."""
    one = feats.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("m")).select(
            "node", F.col("m.doc_id").alias("d"), F.col("m.text_id").alias("t"))
    texts = clean_names(docs, ["doc_id", "text"]).join(
        one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t"))).select("node", "text")
    return stash(texts.mapInArrow(_sets_checked(k), "node bigint, items binary"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _sets_checked(k: int):
    """Only rows whose set is the class's (a doc_id may be on several rows)."""
    def run(batches):
        for part in slices(batches):
            nodes = part.column("node").to_pylist()
            got = [s for _, s in shingle_sets(words(part.column("text")), k)]
            hold = [i for i, s in enumerate(got) if _set_id(s) == nodes[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in hold], pa.int64()), pa.array([_pack(got[i]) for i in hold], pa.binary())],
                names=["node", "items"])
    return run


def similar_pairs(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and the classes.

    Returns ``(pairs, members)``: pairs ``(a, b, common, together)`` of class ids
    with a < b, one row per link; members ``(doc_id, node, n_shingles)``, one row
    per document (rows with equal sets share ``node``; n_shingles 0: in no link).
    """
    feats, entries = _prepare(docs, k, percent)
    left = entries.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = entries.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    pairs = stash(left.join(right, "key").where((F.col("a") < F.col("b")) & _near("na", "nb", "xa", "xb", percent))
                  .select("a", "b").distinct())
    sets = _whole_sets(docs, feats, _ends(pairs), k)
    return (_verified(pairs, sets, percent).distinct(),
            feats.select("doc_id", "node", F.col("n").alias("n_shingles")))


def link_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``documents`` -> ``(doc_id, n_shingles, component_id, group_id, class_id, text_id)``, one row per row.

    ``component_id`` is the smallest doc_id reachable over links.  A null or
    empty text, or one without words, has n_shingles 0 and its own doc_id.
    Repeated rows and equal texts share a class.  A row whose doc_id is null
    gets its component's smallest doc_id (null if there is none) and links like
    any other row.  An empty table gives an empty table; columns other than doc_id
    and text are ignored.
    """
    feats, entries = _prepare(docs, k, percent)
    lead = entries.groupBy("key").agg(F.max(F.struct("score", "node", "n", "bits")).alias("l")).select(
        "key", F.col("l.node").alias("leader"), F.col("l.n").alias("ln"), F.col("l.bits").alias("lbits"))
    pairs = stash(entries.join(lead, "key")
                  .where((F.col("node") != F.col("leader")) & _near("n", "ln", "bits", "lbits", percent))
                  .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    sets = _whole_sets(docs, feats, _ends(pairs), k)
    first = stash(_verified(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    unstash(pairs)

    comp = connected_components(first).select("node", F.col("root").alias("c"))
    listed = stash(entries.join(comp, "node", "left").withColumn("c", F.coalesce("c", "node")))
    unstash(entries)
    still = (listed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                       F.max(F.struct("score", "node", "c")).alias("l"))
             .where("lo <> hi").select("key", F.col("l.node").alias("leader"), F.col("l.c").alias("lc")))
    member = stash(listed.join(still, "key").select("key", "node", "n", "bits", "c", "leader", "lc"))
    unstash(listed)
    out = member.where("c <> lc").select("key", F.col("node").alias("a"), F.col("n").alias("na"),
                                         F.col("bits").alias("xa"), F.col("c").alias("ca"))
    rest = stash(out.join(member.where("node <> leader"), "key")
                 .where((F.col("ca") != F.col("c")) & _near("na", "n", "xa", "bits", percent)
                        & ((F.col("c") == F.col("lc")) | (F.col("a") < F.col("node"))))
                 .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    unstash(member)
    ends = stash(_ends(rest))
    new = _whole_sets(docs, feats, ends.join(sets, "node", "left_anti"), k)
    more = stash(sets.join(ends, "node", "left_semi").unionByName(new))
    unstash(sets, new, ends)
    second = _verified(rest, more, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected_components(first.union(second))
    unstash(first, rest, more)

    rooted = feats.select("doc_id", "text_id", "node", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    shown = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("root").alias("group_id"),
             F.col("node").alias("class_id"), "text_id"]
    return (rooted.where("n > 0").join(least, "root").select(*shown)
            .unionByName(rooted.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*shown)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every group of linked documents: the smallest doc_id (null last).

    Rows without words are in no group and all stay.
    """
    found = stash(link_components(docs, k, percent).select("doc_id", "text_id", "n_shingles", "group_id"))
    first = found.where("n_shingles > 0").groupBy("group_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("m")).select(
            F.col("m.doc_id").alias("__d"), F.col("m.text_id").alias("__t"), F.lit(False).alias("__all"))
    empty = found.where("n_shingles = 0").select(F.col("doc_id").alias("__d"), F.col("text_id").alias("__t"),
                                                 F.lit(True).alias("__all")).distinct()
    keep = stash(first.unionByName(empty))
    rows = numbered(docs, ["doc_id", "text"]).withColumn("__th", F.xxhash64("text")).drop("text")
    left = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")))
    twins = Window.partitionBy("__d", "__t").orderBy(F.lit(0))  # repeated rows of the one that stays
    return restored(left.withColumn("__i", F.row_number().over(twins)).where("__all or __i = 1"), docs)
