"""Repeated-substring removal by column-wise construction of ordered suffixes.

A byte goes when some ``length``-byte string that covers it starts anywhere
else, in the same or another document; strings never cross documents and are
judged on the input.

The collection's suffixes are ordered as in column-wise (one symbol per string
and round, right to left) construction of the Burrows-Wheeler transform with
its longest-common-prefix array: a round reads the next column from a
sequential external file, refines the order of all strings by that symbol
(stable, so equal symbols keep the order of the suffixes behind them) and
updates the common prefixes of neighbours (equal symbols: one more than the
minimum over the old neighbours between them).  A string whose neighbour shares
``length`` symbols is repeated.

So that Spark can deal the work out, the strings are not whole documents but
pieces around anchors.  Every ``length``-byte window has one anchor: the
leftmost smallest hash among its ``GRAM``-byte substrings.  Equal windows have
equal anchors at equal offsets, so only pieces of one anchor hash, aligned at the
anchor, need one order; every window of every document lies in exactly one
piece.  Pieces whose anchor hash occurs once cannot repeat and are not cut.

An anchor hash with more than ``hot`` occurrences (a passage in a large part of
the corpus) is not gathered in one task: its windows are counted by their
128-bit hash with map-side sums, over all its occurrences.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemscope.llm.common import (BYTE_VALUES, STEP, clean_names, lists, mix, numbered, powers, signed,
                                  slices, stash, text_bytes)

GRAM = 64
#: Most occurrences of an anchor hash whose pieces are ordered in one task.
HOT = 1 << 16
#: Pieces ordered together (whole anchor groups); bounds a task's memory.
TOGETHER = 1 << 15
#: Window starts handled at once in a very long text; positions must fit POSITION_BITS.
BLOCK = 1 << 20
POSITION_BITS = 24
_SECOND = np.uint64(0xD1342543DE82EF95)


def _gram_hashes(data: np.ndarray, size: int, base: np.uint64 = STEP) -> np.ndarray:
    """Polynomial hash (modulo 2^64, finalised) of every ``size`` consecutive bytes."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(n, base), out=total[1:])
        out = total[size:] - total[:-size]
        out *= powers(n - size + 1, inverse)
    return mix(out)


def _window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor position of every window start, hash of every gram) of some bytes."""
    h = _gram_hashes(data, GRAM if length >= GRAM else length)
    w = length - min(GRAM, length) + 1
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), h
    low = np.uint64((1 << POSITION_BITS) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pad = np.full(-len(v) % w, np.uint64(2**64 - 1))
    block = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1:w - 1 + n]) & low).astype(np.int64), h


def _anchors(length: int):
    def run(batches):
        for part in slices(batches):
            data, off = text_bytes(part.column("text"))
            rid = part.column("rid").to_numpy()
            out = []
            # runs of whole documents up to BLOCK, or blocks of one long document
            spans, lo = [], 0
            for i in range(1, len(off)):
                if off[i] - off[lo] > BLOCK or i == len(off) - 1:
                    spans.append((lo, i))
                    lo = i
            for a, b in spans:
                begin, end = off[a], off[b]
                for s in range(int(begin), max(int(end) - length + 1, int(begin) + 1), BLOCK):
                    stop = min(int(end), s + BLOCK + length - 1)
                    at, h = _window_anchors(data[s:stop], length)
                    if not len(at):
                        continue
                    start = np.arange(s, s + len(at))
                    doc = np.searchsorted(off, start, "right") - 1
                    inside = start + length <= off[doc + 1]
                    start, at, doc = start[inside], at[inside], doc[inside]
                    if not len(start):
                        continue
                    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                                               | (start[1:] != start[:-1] + 1)])
                    last = np.r_[new[1:], len(start)] - 1
                    d = doc[new]
                    out.append((rid[d], signed(h[at[new]]), at[new] + s - off[d], start[new] - off[d],
                                start[last] - off[d]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols],
                                                 names=["rid", "h", "at", "lo", "hi"])
    return run


def _pieces(length: int, hot: bool):
    """Cut the pieces of a document's anchors; for hot ones, hash each window instead."""
    def run(batches):
        for part in slices(batches, limit=1 << 18):
            data, off = text_bytes(part.column("text"))
            rid = part.column("rid").to_pylist()
            offs = part.column("found").offsets.to_numpy()
            found = part.column("found").flatten()
            h, at, lo, hi = (found.field(i).to_numpy() for i in range(4))
            base = offs[0]
            out = {"h": [], "rid": [], "at": [], "lo": [], "piece": [], "w1": [], "w2": []}
            for i in range(part.num_rows):
                raw = data[off[i]:off[i + 1]]
                for j in range(offs[i] - base, offs[i + 1] - base):
                    piece = raw[lo[j]:hi[j] + length]
                    if not hot:
                        out["h"].append(h[j]), out["rid"].append(rid[i]), out["at"].append(at[j])
                        out["lo"].append(lo[j]), out["piece"].append(piece.tobytes())
                        continue
                    a, b = _gram_hashes(piece, length), _gram_hashes(piece, length, _SECOND)
                    out["h"].append(np.full(len(a), h[j])), out["rid"].append(np.full(len(a), rid[i]))
                    out["lo"].append(lo[j] + np.arange(len(a)))
                    out["w1"].append(signed(a)), out["w2"].append(signed(b))
                if sum(map(len, out["piece"])) > 1 << 22 or len(out["w1"]) > 1000:
                    yield _piece_batch(out, hot)
                    out = {k: [] for k in out}
            if out["h"]:
                yield _piece_batch(out, hot)
    return run


def _piece_batch(out: dict, hot: bool) -> pa.RecordBatch:
    if hot:
        names = ["h", "rid", "lo", "w1", "w2"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[c])) for c in names], names=names)
    return pa.RecordBatch.from_arrays(
        [pa.array(out[c], pa.int64()) for c in ("h", "rid", "at", "lo")] + [pa.array(out["piece"], pa.binary())],
        names=["h", "rid", "at", "lo", "piece"])


def repeated_columns(pieces: list[bytes], begin: np.ndarray, group: np.ndarray, width: int,
                     starts: int, length: int) -> np.ndarray:
    """Column-wise ordering of aligned strings: which have a repeat starting at which column.

    ``pieces[i]`` covers columns begin[i] ...; ``group`` (ascending) parts the
    strings that need one order.  Returns a boolean array [column < starts, string].
    """
    m = len(pieces)
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as present:
        block, there = np.zeros((m, width), np.uint8), np.zeros((m, width), bool)
        for i, p in enumerate(pieces):
            block[i, begin[i]:begin[i] + len(p)] = np.frombuffer(p, np.uint8)
            there[i, begin[i]:begin[i] + len(p)] = True
        # the last column first: each round reads on
        columns.write(np.ascontiguousarray(block.T[::-1]))
        present.write(np.ascontiguousarray(there.T[::-1]))
        del block, there
        columns.seek(0), present.seek(0)
        repeated = np.zeros((starts, m), bool)
        order = np.arange(m)
        base = group.astype(np.int64) * 257
        common = np.zeros(m + 1, np.int32)  # common[k]: shared prefix of order[k-1] and order[k]
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(m), np.uint8).astype(np.int64) + 1
            symbol *= np.frombuffer(present.read(m), bool)
            key = (base + symbol)[order]  # groups keep their places, so base[order] == base
            step = key[1:] >= key[:-1]
            if step.all():
                same = np.flatnonzero(key[1:] == key[:-1]) + 1
                fresh = np.zeros(m + 1, np.int32)
                fresh[same] = common[same] + 1
            else:
                perm = np.argsort(key, kind="stable")
                order, key = order[perm], key[perm]
                same = np.flatnonzero(key[1:] == key[:-1]) + 1
                a, b = perm[same - 1], perm[same]
                fresh = np.zeros(m + 1, np.int32)
                near = b == a + 1
                fresh[same[near]] = common[b[near]] + 1
                far = np.flatnonzero(~near)
                if len(far):
                    bounds = np.empty(2 * len(far), np.int64)
                    bounds[0::2], bounds[1::2] = a[far] + 1, b[far] + 1
                    fresh[same[far]] = np.minimum.reduceat(common, bounds)[0::2] + 1
            fresh[:m][key % 257 == 0] = 0  # nothing stands at this column
            common = fresh
            if c < starts:
                repeated[c, order] = np.maximum(common[:m], common[1:]) >= length
    return repeated


def _ranges(length: int, together: int):
    """Repeated byte ranges of pieces that arrive sorted by anchor hash."""
    back = length - min(GRAM, length)  # most bytes between a window's start and its anchor
    width, starts = 2 * length - min(GRAM, length), back + 1

    def solve(t: pa.Table):
        h, rid = t.column("h").to_numpy(), t.column("rid").to_numpy()
        at, lo = t.column("at").to_numpy(), t.column("lo").to_numpy()
        begin = back - (at - lo)
        group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
        hit = repeated_columns(t.column("piece").to_pylist(), begin, group, width, starts, length).T
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, after = np.nonzero(edge == -1)
        shift = (lo - begin)[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[row]), pa.array(first + shift), pa.array(after - 1 + shift + length)],
            names=["rid", "b", "e"])

    def run(batches):
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count >= together:
                t = pa.concat_tables(held).combine_chunks()
                h = t.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1], "left"))
                if cut:
                    yield solve(t.slice(0, cut).combine_chunks())
                    t = t.slice(cut)
                held, count = [t], t.num_rows
        if count:
            yield solve(pa.concat_tables(held).combine_chunks())
    return run


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = HOT, together: int = TOGETHER) -> DataFrame:
    """``(rid, found)``: ``found`` holds byte ranges ``(b, e)`` of repeats, merged or not, of the
    rows with ``rid = xxhash64(doc_id, text)``; rows without a repeat are absent."""
    keyed = clean_names(docs, ["doc_id", "text"]).select(F.xxhash64("doc_id", "text").alias("rid"), "text")
    anchors = stash(keyed.where(F.octet_length("text") >= length)
                    .mapInArrow(_anchors(length), "rid bigint, h bigint, at bigint, lo bigint, hi bigint")
                    .select("rid", "h", F.col("at").cast("int"), F.col("lo").cast("int"), F.col("hi").cast("int")))
    # written, so that the join deals both sides out by itself and Spark can split a frequent anchor
    often = stash(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    found = stash(anchors.join(often, "h").groupBy("rid").agg(
        F.collect_set(F.when(F.col("c") <= hot, F.struct("h", "at", "lo", "hi"))).alias("cool"),
        F.collect_set(F.when(F.col("c") > hot, F.struct("h", "at", "lo", "hi"))).alias("warm")))

    def cut(which: str) -> DataFrame:
        return keyed.join(found.where(F.size(which) > 0).select("rid", F.col(which).alias("found")), "rid")

    pieces = cut("cool").mapInArrow(_pieces(length, False), "h bigint, rid bigint, at bigint, lo bigint, piece binary")
    ranges = (pieces.repartition(F.col("h")).sortWithinPartitions("h")
              .mapInArrow(_ranges(length, together), "rid bigint, b bigint, e bigint"))
    if not found.where(F.size("warm") > 0).isEmpty():
        seen = stash(cut("warm").mapInArrow(_pieces(length, True), "h bigint, rid bigint, lo bigint, w1 bigint, w2 bigint"))
        many = seen.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
        ranges = ranges.unionByName(seen.join(many, ["w1", "w2"], "left_semi").select(
            "rid", F.col("lo").alias("b"), (F.col("lo") + length).alias("e")))
    return stash(ranges.groupBy("rid").agg(F.collect_set(F.struct("b", "e")).alias("found")))


def _apply(columns: list[str]):
    def run(batches):
        for part in slices(batches):
            data, off = text_bytes(part.column("text"))
            found = part.column("__found").to_pylist()
            kept, size, removed, spans, sha = [], [], [], [], []
            for i, ranges in enumerate(found):
                raw = data[off[i]:off[i + 1]].tobytes()
                merged: list[list[int]] = []
                for r in sorted((r["b"], r["e"]) for r in ranges or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                rest, p = [], 0
                for b, e in merged:
                    rest.append(raw[p:b])
                    p = e
                left = b"".join([*rest, raw[p:]])
                size.append(len(raw)), removed.append(len(raw) - len(left)), spans.append(merged)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore"))
            flat = [np.array(s, np.int64).reshape(-1, 2) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in columns] + [
                    pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                    lists([s[:, 0] for s in flat]), lists([s[:, 1] for s in flat]), pa.array(sha, pa.string())],
                names=[*columns, "__kept", "__bytes", "__removed", "__b", "__e", "__sha"])
    return run


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = HOT, together: int = TOGETHER) -> DataFrame:
    """Every row of ``docs`` with its own columns and ``(kept_text, n_bytes, n_removed, span_begin,
    span_end, kept_sha256)``.

    A null text is empty (0 bytes, kept_text ''); texts under ``length`` bytes
    lose nothing; repeated rows repeat each other, so both lose what they share.
    ``kept_sha256`` is over the remaining bytes; ``kept_text`` leaves out bytes of
    characters that a removed range cuts through.  Own columns that clash with a
    result column are dropped.  An empty table gives an empty table.
    """
    spans = repeated_spans(docs, length, hot, together)
    own = [c for c in docs.columns if c not in
           ("kept_text", "n_bytes", "n_removed", "span_begin", "span_end", "kept_sha256")]
    given = docs.select(*[F.col(f"`{c}`") for c in own])
    safe = [f"own{i}" for i in range(len(own))]
    rows = (numbered(given, ["doc_id", "text"]).withColumn("__rid", F.xxhash64("doc_id", "text")).drop("doc_id")
            .join(spans.select(F.col("rid").alias("__rid"), F.col("found").alias("__found")), "__rid", "left"))
    new = [("__kept", T.StringType()), ("__bytes", T.LongType()), ("__removed", T.LongType()),
           ("__b", T.ArrayType(T.LongType())), ("__e", T.ArrayType(T.LongType())), ("__sha", T.StringType())]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(safe, own)]
                          + [T.StructField(n, t) for n, t in new])
    return rows.mapInArrow(_apply(safe), schema).toDF(
        *own, "kept_text", "n_bytes", "n_removed", "span_begin", "span_end", "kept_sha256")
