"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two kinds of n-grams are hashed into a fixed number of buckets, so that counts do
not thin out as the vocabulary grows: ``GRAM`` consecutive bytes, and pairs of
neighbouring words' shapes (capitals, symbols, digits, closing mark, length
class, same word as before).  For each kind two multinomials are counted: the
raw corpus (all documents, whole texts) and the trusted target (documents that
``labels`` marks with quality 1), the target smoothed towards the raw one.
A document's score is the mean over its n-grams of the log ratio target/raw,
added up over the two kinds, and a fixed threshold decides on every document: no draw, no rank.  Documents
that the base rules fail are rejected whatever the score.

The trusted ids are a bounded sample (``trusted_limit``, the smallest md5 of
the id first), so what is sent to the tasks is bounded; the raw counts cover
every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemscope.llm.common import (SEPARATOR, Words, clean_names, mix, slices, text_bytes, window_hashes,
                                  with_arrow_columns)

BYTE_BITS, SHAPE_BITS, GRAM = 16, 12, 3
SIZE = (1 << BYTE_BITS) + (1 << SHAPE_BITS)
#: Weight of the raw corpus in the smoothed target, in n-grams.
PRIOR = 2000.0
#: Most labelled rows (quality 1) that make up the trusted target.
TRUSTED_LIMIT = 20_000
#: Least mean log ratio (natural log) of a kept document.
THRESHOLD = -0.75
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
_STRIP = bytes([0x20, *range(0x09, 0x0E)])

NEW = [T.StructField(n, T.LongType()) for n in
       ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()),
    T.StructField("kept", T.BooleanType())]


#: What a byte shows of its word: capital, other letter, digit, symbol.
_SHOWS = np.zeros(256, np.uint8)
_SHOWS[65:91], _SHOWS[97:123], _SHOWS[128:], _SHOWS[48:58] = 1, 2, 2, 4
_SHOWS[SYMBOLS > 0] = 8
_CLOSES = np.zeros(256, np.uint8)
_CLOSES[list(b".,!?;:")] = range(1, 7)


def _shapes(w: Words, h: np.ndarray) -> np.ndarray:
    """Shape code (below 2^11) of every word."""
    if not len(h):
        return np.zeros(0, np.int64)
    bounds = np.empty(2 * len(h), np.int64)
    bounds[0::2], bounds[1::2] = w.start, w.end
    shows = np.bitwise_or.reduceat(np.append(_SHOWS[w.data], np.uint8(0)), bounds)[0::2].astype(np.int64)
    size = np.searchsorted([4, 8, 13, 31], w.end - w.start, "right")
    size = np.minimum(size, 3)
    same = np.r_[False, (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])]
    return shows | _CLOSES[w.data[w.end - 1]].astype(np.int64) << 4 | size << 7 | same.astype(np.int64) << 9


def _buckets(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every n-gram, for each kind."""
    n = len(w.data) - GRAM + 1
    grams, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > 0:
        code = np.zeros(n, np.uint32)
        for i in range(GRAM):
            code = code << np.uint32(8) | w.data[i:i + n]
        with np.errstate(over="ignore"):
            grams = (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BYTE_BITS)).astype(np.int64)
        rows = np.repeat(np.arange(w.n), np.diff(w.off))
        inside = rows[:n] == rows[GRAM - 1:]
        grams, rows = grams[inside], rows[:n][inside]
    h = w.hashes()
    shape = _shapes(w, h)
    inside = w.doc[1:] == w.doc[:-1]
    pair = (mix((shape[:-1] * 2048 + shape[1:]).astype(np.uint64)) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)
    return [(grams, rows), (pair[inside] + (1 << BYTE_BITS), w.doc[1:][inside])]


def _counts(trusted):
    def run(batches):
        raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for part in slices(batches):
            w = Words(*text_bytes(part.column("text")))
            ids = np.array([-1 if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
            known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            good = np.isin(ids, trusted.value) & known
            for at, row in _buckets(w):
                raw += np.bincount(at, minlength=SIZE)
                target += np.bincount(at[good[row]], minlength=SIZE)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])],
                                         names=["k", "raw", "target"])
    return run


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_limit: int = TRUSTED_LIMIT) -> np.ndarray:
    """Log ratio target/raw of every bucket ; all zero without trusted documents."""
    spark = docs.sparkSession
    picked = (labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint")).distinct()
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(trusted_limit).collect())
    ids = spark.sparkContext.broadcast(np.array(sorted(r.doc_id for r in picked), np.int64))
    rows = (clean_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("bigint"), "text")
            .mapInArrow(_counts(ids), "k bigint, raw bigint, target bigint")
            .groupBy("k").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.ones(SIZE), np.zeros(SIZE)
    for r in rows:
        raw[r.k] += r.raw
        target[r.k] += r.target
    out = np.zeros(SIZE)
    for part in (slice(0, 1 << BYTE_BITS), slice(1 << BYTE_BITS, SIZE)):
        share, got = raw[part] / raw[part].sum(), target[part]
        if got.sum():
            out[part] = np.log((got + PRIOR * share) / (got.sum() + PRIOR)) - np.log(share)
    return out


def _dup_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(_STRIP):
            seen.add(line)
    return n


def _repeat_words(w: Words, h: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each row that lie in a k-word window found twice or more in the row."""
    full = window_hashes(h, k)
    if not len(full):
        return np.zeros(w.n, np.int64)
    inside = w.doc[:len(full)] == w.doc[k - 1:]
    with np.errstate(over="ignore"):
        key = mix(full + w.doc[:len(full)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    hit = order[np.r_[False, same] | np.r_[same, False]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    return np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=w.n)


def _judge(ratios, threshold: float):
    def make(part: pa.RecordBatch) -> list[pa.Array]:
        data, off = text_bytes(part.column("text"))
        w = Words(data, off)
        h = w.hashes()
        n = w.counts()
        chars = np.r_[0, np.cumsum((data & 0xC0 != 0x80) & ~SEPARATOR[data])]
        marks = np.r_[0, np.cumsum(SYMBOLS[data])]
        lines = [_dup_lines(data[off[i]:off[i + 1]].tobytes()) for i in range(w.n)]
        again = _repeat_words(w, h)
        score = np.zeros(w.n)
        for at, row in _buckets(w):
            grams = np.bincount(row, minlength=w.n)
            score += np.bincount(row, weights=ratios.value[at], minlength=w.n) / np.maximum(grams, 1)
        failed = (n < 10) | (100 * again > 20 * n)
        return [pa.array(n), pa.array(chars[off[1:]] - chars[off[:-1]]), pa.array(marks[off[1:]] - marks[off[:-1]]),
                pa.array(lines, pa.int64()), pa.array(again), pa.array(failed), pa.array(score),
                pa.array(~failed & (score >= threshold))]
    return make


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  trusted_limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Every row of ``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality_score, kept``.

    A null or empty text has no words, score 0 and is not kept.  Equal texts get
    equal results.  Without any trusted document every score is 0 (only the base
    rules decide).  Own columns with those names are dropped; an empty table
    gives an empty table.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, trusted_limit))
    return with_arrow_columns(docs, ["text"], _judge(ratios, threshold), NEW)
