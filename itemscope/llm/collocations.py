"""Phrase collocations from Rabin-Karp fingerprints of word n-grams.

Prefix polynomials over a slice's bytes give the hash of every word, prefix
polynomials over the word hashes the fingerprint of every n-gram: two look-ups
and a product each, for all positions at once.  Tasks aggregate fingerprints
before the shuffle adds them up; a row carries the fingerprint of the n-gram and
of its first n-1 words, so an n-gram is told apart by 128 bits, and the words of a
frequent one can be worked out from its fingerprint and its prefix's row.

Lengths are counted one after the other, because a phrase found ``min_count``
times has only parts found as often: an n-gram is counted only where both its
(n-1)-grams may be frequent.  That is asked of a bitmap of the frequent
fingerprints, made by Spark as grouped bit-wise ors; its size follows their number
up to a fixed bound (``MAX_BITS``).  A bit set by another fingerprint lets a phrase
through that the exact count drops later, so nothing is lost at any fill.

Cuts, scores and covered phrases are joins of fingerprints.  Only the phrases that
may be reported and the parts of their cuts are materialised: a last pass takes
their occurrences by their pointers (the places in the text), compares every one
with the first of its fingerprint (words by their bytes, n-grams by their words)
and writes the phrase with its number of occurrences.  If a count by the text
differs from the one by fingerprints, two phrases have collided, and everything is
counted again by the text itself (``count_phrases``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemscope.llm.common import BYTE_VALUES, LOWER, STEP, mix, powers, signed, slices, stash, text_bytes

MIN_COUNT = 30
TOP = 2000
MAX_WORDS = 4
#: A part of a phrase is covered by a longer phrase that has this share (in hundredths) of its occurrences.
COVER = 80
#: Bits of a bitmap: so many per frequent fingerprint, and at most (16 MB).
BITS_EACH, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 27
#: Text that is hashed at once, fingerprints and phrases that a task holds before it passes them on.
SLICE = 2 << 20
HELD, HELD_PHRASES = 1_500_000, 400_000
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))

ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
ENDS_WORD = ENDS_PIECE.copy()
ENDS_WORD[[0x20, 0x09]] = True

_scales: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for n + 1 positions."""
    if len(_scales[0]) <= n:
        _scales[:] = [powers(n + 1), powers(n + 1, BACK)]
    return _scales[0], _scales[1]


class Grams:
    """Words of a slice of texts and the fingerprints of their n-grams."""

    def __init__(self, texts: pa.Array, langs: list[str], bits: int = 64):
        raw, off = text_bytes(texts)
        self.data = data = LOWER[raw]
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[off] = True
        gap = ENDS_WORD[data]
        before = np.concatenate([[True], gap[:-1]])[:n] | begins[:n]
        after = np.concatenate([gap[1:], [True]])[:n] | begins[1:]
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.piece = np.cumsum(ENDS_PIECE[data] | begins[:n])[self.start]
        self.names = sorted(set(langs))
        code = {x: i for i, x in enumerate(self.names)}
        doc = np.searchsorted(off, self.start, "right") - 1
        self.lang = np.array([code[x] for x in langs], np.int64)[doc]
        salt = np.array([salt_of(x) for x in self.names], np.uint64)
        self.mask = np.uint64((1 << bits) - 1)
        with np.errstate(over="ignore"):
            up, down = scales(max(n, 1))
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data] * up[:n], out=prefix[1:])
            word = (prefix[self.end] - prefix[self.start]) * down[self.start]
            self.word = mix(word + (self.end - self.start).astype(np.uint64)) & self.mask
            m = len(word)
            self.down = down[:m]
            self.prefix = np.zeros(m + 1, np.uint64)
            np.cumsum(self.word * up[:m], out=self.prefix[1:])
            self.salt = salt[self.lang] if m else np.zeros(0, np.uint64)

    def fingerprints(self, k: int) -> np.ndarray:
        """Fingerprint of the k words from every word on (of the words of the slice, pieces not looked at)."""
        m = len(self.word) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            gram = (self.prefix[k:] - self.prefix[:m]) * self.down[:m]
            return (mix(gram + np.uint64(k)) ^ self.salt[:m]) & self.mask

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from every word on stand in one piece."""
        m = len(self.word) - k + 1
        return self.piece[:m] == self.piece[k - 1:] if m > 0 else np.zeros(0, bool)


def may_hold(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    at = fingerprints & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _grams(batches: Iterator[pa.RecordBatch], bits: int, size: int) -> Iterator[Grams]:
    for part in slices(batches, "text", size):
        yield Grams(part.column("text"), part.column("lang").to_pylist(), bits)


def _bitmaps(shared: list) -> list[np.ndarray]:
    return [np.frombuffer(b.value, np.uint64) for b in shared]


def distinct_pairs(fp: np.ndarray, p: np.ndarray, c: np.ndarray | None = None):
    """Distinct (fp, p) with their counts; sorting by ``fp`` is enough unless two of them meet in it."""
    _, first, place, times = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
    if (p != p[first][place]).any():
        _, first, place, times = np.unique(np.stack([fp, p]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    return fp[first], p[first], times if c is None else np.bincount(place, c, len(first)).astype(np.int64)


def _count(docs: DataFrame, k: int, shared: list) -> DataFrame:
    """``(fp, p, c)`` of the k-grams whose (k-1)-grams may all be frequent, added up within the task first.

    ``p`` is the fingerprint of the first k-1 words.  For k = 1 it is the word's hash, there is a
    ``lang``, and a row without ``fp`` has all words of the language.
    """
    def out(fp, p, c, lang=None):
        for lo in range(0, len(fp), 200_000):
            part = slice(lo, lo + 200_000)
            columns = [pa.array(signed(fp[part])), pa.array(signed(p[part])), pa.array(c[part].astype(np.int64))]
            if lang is not None:
                columns.append(pa.array([lang] * len(columns[0])))
            yield pa.RecordBatch.from_arrays(columns, names)

    def words(batches):
        held, size, total = {}, 0, Counter()
        for g in _grams(batches, 64, SLICE):
            fp = g.fingerprints(1)
            for x, name in enumerate(g.names):
                own = g.lang == x
                total[name] += int(own.sum())
                held.setdefault(name, []).append(distinct_pairs(fp[own], g.word[own]))
                size += len(held[name][-1][0])
            if size > HELD:
                for name, parts in held.items():
                    yield from out(*distinct_pairs(*map(np.concatenate, zip(*parts))), name)
                held, size = {}, 0
        for name, parts in held.items():
            yield from out(*distinct_pairs(*map(np.concatenate, zip(*parts))), name)
        n = len(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(total.values()), pa.int64()),
                                          pa.array(list(total), pa.string())], names)

    def longer(batches):
        shorter = _bitmaps(shared)[-1]
        held, size = [], 0
        for g in _grams(batches, 64, SLICE):
            fp, before = g.fingerprints(k), g.fingerprints(k - 1)
            part = may_hold(shorter, before)
            fits = g.within(k) & part[:-1][:len(fp)] & part[1:][:len(fp)]
            held.append(distinct_pairs(fp[fits], before[:len(fp)][fits]))
            size += len(held[-1][0])
            if size > HELD:
                held = [distinct_pairs(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*distinct_pairs(*map(np.concatenate, zip(*held))))

    names = ["fp", "p", "c", "lang"] if k == 1 else ["fp", "p", "c"]
    schema = "fp long, p long, c long" + ", lang string" * (k == 1)
    keys = [n for n in names if n != "c"]
    return docs.mapInArrow(words if k == 1 else longer, schema).groupBy(*keys).agg(F.sum("c").alias("c"))


def _bitmap(frequent: DataFrame) -> bytes:
    """A bitmap of the fingerprints ``fp``: at most MAX_BITS / 64 grouped words reach the driver."""
    n = frequent.count()
    size = MIN_BITS
    while size < min(MAX_BITS, BITS_EACH * n):
        size *= 2
    at = F.col("fp").bitwiseAND(F.lit(size - 1))
    words = (frequent.select(F.shiftright(at, 6).cast("int").alias("i"),
                             F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                             at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
             .groupBy("i").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(size // 64, np.uint64)
    out[words["i"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out.tobytes()


def word_ids(g: Grams, at: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Numbers of the words ``at`` that are equal exactly where the words' bytes are, and each number's word."""
    _, first, ids = np.unique(g.word[at], return_index=True, return_inverse=True)
    start, size = g.start[at], (g.end - g.start)[at]
    model = first[ids]
    same = size == size[model]
    if same.all() and len(at):
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = g.data[np.repeat(start, size) + step] == g.data[np.repeat(start[model], size) + step]
    if not same.all():  # two words of one hash: number them by their bytes
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(g.data[s:s + n].tobytes(), len(seen)) for s, n in zip(start, size)], np.int64)
        return ids, [w.decode() for w in seen]
    raw = g.data.tobytes()
    return ids, [raw[s:s + n].decode() for s, n in zip(start[first].tolist(), size[first].tolist())]


def phrases(g: Grams, bitmaps: list[np.ndarray], into: Counter) -> None:
    """Add the slice's occurrences of the bitmaps' phrases to ``into``: (fingerprint, lang, number of words, phrase)."""
    n = len(g.word)
    places, covered = [], np.zeros(n + 1, np.int64)
    for k, bitmap in enumerate(bitmaps[:n], 1):
        at = np.flatnonzero(may_hold(bitmap, g.fingerprints(k)) & g.within(k))
        places.append(at)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + k, -1)
    ids = np.full(n, -1, np.int64)
    used = np.flatnonzero(np.cumsum(covered)[:n])
    ids[used], words = word_ids(g, used)
    for k, at in enumerate(places, 1):
        fp = g.fingerprints(k)[at]
        _, first, place, times = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        columns = [g.lang[at], *[ids[at + j] for j in range(k)]]
        if any((c != c[first][place]).any() for c in columns):  # two phrases of one fingerprint
            _, first, times = np.unique(np.stack(columns), axis=1, return_index=True, return_counts=True)
        lang, *parts = [c[first].tolist() for c in columns]
        for f, x, c, *p in zip(signed(fp[first]).tolist(), lang, times.tolist(), *parts):
            into[f, g.names[x], k, " ".join([words[i] for i in p])] += c


def _materialised(docs: DataFrame, shared: list, bits: int = 64) -> DataFrame:
    """``(fp, lang, k, phrase, f)`` of the phrases that the bitmaps let through, counted by the text."""
    def run(batches):
        bitmaps = _bitmaps(shared)
        found: Counter = Counter()

        def out():
            rows = list(found.items())
            for lo in range(0, len(rows), 50_000):
                keys, counts = zip(*rows[lo:lo + 50_000])
                fp, lang, k, phrase = zip(*keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp, pa.int64()), pa.array(lang, pa.string()), pa.array(k, pa.int32()),
                     pa.array(phrase, pa.string()), pa.array(counts, pa.int64())], ["fp", "lang", "k", "phrase", "c"])
            found.clear()

        for g in _grams(batches, bits, SLICE):
            phrases(g, bitmaps, found)
            if len(found) > HELD_PHRASES:
                yield from out()
        yield from out()
    return docs.mapInArrow(run, "fp long, lang string, k int, phrase string, c long").groupBy(
        "fp", "lang", "k", "phrase").agg(F.sum("c").alias("f"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text"))


def _levels(own: DataFrame, min_count: int, max_words: int) -> tuple[list[DataFrame], list, DataFrame]:
    """Tables of the frequent n-grams by length, their bitmaps, and the languages' numbers of words."""
    tables, shared, totals = [], [], None
    for k in range(1, max_words + 1):
        counted = _count(own, k, shared)
        if k == 1:
            counted = stash(counted.where((F.col("c") >= min_count) | F.col("fp").isNull()))
            totals = counted.where("fp is null").select("lang", F.col("c").alias("n"))
            tables.append(counted.where("fp is not null"))
        else:
            tables.append(stash(counted.where(F.col("c") >= min_count)))
        shared.append(own.sparkSession.sparkContext.broadcast(_bitmap(tables[-1])))
    return tables, shared, totals


def count_phrases(docs: DataFrame, shared: list, totals: DataFrame, min_count: int) -> DataFrame:
    """``(lang, k, phrase, f)`` of every phrase found ``min_count`` times or more in its language, counted by the
    text, and one row a language with k = 0: all its word occurrences."""
    counted = _materialised(_texts(docs), shared).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= min_count).unionByName(
        totals.select("lang", F.lit(0).alias("k"), F.lit("").alias("phrase"), F.col("n").alias("f")))


def cut_score() -> Column:
    """In decimals, as the condition below: the products may pass 64 bits."""
    return F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")


def uncovered(cover: int) -> Column:
    return F.expr(f"covered is null or 100 * cast(covered as decimal(20, 0)) < {cover} * cast(a as decimal(20, 0))")


def _ranked(scored: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = totals.withColumnRenamed("lang", "lang_n")     # one row a language
    return ranked.join(totals, F.col("lang") == F.col("lang_n")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _part(words: Column, first: int, length: int) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def by_text(table: DataFrame, top: int, max_words: int, cover: int) -> DataFrame:
    """The result from phrases counted by the text (``count_phrases``)."""
    words = F.split("phrase", " ")
    candidates = table.where("k >= 2").withColumnRenamed("f", "a")
    cuts = F.array(*[F.when(F.col("k") > i, F.struct(F.lit(i).alias("cut"), _part(words, 1, i).alias("first"),
                                                     F.array_join(F.slice(words, F.lit(i + 1), F.col("k") - i), " ").alias("rest")))
                     for i in range(1, max_words)])
    each = candidates.select("lang", "phrase", "a", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("c"))
    each = each.select("lang", "phrase", "a", "c.cut", "c.first", "c.rest")
    left = table.where(f"k between 1 and {max_words - 1}").select(
        F.col("lang").alias("lang_l"), F.col("phrase").alias("first_l"), F.col("f").alias("l"))
    right = left.toDF("lang_r", "rest_r", "r")
    scored = (each.join(left, (F.col("lang") == F.col("lang_l")) & (F.col("first") == F.col("first_l")))
              .join(right, (F.col("lang") == F.col("lang_r")) & (F.col("rest") == F.col("rest_r"))))
    best = (scored.withColumn("score", cut_score()).groupBy("lang", "phrase")
            .agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s")))
    sizes = [(at, size) for size in range(2, max_words) for at in range(1, max_words - size + 2)]
    inner = F.array(*[F.when((F.col("k") > size) & (F.col("k") >= at + size - 1), _part(words, at, size)) for at, size in sizes])
    longer = (candidates.where("k >= 3").select("lang", "a", F.explode(F.filter(inner, lambda p: p.isNotNull())).alias("part"))
              .groupBy(F.col("lang").alias("lang_o"), "part").agg(F.max("a").alias("covered")))
    left_over = (best.join(longer, (F.col("lang") == F.col("lang_o")) & (F.col("phrase") == F.col("part")), "left")
                 .where(uncovered(cover)))
    totals = table.where("k = 0").select("lang", F.col("f").alias("n"))
    return _ranked(left_over.select("lang", "phrase", "a", "s.l", "s.r", "s.score"), totals, top)


# ------------------------------------------------------------------ the same in fingerprints
def unmix(h: np.ndarray) -> np.ndarray:
    """Inverse of ``mix``."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
        h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
        h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def salt_of(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def fingerprint(words: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Fingerprints of n-grams given as rows of word hashes."""
    k = words.shape[1]
    with np.errstate(over="ignore"):
        return mix((words * powers(k)[:k]).sum(1, dtype=np.uint64) + np.uint64(k)) ^ salt


def _with_words(level: DataFrame, shorter: DataFrame, k: int, max_words: int) -> DataFrame:
    """Frequent k-grams with the hashes of their words, and the fingerprints of the parts of their cuts and within them."""
    joined = level.select("fp", "p", "c").join(shorter.select(F.col("fp").alias("q"), "lang", F.col("words").alias("w")), F.col("p") == F.col("q"))
    inner = [(at, size) for size in range(2, k) for at in range(k - size + 1)]

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            names = b.column("lang").to_pylist()
            salts = {x: salt_of(x) for x in set(names)}
            salt = np.array([salts[x] for x in names], np.uint64)
            w = np.array(b.column("w").to_pylist(), np.int64).reshape(len(fp), k - 1).view(np.uint64)
            with np.errstate(over="ignore"):
                rest = unmix(fp ^ salt) - np.uint64(k) - (w * powers(k)[:k - 1]).sum(1, dtype=np.uint64)
                w = np.column_stack([w, rest * powers(k, BACK)[k - 1]])

            def prints(spans):
                columns = [signed(fingerprint(w[:, x:y], salt)) for x, y in spans]
                return pa.array(np.column_stack(columns).tolist() if columns else [[]] * len(fp), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("fp"), b.column("c"), b.column("lang"), pa.array(signed(w.ravel()).reshape(w.shape).tolist(), pa.list_(pa.int64())),
                 prints([(0, i) for i in range(1, k)]), prints([(i, k) for i in range(1, k)]),
                 prints([(at, at + size) for at, size in inner])], ["fp", "a", "lang", "words", "firsts", "rests", "inner"])
    schema = "fp long, a long, lang string, words array<long>, firsts array<long>, rests array<long>, inner array<long>"
    return joined.select("fp", "c", "lang", "w").mapInArrow(run, schema)


def _top_by_fingerprint(tables: list[DataFrame], top: int, max_words: int, cover: int) -> DataFrame:
    """Phrases that may be among a language's ``top``: all down to the score and count of the last place."""
    grams = [tables[0].select("fp", "lang", F.array("p").alias("words"))]
    for k in range(2, max_words + 1):
        grams.append(stash(_with_words(tables[k - 1], grams[-1], k, max_words)))
    counts = tables[0].select("fp", "c")
    for t in tables[1:-1]:
        counts = counts.unionByName(t.select("fp", "c"))
    candidates = grams[1].withColumn("k", F.lit(2))
    for k, g in enumerate(grams[2:], 3):
        candidates = candidates.unionByName(g.withColumn("k", F.lit(k)))
    each = candidates.select("fp", "lang", "k", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("cut", "z")).select(
        "fp", "lang", "k", "a", (F.col("cut") + 1).alias("cut"), F.col("z.firsts").alias("first"), F.col("z.rests").alias("rest"))
    left, right = counts.toDF("fp_l", "l"), counts.toDF("fp_r", "r")
    scored = each.join(left, F.col("first") == F.col("fp_l")).join(right, F.col("rest") == F.col("fp_r"))
    best = (scored.withColumn("score", cut_score()).groupBy("fp", "lang", "k", "a")
            .agg(F.min(F.struct("score", "cut", "l", "r", "first", "rest")).alias("s")))
    longer = candidates.where("k >= 3").select("a", F.explode("inner").alias("part")).groupBy("part").agg(F.max("a").alias("covered"))
    alone = best.join(longer, F.col("fp") == F.col("part"), "left").where(uncovered(cover))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    return alone.select("fp", "lang", "k", "a", "s.*").withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")


def _verified(chosen: DataFrame, found: DataFrame) -> bool:
    """Whether every chosen phrase and part stands in the text exactly as often as its fingerprint was counted."""
    need = (chosen.select("fp", F.col("a").alias("c")).unionByName(chosen.select(F.col("first").alias("fp"), F.col("l").alias("c")))
            .unionByName(chosen.select(F.col("rest").alias("fp"), F.col("r").alias("c"))).distinct())
    seen = found.groupBy(F.col("fp").alias("seen")).agg(F.sum("f").alias("f"), F.count("*").alias("phrases"))
    wrong = need.join(seen, F.col("fp") == F.col("seen"), "left").where("f is null or f <> c or phrases > 1")
    return wrong.isEmpty()


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, max_words: int = MAX_WORDS,
                 cover: int = COVER) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``max_words`` words.

    A phrase found a >= ``min_count`` times is cut after its first 1, 2, ... words
    into parts found l and r times; its score is the lowest ``floor(2000000 a / (l + r))``
    of its cuts (the first of equal ones).  A phrase inside a longer one that has
    ``cover`` hundredths of its occurrences is left out.  Ties go by a and then by the
    phrase's bytes.  Null texts have no words, a null language is ``und``, repeated
    rows count as often as they stand there; an empty table gives an empty table.
    Text may be of any length: phrases never cross ``.,;:!?`` or line ends, only
    spaces and tabs separate words.
    """
    own = _texts(docs)
    tables, shared, totals = _levels(own, min_count, max_words)
    chosen = stash(_top_by_fingerprint(tables, top, max_words, cover))
    wanted = []
    for k in range(1, max_words + 1):
        some = chosen.where(F.col("k") == k).select("fp").unionByName(
            chosen.where(F.col("cut") == k).select(F.col("first").alias("fp"))).unionByName(
            chosen.where(F.col("k") - F.col("cut") == k).select(F.col("rest").alias("fp")))
        wanted.append(docs.sparkSession.sparkContext.broadcast(_bitmap(some.distinct())))
    found = stash(_materialised(own, wanted))
    if not _verified(chosen, found):
        return by_text(stash(count_phrases(docs, shared, totals, min_count)), top, max_words, cover)
    named = chosen.join(found.select(F.col("fp").alias("fp_t"), "phrase"), F.col("fp") == F.col("fp_t"))
    return _ranked(named.select("lang", "phrase", "a", "l", "r", "score"), totals, top)
