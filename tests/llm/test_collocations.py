"""Phrase collocations: brute force over short texts, collisions of short fingerprints, edge rows, exact arithmetic."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from itemscope.llm import collocations as co

SCHEMA = "lang string, text string, k int, phrase string, a string, l int, r int, n int, score string, rank int"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def some_rows(n=250):
    r = random.Random(11)
    vocabulary = ["the", "New", "york", "Times", "été", "x", "ÉT", "a\x1cb", "to", "be"]
    common = ["New york times", "to  be\tOR not", "the the the the the", "x x"]
    rows = []
    for i in range(n):
        parts = [r.choice(common) if r.random() < 0.4 else " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 9)))
                 for _ in range(r.randint(1, 5))]
        rows.append((["en", "de", None, "und"][i % 4], r.choice([". ", ", ", " ", "\n", "!?", "\x0b"]).join(parts)))
    return rows + [("en", None), ("en", ""), ("fr", " \t.,"), ("en", rows[0][1]), ("en", rows[0][1]), ("en", "Zig zag " * 30_000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "a", 1, 2, 3, "s", 4) for r in rows], SCHEMA)


def brute(rows, min_count, top):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:i]] + c[p[i:]]), i, c[p[:i]], c[p[i:]]) for i in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("collided", [False, True])
def test_equals_brute_force(spark, monkeypatch, collided):
    """Both ways: ranked by fingerprints, and counted by the text after a count that the text does not confirm."""
    if collided:
        monkeypatch.setattr(co, "_verified", lambda *a: False)
    rows = some_rows()
    got = co.mine_phrases(docs_of(spark, rows).repartition(3), min_count=8, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 8, 25)


def test_wrong_counts_are_noticed(spark):
    chosen = spark.createDataFrame([(1, 5, 7, 8, 11, 12)], "fp long, a long, l long, r long, first long, rest long")

    def text(*rows):
        return spark.createDataFrame([(f, "en", p, n) for f, p, n in rows], "fp long, lang string, phrase string, f long")
    assert co._verified(chosen, text((1, "a b", 5), (11, "a", 7), (12, "b", 8), (99, "c", 1)))
    assert not co._verified(chosen, text((1, "a b", 4), (11, "a", 7), (12, "b", 8)))
    assert not co._verified(chosen, text((1, "a b", 5), (11, "a", 7)))
    assert not co._verified(chosen, text((1, "a b", 5), (11, "a", 6), (11, "z", 1), (12, "b", 8)))


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_phrases_of_one_fingerprint_are_split(bits):
    text = "one two three one two. two one three three"
    g = co.Grams(pa.array([text, text]), ["en", "de"], bits)
    found = collections.Counter()
    co.phrases(g, [np.full(1 << 10, ~np.uint64(0))] * 3, found)
    want = collections.Counter()
    for piece in ("one two three one two", "two one three three"):
        w = piece.split()
        for k in (1, 2, 3):
            for i in range(len(w) - k + 1):
                for lang in ("en", "de"):
                    want[lang, k, " ".join(w[i:i + k])] += 1
    merged = collections.Counter()
    for (_, lang, k, phrase), c in found.items():
        merged[lang, k, phrase] += c
    assert merged == want


def test_words_come_back_from_fingerprints():
    h = np.random.default_rng(2).integers(0, 2**63, 50, dtype=np.uint64)
    assert (co.unmix(co.mix(h)) == h).all()
    g = co.Grams(pa.array(["alpha beta gamma delta"]), ["fr"])
    words = g.word[None, :]
    salt = np.array([co.salt_of("fr")], np.uint64)
    for k in (1, 2, 3, 4):
        assert co.fingerprint(words[:, :k], salt)[0] == g.fingerprints(k)[0]


def test_pairs_that_share_a_fingerprint_stay_apart():
    fp, p = np.array([5, 5, 6, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    got = sorted(zip(*(x.tolist() for x in co.distinct_pairs(fp, p))))
    assert got == [(5, 1, 2), (5, 2, 1), (6, 1, 1)]
    again = co.distinct_pairs(*(np.array(x, np.uint64) for x in zip(*got, *got)))
    assert sorted(zip(*(x.tolist() for x in again))) == [(5, 1, 4), (5, 2, 2), (6, 1, 2)]


def test_small_buffers_give_the_same(spark, monkeypatch):
    rows = some_rows(60)
    for name, value in (("SLICE", 300), ("HELD", 50), ("HELD_PHRASES", 10)):
        monkeypatch.setattr(co, name, value)
    assert sorted(map(tuple, co.mine_phrases(docs_of(spark, rows), min_count=5, top=100).collect())) == brute(rows, 5, 100)


def test_empty_table_and_texts_without_phrases(spark):
    assert co.mine_phrases(docs_of(spark, [("en", "a b")]).limit(0)).count() == 0
    assert co.mine_phrases(docs_of(spark, [("en", None), (None, "one two")]), min_count=2).count() == 0


def test_fingerprints_do_not_depend_on_the_place():
    texts = ["tell me why tell\tme  why", "why", "x " * 50 + "Tell me WHY"]
    g = co.Grams(pa.array(texts), ["en", "en", "en"])
    words = [g.data[s:e].tobytes() for s, e in zip(g.start, g.end)]
    for k in (1, 2, 3, 4):
        seen = {}
        for i, (fp, ok) in enumerate(zip(g.fingerprints(k).tolist(), g.within(k))):
            if ok:
                assert seen.setdefault(tuple(words[i:i + k]), fp) == fp
        assert len(set(seen.values())) == len(seen)
    other = co.Grams(pa.array(texts), ["de", "de", "de"])
    assert not set(g.fingerprints(2).tolist()) & set(other.fingerprints(2).tolist())


def test_words_of_one_hash_are_split():
    g = co.Grams(pa.array(["aa bb aa cc bb"]), ["en"], bits=0)
    assert len(set(g.word.tolist())) == 1
    ids, words = co.word_ids(g, np.arange(5))
    assert [words[i] for i in ids] == ["aa", "bb", "aa", "cc", "bb"]


def test_scores_beyond_64_bits(spark):
    big = 1 << 60
    table = spark.createDataFrame([("en", 0, "", big), ("en", 1, "u", big), ("en", 1, "v", big - 1), ("en", 2, "u v", big - 2)],
                                  "lang string, k int, phrase string, f long")
    row = co.by_text(table, 10, 4, 80).collect()[0]
    assert (row.phrase, row.score, row.n) == ("u v", 2000000 * (big - 2) // (2 * big - 1), big)
