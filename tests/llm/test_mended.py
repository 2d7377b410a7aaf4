"""Cases that earlier gave a wrong or incomplete result without an error."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from itemscope.llm import lm_scoring, ngram_jaccard, suffix_dedup, url_filters


def test_links_through_a_row_without_id(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = w[:50], w[2:52], w[4:54]      # neighbours share 47 of 51 shingles less two; a and c are too far apart
    docs = spark.createDataFrame([(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (9, "other words are here now")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.link_components(docs, 4, 88).collect()}
    assert got == {1: 1, None: 1, 2: 1, 9: 9}


def test_long_words_cost_by_their_length(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(40))) for i in range(30)]
    sizes = (200, 2_000, 20_000)
    rows += [(1000 + n, "".join(r.choice(letters) for _ in range(n))) for n in sizes]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.bits_per_byte for x in lm_scoring.score_documents(docs, F.col("doc_id") < 1000).collect()}
    bits = [got[1000 + n] for n in sizes]
    assert min(bits) > 3 and max(bits) < 8


def test_no_bit_has_probability_zero():
    n = 3000
    x = np.full((n, 4), 127, np.int8)
    bit = np.zeros(n, np.int8)
    bit[-1] = 1
    data = np.frombuffer(b"ab " * 100, np.uint8)
    model = lm_scoring.Model((np.zeros(0, np.uint64), np.zeros(0, np.int64)), lm_scoring.Tree(np.bincount(data, minlength=256)))
    for wanted in (bit, 1 - bit):
        chance = model._mix(x, wanted, np.array([0]), np.array([n]))
        assert (chance > 0).all() and (chance <= 1).all()


def test_hosts_with_many_labels(spark):
    host = ".".join(["a"] * 4_000) + ".example.net"
    urls = spark.createDataFrame([(host, "/en/x"), ("org", "/fr/"), ("xorg", "/fr/")], "host string, path string")
    rules = spark.createDataFrame(list(url_filters.RULES), "action string, host string, path string")
    start = time.time()
    got = {r.host[-11:]: (r.rule, r.action) for r in url_filters.match_rules(urls, rules).collect()}
    assert got == {"example.net": ("example.net/en/", "allow"), "org": ("org/fr/", "allow")}
    assert time.time() - start < 20


def test_repeats_of_other_lengths(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(45))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(30)) + "\n" + passage + "\n" + word()) for i in range(6)]
                                 + [(9, " ".join(word() for _ in range(80)))], "doc_id long, text string")
    for length, gone in ((200, 6), (400, 0)):
        out = suffix_dedup.remove_repeats(docs, length).collect()
        assert sum(x.n_removed >= len(passage) for x in out) == gone
        assert all(passage not in x.kept_text for x in out) == (gone == 6)
        assert next(x.n_removed for x in out if x.doc_id == 9) == 0
