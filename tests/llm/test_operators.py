"""Training-data operators: edge rows, empty tables, clashing columns, brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemscope.llm import (bpe, graph, licenses, lm_scoring, mixing, ngram_jaccard, quality, suffix_dedup, topk,
                           toxicity, url_filters)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
COLUMNS = ("doc_id long, text string, source string, node long, key string, rid long, n_tokens string, "
           "n_words string, kept string, score string, __th string, n_bytes string, licenses int")


def some_docs(seed=5, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Alpha", "beta,", "γάμμα", "don't", "x", "moron", "12", "été"]
    base = [" ".join(r.choice(vocabulary) + str(r.randint(0, 40)) for _ in range(r.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = "edit" + str(r.randint(0, 99))
        rows.append((i, " ".join(t), f"s{i % 4}"))
    rows += [(100, None, None), (101, "", "s1"), (102, " \n\t ", "s1"), (103, "one", "s2"), (104, "one two three", "s2"),
             (105, "one two three", None), (None, base[0], "s0"), (106, base[0], "s0"), (106, base[0], "s0"),
             (107, "Zed " * 9000, "s3"), (108, "# " + base[1] + "\n" + base[1] + "\n" + base[1], "s3")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "a", "b", "c", "d", "e", "f", 3) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 60)] + [(None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def sets_of(rows, k):
    out = []
    for _, text, _ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute_components(rows, k, percent):
    s = sets_of(rows, k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((r[0], len(s[i]), min(ids) if ids else None))
    return s, out


def text_key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


@pytest.mark.parametrize("k,percent", [(4, 85), (1, 60)])
def test_jaccard_components(docs, rows, k, percent):
    _, want = brute_components(rows, k, percent)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.link_components(docs, k, percent).collect()]
    assert sorted(got, key=text_key) == sorted(want, key=text_key)


def test_jaccard_every_link(docs, rows):
    s = sets_of(rows, 2)
    want = {frozenset((frozenset(a), frozenset(b))) for a in s for b in s
            if a and b and a != b and 100 * len(a & b) >= 70 * len(a | b)}
    pairs, members = ngram_jaccard.similar_pairs(docs, 2, 70)
    of = {}
    for r in members.where("doc_id is not null").collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        of[r.node] = frozenset(sets_of([(0, text, "")], 2)[0])
    assert {frozenset((of[r.a], of[r.b])) for r in pairs.collect()} == want


def test_jaccard_keep_one(docs):
    kept = ngram_jaccard.keep_one(docs.where("doc_id is not null"), 4, 85)
    assert kept.columns == docs.columns
    found = ngram_jaccard.link_components(docs.where("doc_id is not null"), 4, 85).where("n_shingles > 0")
    want = {r[0] for r in found.select("component_id").distinct().collect()}
    assert sorted(r.doc_id for r in kept.where("doc_id not in (100,101,102)").collect()) == sorted(want)


def test_boundary_and_subset_sizes():
    assert ngram_jaccard.subset_sizes(12, 85) == [11, 12]
    for n in range(1, 40):
        for m in range(1, 40):
            if 100 * min(n, m) >= 85 * max(n, m):
                assert ngram_jaccard.overlap(n, m, 85) in ngram_jaccard.subset_sizes(n, 85)
                assert ngram_jaccard.prefix_size(n, 85) >= n - ngram_jaccard.overlap(n, m, 85) + 1
    assert 1 <= ngram_jaccard.boundary({5: 100, 30: 100}, 85) <= ngram_jaccard.MAX_LIGHT


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[3] == 1 and got[11] == 10 and got[140] == 100 and 5 not in got


PAGES = [(1, "http://a.org/x", '<link rel="canonical" href="https://bad.net/y">'), (2, "https://bad.net/y", ""),
         (3, "http://b.org/z", '<meta http-equiv="refresh" content="0; url=/fr/ok">'), (4, "http://b.org/fr/ok", None),
         (5, None, None), (6, "no scheme", ""), (7, "http://www.example.net/en/a?q", ""), (8, "http://example.net", ""),
         (9, "HTTP://Example.COM/de/", ""), (9, "HTTP://Example.COM/de/", ""), (10, "http://c.org/q", '<a href="http://d.net/">')]


def test_url_filters(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
           for r in url_filters.judge_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.org", "/x", None, "block")
    assert got[3] == ("b.org", "/z", None, "allow") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.net/en/", "allow") and got[8] == ("example.net", "", None, "allow")
    assert got[9] == ("example.com", "/de/", "example.com/de/", "block") and got[10][3] == "allow"


def test_lm_scoring(docs, rows):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = lm_scoring.score_documents(docs, train).collect()
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\0"] for _, t, _ in rows]
    taught = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _, _ in rows]
    c = collections.Counter(w for t, ok in zip(tokens, taught) if ok for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0), len(t), sum(c[w] > 0 for w in t),
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _, _), t in zip(rows, tokens))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_probabilities_add_up():
    import numpy as np
    r = np.random.default_rng(0)
    model = lm_scoring.Model([r.integers(0, 3, 1 << (b + 8)) for b in lm_scoring.TABLE_BITS])
    texts = np.arange(256, dtype=np.uint8)  # every one-byte text: their probabilities are one distribution
    cost = model.cost(texts, np.arange(257), np.arange(256))
    assert abs((10.0 ** cost).sum() - 1) < 1e-3


def fuzz():
    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", " \n ", "'s", "'re", "é", "ß", "漢", "12", "!", "...", "<|endoftext|>",
             "<|endo", "\x00", " ", "　", "😀", "I'm", "\r\n", "\x1f", "\u0085", "x" * 40, " " * 9]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 300))) for _ in range(200)]


@pytest.mark.parametrize("bits", [4, 10])
def test_bpe_equals_the_library(spark, rows, bits):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.vocabulary_path())
    texts = [*fuzz(), *(r[1] for r in rows)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.doc_id: r for r in bpe.encode_documents(df, cut_bits=bits).collect()}
    sums = {r.doc_id: r for r in bpe.encode_documents(df, digest=True, cut_bits=bits, reuse_bytes=1000).collect()}
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids
        plain = t.decode(want, skip_special_tokens=False)
        assert ids[i].ids == want and ids[i].decoded == plain and ids[i].n_tokens == len(want)
        assert sums[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert sums[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs, block_rows=7).collect()
    again = mixing.mix_sources(docs.repartition(5), block_rows=1000).collect()
    assert sorted(got, key=text_key) == sorted(again, key=text_key) and len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(size.values())), set(names)
    while left > 1e-9 and free:
        total, spare = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
        for s in list(free):
            if target[s] > 3 * size[s]:
                spare += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                free.discard(s)
        left = spare
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_top_k(spark):
    r = random.Random(1)
    vecs = [(i, [r.uniform(-1, 1) for _ in range(9)]) for i in range(130)]
    vecs += [(200 + i, vecs[7][1]) for i in range(30)] + [(7, vecs[7][1]), (300, None), (301, [None] * 9),
                                                          (302, [float("nan")] * 9), (303, [1.0, 2.0]), (None, vecs[0][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, embedding array<float>, score string")
    ints = topk.quantise(table)
    data = {r.vec_id: r.vec for r in ints.collect()}
    assert not {300, 301, 302} & set(data)
    want = {}
    for q in [i for i in data if i % 10 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(data[q], v)), i) for i, v in data.items() if i != q)[:10]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    got = collections.defaultdict(list)
    for x in topk.top_k(ints, ints.where("vec_id % 10 = 0")).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert {q: sorted(v) for q, v in got.items()} == want
    few = ints.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


def test_quality(docs, rows, labels):
    got = {}
    for r in quality.judge_quality(docs, labels).collect():
        got.setdefault((r.doc_id, r.text), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept))
    for i, text, _ in rows:
        w, seen, dup, grams = WORD.findall(text or ""), set(), 0, collections.defaultdict(list)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        for j in range(len(w) - 4):
            grams[tuple(w[j:j + 5])].append(j)
        again = len({x for v in grams.values() if len(v) > 1 for j in v for x in range(j, j + 5)})
        failed = len(w) < 10 or 100 * again > 20 * len(w)
        row = got[(i, text)]
        assert row[:6] == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, again, failed)
        assert not (failed and row[6])


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = collections.defaultdict(list)
    for k, b in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen[b[s:s + length]].append((k, s))
    gone = [bytearray(len(b)) for b in texts]
    for v in seen.values():
        if len(v) > 1:
            for k, s in v:
                gone[k][s:s + length] = b"\1" * length
    out = []
    for (i, _, _), b, g in zip(rows, texts, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for j in range(len(g)) if g[j] and (j == 0 or not g[j - 1]))
        out.append(((i is None, i or 0), len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,hot,together", [(30, 1 << 16, 1 << 15), (80, 3, 2), (400, 1 << 16, 50)])
def test_suffix_dedup(docs, rows, length, hot, together):
    got = suffix_dedup.remove_repeats(docs, length, hot, together)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, len(r.span_begin), r.kept_sha256)
                  for r in got.collect()) == brute_repeats(rows, length)


def test_licenses(spark, docs):
    grant = licenses.SENTENCES["mit.grant"] + ", to deal.\n# " + licenses.SENTENCES["mit.include"] + "."
    texts = ["Licensed under the Apache License,\n * Version 2.0.", grant, "x. Licensed under CC BY-NC 4.0. All Rights reserved",
             "no licence here", None, "", "permission is hereby granted"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert got == {0: "Apache-2.0", 1: "MIT", 2: "CC-BY-NC-4.0,all-rights-reserved", 3: "", 4: "", 5: "", 6: ""}
    assert licenses.scan_licenses(docs).count() == docs.count()
    words = licenses.triggers(licenses.SENTENCES)
    assert all(any(w in licenses.normalise(s).encode() for w in words) for s in licenses.SENTENCES.values())


def test_toxicity_nearest_is_exact():
    import numpy as np
    r = np.random.default_rng(2)
    terms = np.arange(40, dtype=np.int64)
    vectors = {}
    for d in range(500):
        at = r.choice(40, r.integers(1, 6), replace=False)
        v = r.random(len(at)) + 0.1
        vectors[d] = dict(zip(at.tolist(), (v / np.sqrt((v * v).sum())).tolist()))
    index = toxicity.Index(terms, np.ones(40), vectors, {d: d % 2 for d in vectors}, 0.1)
    for _ in range(60):
        at = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        v = index.vector(at, np.ones(len(at)))
        i, s = index.nearest(at, v, 15)
        full = np.array([sum(x * vectors[d].get(t, 0.0) for t, x in zip(at.tolist(), v)) for d in index.ids])
        want = np.lexsort((np.arange(len(full)), -np.round(full, 12)))[:15]
        want = want[full[want] > 0]
        assert np.allclose(s, full[want]) and len(i) == len(want)


def test_toxicity(spark, docs, labels):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    bad = [(i, ("zut idiot " if i % 4 == 0 else "fine ") + f"w{i} and so on {i * 7}") for i in range(200)]
    df = spark.createDataFrame(bad, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)], "doc_id long, toxic int")
    held = toxicity.score_toxicity(df, lab, train=F.col("doc_id") % 3 != 0).where("doc_id % 3 = 0").collect()
    assert all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held)


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.where("1 = 0"), labels.where("1 = 0")
    train = F.lit(True)
    for out in (ngram_jaccard.link_components(none), lm_scoring.score_documents(none, train),
                bpe.encode_documents(none), mixing.mix_sources(none), mixing.mixed_documents(none),
                quality.judge_quality(none, no_labels), suffix_dedup.remove_repeats(none),
                licenses.scan_licenses(none), toxicity.score_toxicity(none, no_labels),
                url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")),
                topk.top_k(*[spark.createDataFrame([], "vec_id long, vec array<bigint>")] * 2)):
        assert out.count() == 0
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, no_labels).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from itemscope.llm.common import read_table, stash
    d = "/root/testdata/sf0.001"
    given = read_table(spark, d, "documents")
    tables = [given]
    for _, stage in p.STAGES:
        tables.append(stash(stage(spark, tables[-1], d)))
    assert all(t.columns == given.columns for t in tables[1:-1])
    kept = quality.judge_quality(given, read_table(spark, d, "labels")).where("kept")
    assert sorted(r.doc_id for r in tables[1].collect()) == sorted(r.doc_id for r in kept.collect())
    rows = [(r.doc_id, r.text, r.source) for r in tables[1].collect()]
    _, comp = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted({c for _, n, c in comp if n})
    left = {(r.doc_id): r.text.encode() for r in tables[3].collect()}
    rows = [(r.doc_id, r.text, r.source) for r in tables[2].collect()]
    # the stage's own length (200 bytes: passages of 50 words), not that of the op8 query
    assert {i: len(t) for i, t in left.items()} == {k[1]: n - g for k, n, g, _, _ in brute_repeats(rows, p.PASSAGE_BYTES)}
    assert tables[5].count() == tables[4].count()
    assert tables[5].where("not exact").isEmpty()
    assert sorted(tables[5].columns) == sorted(p.run(spark, d).columns)


def test_toxicity_nearest_over_many_blocks():
    """Block-max search against brute force, over more blocks than the first steps visit."""
    BLOCK, FIRST, Index = toxicity.BLOCK, toxicity.FIRST, toxicity.Index

    rng = np.random.default_rng(3)
    n, terms = BLOCK * (FIRST * 5 + 3) + 7, 40
    vectors = {}
    for d in range(n):
        at = rng.choice(terms, rng.integers(1, 9), replace=False)
        v = rng.integers(1, 4, len(at)).astype(float)
        vectors[d] = dict(zip(at.tolist(), (v / np.sqrt((v * v).sum())).tolist()))
    index = Index(np.arange(terms), np.ones(terms), vectors, dict.fromkeys(vectors, 0), 0.5)
    for _ in range(50):
        at = np.sort(rng.choice(terms, rng.integers(1, 12), replace=False))
        v = index.vector(at, rng.integers(1, 5, len(at)))
        want = np.array([sum(x * vectors[d].get(t, 0.0) for t, x in zip(at.tolist(), v)) for d in index.ids.tolist()])
        places, sims = index.nearest(at, v, 15)
        assert np.allclose(sims, np.sort(want)[::-1][:15])
        assert np.allclose(want[places], sims)


def test_toxicity_against_cosines_of_whole_texts(spark, docs, labels):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: i % 3 == 0
    got = toxicity.score_toxicity(docs, labels, train=F.col("doc_id") % 3 != 0).collect()
    term = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    bags = [collections.Counter(term.findall((t or "").translate(LOWER))) for _, t in rows]
    df = collections.Counter(t for b in bags for t in b)
    vector = [{t: math.log1p(c) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, c in b.items()} for b in bags]
    length = [math.sqrt(sum(v * v for v in x.values())) for x in vector]
    label = {i: int(i % 5 == 0) for i in range(60) if not held(i)}
    first = {i: n for n, (i, _) in enumerate(rows) if i in label and vector[n]}
    base = sum(label.values()) / len(label)
    want = collections.defaultdict(set)
    for n, (i, text) in enumerate(rows):
        near = []
        for j, m in first.items():
            s = sum(v * vector[m].get(t, 0.0) for t, v in vector[n].items())
            if s > 0:
                near.append((s / length[n] / length[m], j))
        sims = sorted((s for s, _ in near), reverse=True)[:15]
        of = dict((j, s) for s, j in near)
        for r in (r for r in got if r.doc_id == i and r.text == text):
            assert np.allclose(r.similarities, sims) and np.allclose([of[j] for j in r.neighbours], sims)
            vote = sum(s * label[j] for s, j in zip(r.similarities, r.neighbours))
            assert abs(r.score - (vote + 0.5 * base) / (sum(sims) + 0.5)) < 1e-9
    # clean examples are neighbours too, and terms outside the examples count in a text's length
    assert {label[j] for r in got for j in r.neighbours} == {0, 1}
    assert any(t not in set().union(*(vector[m] for m in first.values())) for x in vector for t in x)


def test_toxicity_of_rare_insults(spark):
    """No insult is in more than two examples."""
    r = random.Random(4)
    rows = [(3 * i + j, f"you {insult} go away {insult} w{r.randrange(9)}", 1, j == 2)
            for i, insult in enumerate(f"insult{n}" for n in range(40)) for j in range(3)]
    rows += [(1000 + i, f"you may go there on w{r.randrange(9)} of month{i % 40}", 0, i % 3 == 2) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, x) for i, _, x, held in rows if not held], "doc_id long, toxic int")
    score = {x.doc_id: x.score for x in toxicity.score_toxicity(df, lab).collect()}
    held = [(score[i], x) for i, _, x, held in rows if held]
    assert min(s for s, x in held if x) > max(s for s, x in held if not x)


def test_licenses_of_several_notices(spark):
    s = licenses.SENTENCES
    gpl2, gpl3 = (f"{s['gpl.free']}; {s[v]}.\n{s['gpl.warranty']}.\n" for v in ("gpl.v2", "gpl.v3"))
    texts = {gpl2 + gpl3: "GPL-2.0-or-later,GPL-3.0-or-later",
             f"{s['gpl.free']}. {s['gpl.warranty']}. And below: {gpl3}": "GPL,GPL-3.0-or-later",
             f"{s['ccbync4.notice']}, parts {s['ccby4.notice']}": "CC-BY-NC-4.0,CC-BY-4.0",
             f"{s['reserved']}. {s['gpl.free']}. {s['reserved']}. {s['gpl.v3']}": "all-rights-reserved,GPL-3.0-or-later",
             f"{s['mit.notice']} {s['mit.notice']}": "MIT", "none": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i].every_licence for i in range(len(texts))] == list(texts.values())
    assert got[0].every_sentence == "gpl.free,gpl.v2,gpl.warranty,gpl.free,gpl.v3,gpl.warranty"
    assert got[4].every_sentence == "mit.notice,mit.notice" and got[4].n_sentences == 1


def test_lm_contexts_have_counts_of_their_own():
    """Different contexts have different keys, and a block's logits come from the counts of its own contexts."""
    r = np.random.default_rng(6)
    data = np.where(r.random(60_000) < 0.15, 32, r.integers(97, 123, 60_000)).astype(np.uint8)
    keys = lm_scoring.contexts(data, np.array([0, len(data)]))
    raw, word = bytes(4) + data.tobytes(), b""
    owner = {}
    for i in range(len(data)):
        for n, own in enumerate([raw[i + 2:i + 4], raw[i + 1:i + 4], raw[i:i + 4], word]):
            assert owner.setdefault(int(keys[n][i]), (n, own)) == (n, own)
        word = b"" if data[i] == 32 else word + data[i:i + 1].tobytes()
    assert len(owner) == len(set(owner.values())) > 1 << 16
    tree = lm_scoring.Tree(np.bincount(data, minlength=256))
    pair, count = np.unique(keys[2] | data.astype(np.uint64), return_counts=True)
    shift, known, table = lm_scoring.Model((pair, count), tree).parts[2]
    root = tree.children[-1]
    below = lambda x: {x} if x < 256 else below(tree.children[x - 256][0]) | below(tree.children[x - 256][1])
    for i in range(0, len(data), 997):
        follows = data[keys[2] == keys[2][i]].tolist()
        a, b = (sum(f in below(side) for f in follows) for side in root)
        got = table[(int(lm_scoring.Model.row(keys[2][i:i + 1], shift, known)[0]) << 8) + len(tree.children) - 1]
        assert abs(got - np.clip(np.rint(math.log((b + 0.3) / (a + 0.3)) * lm_scoring.SCALE), -127, 127)) <= 1
    assert lm_scoring.Model.row(np.array([256], np.uint64), shift, known).tolist() == [0]


def test_lm_mixing_runs_through_a_whole_text(monkeypatch):
    """One long text: what the mixer learned at the start still counts thousands of bits later."""
    line = np.frombuffer(b"abcabcabd " * 2000 + b"\n", np.uint8)
    keys = lm_scoring.contexts(line, np.array([0, len(line)]))
    pairs = [np.unique(k | line.astype(np.uint64), return_counts=True) for k in keys]
    counts = tuple(np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    model = lm_scoring.Model(counts, lm_scoring.Tree(np.bincount(line, minlength=256)))
    lanes, mixed = [], model._mix
    monkeypatch.setattr(model, "_mix", lambda x, bit, lo, hi: lanes.extend(zip(lo, hi)) or mixed(x, bit, lo, hi))
    cost = model.cost(line, np.array([0, len(line)]), np.arange(len(line)))
    assert len(lanes) == 1 and lanes[0][0] == 0 and lanes[0][1] > 2 * 2048
    tenth = len(line) // 10
    parts = -np.add.reduceat(cost[:-1], np.arange(0, 10) * tenth)
    assert parts[0] > parts[1] > parts[8]
