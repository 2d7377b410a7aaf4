"""Cross-tokenizer alignment: shared ends against sets, documents against the two libraries, corpus-wide counts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from itemscope.llm import alignment
from itemscope.llm.bpe import vocabulary_path

SCHEMA = "doc_id long, text string, block string, pair int, n_best string, used int, own0 string, count int"


def some_rows():
    r = random.Random(3)
    vocabulary = ["the", "Donaudampfschiff", "naïve", "don't", "x", "12345", "日本語", "été", "<|endoftext|>", "</s>", "👩‍🚀", "if(a)==b;", "\t", "\n\n", "a b"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " "), (203, "  two  spaces "), (204, "a▁b"), (205, "\x00\x01"), (206, "ﬁ ½ Å"),
             (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (207, "word another " * 12_000), (208, "q" * 70_000)]
    return rows


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    # the printable stand-ins of the byte-level alphabet
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = []
    for _, text in rows:
        if not text:
            out.append(([], [], []))
            continue
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        a_bytes = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                   for p in map(sp.id_to_piece, b)]
        whole = b" " + text.encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append(([], [], []))
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in side]).tolist(), range(len(side)))) for side in (a_bytes, b_bytes)]
        out.append((a, b, [(ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))]))
    counts = collections.Counter((a[i], b[j]) for a, b, links in out for i, j in links)
    top = collections.Counter()
    for (_, y), c in counts.items():
        top[y] = max(top[y], c)
    result = []
    for (doc_id, _), (a, b, links) in zip(rows, out):
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append((a[x:i + 1], b[y:j + 1]))
            x, y = i + 1, j + 1
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        ids = [(a[i], b[j]) for i, j in links]
        result.append((doc_id, len(a), len(b), len(groups), len(ids), sum(counts[k] == top[k[1]] for k in ids),
                       sum(counts[k] for k in ids), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return result


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3) for r in rows], SCHEMA)


def test_shared_ends_equal_set_intersection():
    r = random.Random(1)
    for _ in range(400):
        n = r.choice([1, 5, 70, 900])
        density = r.choice([(0.9, 0.9), (0.2, 0.9), (0.5, 0.03), (1, 1)])
        a, b = (sorted({i for i in range(n) if r.random() < d} | {n}) for d in density)
        x, y = alignment.shared_ends(np.array(a), np.array(b), lane=r.choice([2, 8, 64]), window=r.choice([2, 8]))
        both = sorted(set(a) & set(b))
        assert [a[i] for i in x] == both and [b[j] for j in y] == both
    assert [len(v) for v in alignment.shared_ends(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_alignment_equals_the_libraries(spark):
    rows = some_rows()
    out = alignment.align_documents(docs_of(spark, rows).repartition(3), block_bytes=5_000)
    assert out.columns[:3] == ["doc_id", "text", "block"] and out.columns.count("n_best") == 1
    got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_groups_rebuild_both_sides(spark):
    rows = some_rows()[:12]
    for r in alignment.align_documents(docs_of(spark, rows), groups=True).collect():
        flat = ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in r.groups)
        assert hashlib.sha256(flat.encode()).hexdigest() == r.groups_sha256
        assert sum(len(g.a) for g in r.groups) == r.n_a and sum(len(g.b) for g in r.groups) == r.n_b


def test_empty_table_and_tables_without_tokens(spark):
    assert alignment.align_documents(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
    got = alignment.align_documents(docs_of(spark, [(1, None), (2, "")])).collect()
    assert {(r.n_a, r.n_links, r.count_sum, r.n_best, r.groups_sha256) for r in got} == {(0, 0, 0, 0, "")}


def test_stretches_do_not_change_ids():
    import sentencepiece
    import tiktoken  # noqa: F401

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    r = random.Random(9)
    text = " ".join(r.choice(["été", "don't", "x ", "\n", "tail", "123", "日本"]) for _ in range(3000))
    assert len(alignment.stretches(text, 100)) > 20
    assert [i for p in alignment.stretches(text, 100) for i in sp.encode(p)] == sp.encode(text)
