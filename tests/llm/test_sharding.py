"""Hilbert-curve sharding: the curve itself, equal shards, edge rows, hot groups, files."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from itemscope.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, size string, curve int, own0 string, rank int, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = [(i, "word " * (i % 37) + "é" * (i % 3), ["en", "de", "fr", None][i % 4], f"s{i % 7}") for i in range(300)]
    out += [(1000 + i, "one copy of many", "en", "s0") for i in range(200)]
    return out + [(None, None, None, None), (5, "", "en", None), (5, "", "en", None), (7, "z" * 100_000, "en", "s1")]


@pytest.mark.parametrize("bits,axes", [(3, 2), (2, 3), (1, 4)])
def test_hilbert_index_visits_neighbours(spark, bits, axes):
    names = [f"a{i}" for i in range(axes)]
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=axes)), ", ".join(f"{n} int" for n in names))
    got = sorted((r.h, r[:axes]) for r in sharding.hilbert_index(cells, names, bits, "h").collect())
    assert [h for h, _ in got] == list(range(1 << bits * axes))
    for (_, a), (_, b) in zip(got, got[1:]):
        assert sum(abs(x - y) for x, y in zip(a, b)) == 1


def test_shards_are_equal_runs_of_the_curve(spark, rows):
    got = sharding.shard_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        text = {(a, b): t for a, t, b, _ in rows}
        assert r.size == len((r.text or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(24)) and max(sizes) - min(sizes) <= 1
    ordered = []
    for s in range(24):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        ordered += sorted(by[s], key=lambda r: r.slot)
    keys = [(r.curve, r.size, r.text_crc32, -1 if r.doc_id is None else r.doc_id) for r in ordered]
    assert keys == sorted(keys)
    # copies of one cell are neighbours
    at = [i for i, r in enumerate(ordered) if r.text == "one copy of many"]
    assert at[-1] - at[0] == len(at) - 1


def test_partitioning_does_not_matter(spark, rows):
    def run(df):
        return sorted(map(str, sharding.shard_documents(df, keep=["doc_id", "lang", "source"]).collect()))
    assert run(table(spark, rows)) == run(table(spark, rows[::-1]).repartition(7))


def test_shards_of_few_rows_and_empty_table(spark, rows):
    assert sharding.shard_documents(table(spark, rows).limit(0)).count() == 0
    few = sharding.shard_documents(table(spark, rows[:5])).collect()
    assert len({r.shard for r in few}) == 5 and {r.slot for r in few} == {0}


def test_ranges_prune_and_files(spark, rows, tmp_path):
    out = sharding.shard_documents(table(spark, rows))
    boxes = sharding.shard_ranges(out, ["lang", "source"]).collect()
    assert sum(b.n_docs for b in boxes) == len(rows)
    # a reader of one language and source opens fewer shards than there are
    hit = [b for b in boxes if b.min_lang is not None and b.min_lang <= "de" <= b.max_lang and b.min_source <= "s3" <= b.max_source]
    holds = out.where("lang = 'de' and source = 's3'").select("shard").distinct().collect()
    assert {r.shard for r in holds} <= {b.shard for b in hit} and len(hit) < 24
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows)
    assert back.agg(F.countDistinct("shard")).first()[0] == 24
