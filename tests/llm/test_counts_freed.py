"""Summed counts of the language model leave the disk before the texts are scored."""

import glob

import pytest
from pyspark.sql import functions as F

lm = pytest.importorskip("itemscope.llm.lm_scoring")


def test_summed_counts_are_deleted(spark, monkeypatch):
    tables = []
    stash = lm.stash

    def watched(df, *args, **kwargs):
        tables.append(stash(df, *args, **kwargs))
        return tables[-1]
    monkeypatch.setattr(lm, "stash", watched)
    docs = spark.createDataFrame([(i, f"some words of text {i % 3} and more") for i in range(20)], "doc_id long, text string")
    scored = lm.score_documents(docs, F.col("doc_id") % 7 != 2)
    counts = next(t for t in tables if "kind" in t.columns)
    path = counts._stash_path.replace("file:", "")
    assert glob.glob(f"{path}/kind=1/*.parquet") and not glob.glob(f"{path}/kind=2/*")
    rows = scored.collect()
    assert len(rows) == 20 and all(r.score < 0 for r in rows)
