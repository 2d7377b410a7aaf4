"""A representative subset of the registered queries against their DuckDB twins
(the full set runs with tools/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tools.check_oracle import TABLES, close_rows, rows_of

SUBSET = ["pds_scores", "jsd_scores", "top_disagreement_stratified", "low_disagreement_stratified",
          "top_disagreement_global", "random_stratified", "quota", "balance_weights", "item_positions",
          "true_accuracy", "naive_estimate", "threshold_search", "guided_pds", "nearest_anchor_weights",
          "item_curve", "fisher_information", "mae_leaderboard", "spearman", "main_table", "table_diff",
          "parse_and_pad", "snapshot_merge", "irt_jsonl", "stream_pds", "sparse_true_accuracy"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = rows_of(df.columns, srows), rows_of(rel.columns, rel.fetchall())
    assert len(a) == len(b)
    assert a == b or close_rows(a, b)
