"""Driver contract: entry, queries and oracle SQL."""

import __spark_entry__ as entry


def test_queries_and_oracle_names_agree():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 80
    assert set(sql) <= set(qs)


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"split_id", "sampling", "n_items", "scenario", "mae", "max_err", "n_models"}
    assert all(0.0 <= r.mae <= 1.0 for r in rows)
