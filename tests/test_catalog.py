"""Registered queries against their SQL on the smallest tables. `scripts/check_oracles.py` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry

SAMPLE = ("panel_sum", "gapfill_zero", "feat_rolling", "predictions_table", "metrics_basic", "model_ranking", "role_assign",
          "dq_outliers", "series_readiness", "permutation_importance", "gbm_stats")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def rows(names, records):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return sorted(repr([r[i] for i in at]) for r in records)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
