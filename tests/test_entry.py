"""The registry: every oracle has a query, and a sample of them agrees with DuckDB on the test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["ohlc_bars", "clean_bars", "log_returns", "reference_series", "ohlc_checks", "ewma_oos", "inverse_rmse_ensemble"])
def test_query_equals_oracle(spark, name):
    got = entry.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    events = f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{DATA}/events.parquet'"
    with duckdb.connect() as con:
        con.execute(events)
        want = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[c] for c in columns]) for r in rows)
