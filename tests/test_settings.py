"""Registered fits and training run with the operators' own settings, and summaries report what was fitted."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from volpanel.jobs import queries

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_training_goes_beyond_40_epochs(spark):
    rows = entry.queries()["gate_history"](spark, str(DATA)).collect()
    assert max(r["best_epoch"] for r in rows) > 40


def test_fits_end_and_the_summary_is_theirs(spark):
    fits = {(r["asset"], r["model"]): r["converged"] for r in queries.fitted(spark, str(DATA)).collect()}
    assert all(done for (_, model), done in fits.items() if model == "GARCH")
    rows = entry.queries()["fitted_summary"](spark, str(DATA)).collect()
    assert rows and all((r["garch"], r["egarch"], r["gjr_garch"]) == tuple(fits[r["asset"], m] for m in ("GARCH", "EGARCH", "GJR-GARCH")) for r in rows)
    assert any(r["n_passed"] < 4 for r in rows)


def test_lookback_grid_of_all_models(spark):
    got = entry.queries()["lookback_grid_all"](spark, str(DATA)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
        want = con.execute(entry.oracle_sql()["lookback_grid_all"]).fetchall()
    assert len(got) == 60 and sorted(tuple(r) for r in got) == [pytest.approx(w) for w in sorted(want)]
