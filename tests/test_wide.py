"""Queries over the panel that grows with the tables, against DuckDB and over several blocks."""

import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from volpanel.jobs import queries
from volpanel.jobs.oracles import WIDE
from volpanel.operators.blocks import BLOCK_ROWS
from volpanel.sources.schema import Calendar

ROOT = Path("/root/testdata")


def key(row):
    return tuple(str(row[c]) for c in ("asset", "date", "model", "target", "split") if c in row)


@pytest.mark.skipif(not ROOT.exists(), reason="no test tables")
@pytest.mark.parametrize("name", WIDE)
def test_wide_query_equals_oracle(spark, name):
    folder = ROOT / "sf0.001"
    got = [r.asDict() for r in entry.queries()[f"wide_{name}"](spark, str(folder)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        want = con.execute(entry.oracle_sql()[f"wide_{name}"])
        names = [c[0] for c in want.description]
        rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert rows and len(got) == len(rows)
    for a, b in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert set(a) == set(b) and key(a) == key(b)
        assert {c: v for c, v in a.items() if not isinstance(v, float)} == {c: v for c, v in b.items() if not isinstance(v, float)}
        assert all(a[c] == pytest.approx(v, rel=1e-6, abs=2e-6) for c, v in b.items() if isinstance(v, float))


@pytest.mark.skipif(not ROOT.exists(), reason="no test tables")
def test_wide_panel_grows_and_fills_several_blocks(spark):
    sizes = {sf: queries.wide_panel(spark, str(ROOT / sf)).groupBy("asset").agg(F.count("*").alias("n")).collect() for sf in ("sf0.001", "sf0.01")}
    assert max(r["n"] for r in sizes["sf0.01"]) > BLOCK_ROWS
    assert len(sizes["sf0.01"]) > 5 * len(sizes["sf0.001"]) and sum(r["n"] for r in sizes["sf0.01"]) > 5 * sum(r["n"] for r in sizes["sf0.001"])


def test_calendar_follows_the_days():
    c = Calendar.between(datetime.date(2024, 1, 1), datetime.date(2024, 1, 8))
    assert c == Calendar("2024-01-05 00:00:00", ("2024-01-05 00:00:00", "2024-01-06 23:59:59"), ("2024-01-07 00:00:00", "2024-01-07 23:59:59"), ("2024-01-08 00:00:00", "2024-01-08 23:59:59"))
