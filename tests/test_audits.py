"""Loader, sink, recomputation, perturbations, sketches and reproducibility."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel.operators import ensemble, features, leakage, prep, quality, recursion, research
from volpanel.sources import bars
from volpanel.sources.schema import FEATURES, MODELS, Parameters
from volpanel.streaming import bars as stream

OOS = "2024-01-05 00:00:00"


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(11)
    parts = [pd.DataFrame({"asset": a, "t": np.arange(1, n + 1), "date": pd.date_range("2024-01-01", periods=n, freq="h"), "log_return": draw.normal(size=n) * 0.02}) for a, n in (("a", 220), ("b", 180), ("one|two", 150))]
    df = spark.createDataFrame(pd.concat(parts)).withColumn("date", F.col("date").cast("timestamp_ntz"))
    return df.withColumn("realized_var_proxy", F.col("log_return") * F.col("log_return")).withColumn("parkinson_var_proxy", F.col("realized_var_proxy")).cache()


@pytest.fixture(scope="module")
def paths(panel):
    return recursion.variance_paths(panel, OOS, Parameters()).cache()


def test_missing_and_torn_files(spark, tmp_path):
    good, torn = tmp_path / "good.csv", tmp_path / "torn.csv"
    good.write_text("asset,date,open,high,low,close\na,2024-01-01 00:00:00,1,2,0.5,1.5\n")
    torn.write_text("asset,date,open,high,low,close\nb,2024-01-01 00:00:00,1,2,x,1.5\nb,2024-01-02 00:00:00,1,2\nb,2024-01-03 00:00:00,1,2,0.5,1.5\n")
    assert bars.read_bars(spark, [str(tmp_path / "none.csv")]) is None
    rows = bars.read_bars(spark, [str(good), str(tmp_path / "none.csv"), str(torn)]).cache().orderBy("asset", "date").collect()
    assert len(rows) == 4 and [r[bars.BAD] is not None for r in rows] == [False, True, True, False]
    assert (rows[0]["close"], rows[3]["low"], rows[1]["low"]) == (1.5, 0.5, None)


def test_a_rerun_of_the_sink_replaces_its_partitions(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    rows = panel.withColumn("category", F.col("asset"))
    bars.write_panel(rows, path)
    bars.write_panel(rows.where("category = 'a'").withColumn("log_return", F.lit(7.0)), path)
    back = spark.read.parquet(path)
    assert back.count() == panel.count() and {r[0] for r in back.where("category = 'a'").select("log_return").distinct().collect()} == {7.0}
    assert back.where("category = 'b' AND log_return = 7").count() == 0


def test_window_of_csv_files(spark, panel, tmp_path):
    path = str(tmp_path / "bars")
    written = panel.select("asset", "date", *(F.exp("log_return").alias(c) for c in ("open", "high", "low", "close")))
    bars.write_bars(written, path)
    back = bars.load_window(spark, [path, str(tmp_path / "none")], "2024-01-02 00:00:00", "2024-01-02 05:00:00")
    want = written.where("date BETWEEN '2024-01-02' AND '2024-01-02 05:00:00'")
    assert back.count() == 18 and back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    with pytest.raises(FileNotFoundError):
        bars.load_window(spark, [str(tmp_path / "none")])
    with pytest.raises(ValueError):
        bars.load_window(spark, [path], "2030-01-01 00:00:00")


def test_spaced_rows_and_their_windows(panel, paths):
    rows = ensemble.out_of_sample(paths, OOS)
    at = {}
    for r in ensemble.spaced(rows).select("asset", "t").collect():
        at.setdefault(r["asset"], []).append(r["t"])
    first = {r["asset"]: (r["low"], r["high"]) for r in rows.groupBy("asset").agg(F.min("t").alias("low"), F.max("t").alias("high")).collect()}
    assert {a: sorted(t) for a, t in at.items()} == {a: sorted({low + k * (high - low) // 10 for k in range(11)}) for a, (low, high) in first.items()}
    assert ensemble.spaced(rows.where("asset = 'a'").limit(1)).count() == 1 and ensemble.spaced(rows.limit(0)).isEmpty()
    again = features.recomputed(paths, ensemble.spaced(rows))
    both = again.join(ensemble.trailing_rmse(paths), ["asset", "t"])
    assert both.count() == again.count() == 33
    for m in MODELS:
        assert both.agg(F.max(F.abs(F.col(f"{m}_rmse_60") - F.col(f"{m}_rmse")))).first()[0] < 1e-12


def test_required_columns(panel):
    assert quality.missing_columns(panel, ("asset", "date", "close", "volume")) == ["close", "volume"]
    assert quality.missing_columns(panel, ("asset",)) == []


def test_reference_and_variances(spark):
    rows = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", float("nan")), ("2024-01-03", None), ("2024-01-04", -1.0)], "date string, v double")
    assert quality.reference_check(rows, "v").first().asDict() == {"n_rows": 4, "first_date": "2024-01-01", "last_date": "2024-01-04", "n_repeated": 1, "n_missing": 2, "n_not_positive": 1}
    broken = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, float("inf")), ("b", 1.0, 1.0), ("b", 1.0, None)], "asset string, x double, y double")
    got = {(r["asset"], r["model"]): (r["n_not_finite"], r["n_not_positive"], r["label"]) for r in quality.variance_integrity(broken, ("x", "y")).collect()}
    assert got == {("a", "x"): (0, 0, "sound"), ("a", "y"): (1, 1, "broken"), ("b", "x"): (0, 0, "sound"), ("b", "y"): (1, 0, "broken")}


def test_recomputed_features_agree(paths):
    sampled = paths.where(f"date >= timestamp_ntz'{OOS}' AND t % 13 = 0")
    got = features.recheck(features.gating_features(paths, OOS), features.recomputed(paths, sampled)).collect()
    assert {r["asset"] for r in got} == {"a", "b", "one|two"}
    assert all(r[f"max_diff_{f}"] < 1e-12 for r in got for f in FEATURES) and sum(r["n_rows"] for r in got) > 15


def test_three_runs_tell_causal_from_leaking_features(panel):
    def build(p):
        return features.gating_features(recursion.variance_paths(p, OOS, Parameters()), OOS)

    rows = leakage.three_runs(panel, build, OOS, ["realized_vol_5", "garch_rmse_60"]).collect()
    assert len(rows) == 6 and all(r["own_row_kept"] and r["next_row_moved"] and r["future_unseen"] for r in rows)
    leaky = leakage.three_runs(panel, lambda p: p.withColumn("x", F.col("log_return")), OOS, ["x"]).collect()
    assert len(leaky) == 3 and not any(r["own_row_kept"] or r["next_row_moved"] for r in leaky)


def test_quantile_sketch_keeps_its_bound(spark):
    draw = np.random.default_rng(6)
    x = draw.gamma(0.5, size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"asset": "a", "realized_vol_60": x})).repartition(8)
    order = np.sort(x)
    for accuracy in (20, 100, 1000):
        for q in (0.1, 0.5, 0.9):
            found = research.regime_cuts(df, q, accuracy).first()["cut"]
            assert abs(np.searchsorted(order, found, "right") / len(x) - q) <= 1 / accuracy + 1e-12


def test_two_runs_give_the_same_features(panel):
    def build():
        return features.gating_features(recursion.variance_paths(panel, OOS, Parameters()), OOS)

    one, two = build(), build()
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_late_ticks_give_the_bars_of_a_batch(spark, tmp_path):
    draw = np.random.default_rng(8)
    n = 900
    rows = pd.DataFrame({"asset": draw.choice(["a", "b", "c"], n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(draw.integers(0, 72 * 3600, n)), unit="s"), "seq": np.arange(n), "price": draw.gamma(2, size=n) * draw.choice([0.0, 1.0], n, p=[0.05, 0.95])})
    ticks = spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    late = F.col("ts").cast("timestamp") + F.make_interval(secs=F.pmod(F.xxhash64("seq"), F.lit(4 * 3600)))
    source = stream.replay(ticks, str(tmp_path / "ticks"), late, 5)
    made = spark.read.parquet(stream.run_to_end(stream.bars(source, delay="5 hours"), str(tmp_path)))
    want = bars.ohlc(ticks).drop("ticks").select(*made.columns)
    assert made.count() == want.count() > 150 and made.exceptAll(want).isEmpty()


def test_prep_has_the_profile_of_an_empty_window(panel):
    assert prep.before(panel, "2020-01-01 00:00:00").isEmpty()
