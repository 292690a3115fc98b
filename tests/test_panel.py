"""Operators of the panel on small fixtures with results worked out by hand or by plain loops."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel.functions import kernels
from volpanel.operators import ensemble, features, fit, gate, leakage, metrics, prep, quality, recursion, research
from volpanel.operators.blocks import by_block, indexed, own_rows, with_halo
from volpanel.sources import bars
from volpanel.sources.schema import BAR_COLUMNS, MODELS, Parameters
from volpanel.streaming import walk_forward

START = datetime.datetime(2024, 1, 1)
OOS = "2024-01-06 00:00:00"
FROZEN = Parameters()


def series(n=200, assets=("a", "b"), seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for k, asset in enumerate(assets):
        price = 100 * np.exp(np.cumsum(draw.normal(0, 0.5, n - 17 * k)))
        for i, p in enumerate(price):
            rows.append((asset, START + datetime.timedelta(hours=i), p * 0.99, p * 1.1, p * 0.9, p))
    return pd.DataFrame(rows, columns=list(BAR_COLUMNS))


@pytest.fixture(scope="module")
def panel(spark):
    frame = spark.createDataFrame(series(), "asset string, date timestamp_ntz, open double, high double, low double, close double")
    return prep.returns(frame).cache()


@pytest.fixture(scope="module")
def paths(panel):
    return recursion.variance_paths(panel, OOS, FROZEN).cache()


def test_ohlc_ties_follow_the_sequence(spark):
    t = START
    ticks = spark.createDataFrame([("x", t, 2, 5.0), ("x", t, 1, 4.0), ("x", t, 3, 0.0), ("x", t, 4, None)], "asset string, ts timestamp_ntz, seq long, price double")
    assert bars.ohlc(ticks).drop("date").collect() == [("x", 4.0, 5.0, 4.0, 5.0, 2)]


def test_clean_bars_keeps_the_last_and_drops_nulls(spark):
    rows = [("x", START, 1.0, 2.0, 1.0, 1.5, 1), ("x", START, 1.0, 2.0, 1.0, 1.7, 2), ("x", START, 1.0, 2.0, None, 1.9, 3)]
    raw = spark.createDataFrame(rows, "asset string, date timestamp_ntz, open double, high double, low double, close double, seq int")
    assert [r["close"] for r in prep.clean_bars(raw).collect()] == [1.7]
    assert quality.duplicate_dates(raw).collect() == [("x", 2)]
    assert {r["column_name"]: r["n_missing"] for r in quality.missing_counts(raw).collect()}["low"] == 1


def test_parkinson_value(spark):
    value = spark.range(1).select(prep.parkinson(F.lit(11.0), F.lit(10.0)), prep.parkinson(F.lit(0.0), F.lit(10.0))).first()
    assert value[0] == pytest.approx(0.00327637, abs=1e-8) and value[1] is None


def test_index_and_halo_are_independent_of_block_size(spark):
    frame = spark.createDataFrame(series(130), "asset string, date timestamp_ntz, open double, high double, low double, close double")
    rows = indexed(frame, "day")
    want = None
    for size in (7, 50, 4096):
        mean = own_rows(with_halo(rows, 5, size).withColumn("m", F.avg("close").over(by_block().rowsBetween(-5, -1))))
        got = mean.orderBy("asset", "t").select("asset", "t", F.round("m", 9)).collect()
        want = want or got
        assert got == want and len(got) == 130 + 113


def test_affine_scan_equals_the_loops(panel):
    scan = recursion.affine_paths(panel, OOS, FROZEN).orderBy("asset", "t").toPandas()
    loop = recursion.sequential_paths(panel, OOS, FROZEN).orderBy("asset", "t").toPandas()
    assert len(scan) == len(loop) == 199 + 182
    for m in ("ewma", "garch", "gjr_garch"):
        assert np.allclose(scan[m], loop[m], rtol=1e-10)


@pytest.mark.parametrize("factor", [0.0, 1e-12, 0.3, 0.999, 1.0])
def test_affine_scan_for_any_factor(spark, factor):
    u = np.random.default_rng(3).uniform(0, 1, 1500)
    rows = spark.createDataFrame(pd.DataFrame({"asset": "x", "t": np.arange(1, 1501), "u": u, "first": 2.0}))
    got = recursion.affine_scan(rows, ["asset"], {"s": (factor, "u", "first")}, 1500).orderBy("t").toPandas()["s"]
    want, state = [], None
    for x in u:
        state = 2.0 if state is None else factor * state + x
        want.append(state)
    assert np.allclose(got, want, rtol=1e-10)


def test_ewma_by_hand(spark):
    frame = spark.createDataFrame([("x", START + datetime.timedelta(days=i), i + 1, r) for i, r in enumerate((0.01, -0.02, 0.03))], "asset string, date timestamp_ntz, t long, log_return double")
    got = [r["ewma"] for r in recursion.sequential_paths(frame, "2025-01-01", FROZEN).orderBy("t").collect()]
    assert got == pytest.approx([6.333333e-4, 6.013333e-4, 5.892533e-4], rel=1e-6)


def test_egarch_step_by_hand():
    stored, scale = -9.2, math.log(1e4)
    value = kernels.egarch_step(math.log(1.0), -0.02, stored + scale, 0.14, -0.12, 0.97)
    assert math.exp(value) / 1e4 == pytest.approx(1.519888e-4, rel=1e-6)


def test_inverse_rmse_weights_by_hand(spark):
    row = spark.createDataFrame([(1.0, 2.0, 4.0, 4.0), (0.0, 1.0, 1.0, 1.0)], [f"{m}_rmse" for m in MODELS])
    got = [tuple(round(r[f"{m}_weight"], 9) for m in MODELS) for r in ensemble.weights(row).collect()]
    assert got[0] == (0.5, 0.25, 0.125, 0.125) and got[1][0] == pytest.approx(1.0)


def test_trailing_rmse_needs_full_frames_and_looks_back_only(paths):
    rows = ensemble.trailing_rmse(paths, 60).where("asset = 'a'").orderBy("t").toPandas()
    assert rows["garch_rmse"].isna().sum() == 60
    e = (rows["garch"] - rows["realized_var_proxy"]) ** 2
    want = np.sqrt(e.rolling(60).mean().shift(1))
    assert np.allclose(rows["garch_rmse"][60:], want[60:])


def test_qlike_variants_by_hand(spark):
    rows = spark.createDataFrame([("x", 2.0, 1.0)], "asset string, f double, y double")
    got = metrics.forecast_metrics(rows, ["f"], ["y"]).first()
    assert got["qlike_fy_masked"] == pytest.approx(0.306853, abs=1e-6) and got["qlike_yf_clamped"] == pytest.approx(0.193147, abs=1e-6)
    zero = metrics.forecast_metrics(spark.createDataFrame([("x", 1.0, 0.0)], "asset string, f double, y double"), ["f"], ["y"]).first()
    assert zero["qlike_fy_masked"] is None and zero["n_zero_target"] == 1 and zero["qlike_yf_clamped"] > 20


def test_ranks_take_the_least_of_ties_and_skip_missing(spark):
    rows = spark.createDataFrame([("x", "y", m, v, v, v) for m, v in (("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None))], "asset string, target string, model string, qlike_fy_masked double, mae double, rmse double")
    assert {r["model"]: r["rank_mae"] for r in metrics.ranking(rows).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


def test_features_against_pandas(paths):
    got = features.gating_features(paths, OOS).where("asset = 'a'").orderBy("t").toPandas().set_index("t")
    r = paths.where("asset = 'a'").orderBy("t").toPandas().set_index("t")["log_return"]
    rv5 = np.sqrt((r**2).rolling(5).mean())
    assert np.allclose(got["realized_vol_5"], rv5.shift(1)[got.index])
    assert np.allclose(got["vol_of_vol_30"], rv5.rolling(30).std().shift(1)[got.index])
    assert (got["return_sign_lag1"] == (r.shift(1) < 0).astype(int)[got.index]).all()


def test_forecasts_do_not_leak(panel):
    audit = leakage.audit(panel, lambda p: recursion.variance_paths(p, OOS, FROZEN), OOS, list(MODELS)).collect()
    assert len(audit) == 8 and all(not r["changed_at_t"] and r["changed_after_t"] for r in audit)


def test_ohlc_violations_count(spark):
    rows = [("x", START, 1.0, 2.0, 0.5, 1.0), ("x", START, -1.0, 2.0, 0.5, 1.0), ("x", START, 3.0, 2.0, 0.5, 1.0), ("x", START, 1.0, 2.0, 1.5, float("nan"))]
    frame = spark.createDataFrame(rows, "asset string, date timestamp_ntz, open double, high double, low double, close double")
    assert quality.ohlc_checks(frame).collect() == [("x", 1, 1, 2)]
    assert quality.ohlc_violations(frame).count() == 3


def test_fit_beats_its_grid_and_isolates_failure(spark):
    draw = np.random.default_rng(5)
    r, s = [], 1.0
    for _ in range(600):
        s = 0.05 + 0.1 * (r[-1] ** 2 if r else 1.0) + 0.85 * s
        r.append(draw.normal(0, math.sqrt(s)))
    r = np.array(r)
    theta, value, _ = kernels.maximise(r, "GARCH")
    assert value >= kernels.log_likelihood(kernels.grid("GARCH", float(np.mean(r**2))), r, "GARCH", float(np.mean(r**2))).max()
    assert abs(theta[1] + theta[2] - 0.95) < 0.12
    assert fit.fit_one("x", "GARCH", np.zeros(100), 5)[-1].startswith("FAIL")


def test_persistence_by_hand(spark):
    rows = spark.createDataFrame([("GARCH",), ("EGARCH",), ("GJR-GARCH",)], "model string")
    p = fit.persistence(F.col("model"), F.lit(0.1), F.lit(0.2), F.lit(0.7))
    assert [round(x[0], 9) for x in rows.select(p).collect()] == [0.8, 0.7, 0.9]


def test_gate_gradient_and_training(spark):
    draw = np.random.default_rng(2)
    w, x, f, y = draw.normal(0, 0.3, gate.N_WEIGHTS), draw.normal(0, 1, (40, 9)), draw.uniform(0.5, 2, (40, 4)), draw.uniform(0.1, 3, 40)
    _, g = gate.loss_and_gradient(w, x, f, y)
    for i in (0, 50, 110, 130, 171):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (gate.loss_and_gradient(w + step, x, f, y)[0] - gate.loss_and_gradient(w - step, x, f, y)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-5)
    assert np.allclose(gate.gate_weights(w, x).sum(1), 1)


def test_normal_cdf(spark):
    got = spark.range(1).select(research.normal_cdf(F.lit(1.959964)), research.normal_cdf(F.lit(-1.0))).first()
    assert got[0] == pytest.approx(0.975, abs=1e-6) and got[1] == pytest.approx(0.158655, abs=1e-6)


def test_stream_equals_batch_in_several_runs(spark, panel, paths, tmp_path):
    ready = panel.join(recursion.seeds(panel, OOS), "asset").select("asset", "date", "log_return", "seed")
    schema = "asset string, date timestamp_ntz, log_return double, seed double"
    for day in ("2024-01-03", "2024-01-20"):
        part = ready.where(F.col("date") < F.lit(day).cast("timestamp_ntz"))  # earlier bars come again and are dropped
        part.write.mode("append").parquet(str(tmp_path / "bars"))
        out = walk_forward.run_to_end(spark.readStream.schema(schema).parquet(str(tmp_path / "bars")), FROZEN, str(tmp_path))
    got = out.orderBy("asset", "date").toPandas()
    want = ensemble.combine(ensemble.weights(ensemble.trailing_rmse(paths))).orderBy("asset", "date").toPandas()
    assert len(got) == len(want)
    for c in (*MODELS, "static_ensemble_variance"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_empty_panel(spark):
    empty = spark.createDataFrame([], "asset string, date timestamp_ntz, open double, high double, low double, close double")
    p = prep.returns(empty)
    assert p.count() == 0 and recursion.affine_paths(p, OOS, FROZEN).count() == 0
