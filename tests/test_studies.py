"""Model Confidence Set and rolling re-estimation against plain loops."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel.functions.kernels import garch_variances, log_likelihood, maximise
from volpanel.operators import confidence, rolling


def plain_set(asset, losses, models, block, resamples, level):
    n = len(losses)
    x = losses[list(models)].to_numpy()
    mean, boot = x.mean(0), []
    for b in range(1, resamples + 1):
        ends = [int(hashlib.md5(f"{asset}|{b}|{k}".encode()).hexdigest()[:12], 16) % (n - block + 1) + block for k in range(1, -(-n // block) + 1)]
        boot.append(np.concatenate([x[e - block : e] for e in ends]).mean(0))
    boot, alive, p, out = np.array(boot), list(range(len(models))), 0.0, {}
    for turn in range(1, len(models)):
        d = mean[alive] - mean[alive].mean()
        e = boot[:, alive] - boot[:, alive].mean(1, keepdims=True) - d
        v = np.sqrt((e**2).mean(0))
        safe = np.where(v > 0, v, 1)
        t, star = np.where(v > 0, d / safe, 0), np.where(v > 0, e / safe, 0).max(1)
        p = max(p, float((star >= t.max()).mean()))
        out[models[alive.pop(int(t.argmax()))]] = (p, turn)
    out[models[alive[0]]] = (1.0, None)
    return {m: (mean[i], *out[m], out[m][0] >= level) for i, m in enumerate(models)}


@pytest.fixture(scope="module")
def losses():
    draw = np.random.default_rng(5)
    parts = []
    for asset, n, shift in (("a", 90, (0, 0.5, 0.02, 3)), ("b", 70, (0, 0, 0, 0)), ("short", 5, (0, 1, 2, 3))):
        base = draw.gamma(2, size=(n, 1)) + 0.3 * draw.normal(size=(n, 4)) + np.array(shift)
        parts.append(pd.DataFrame(base, columns=list("wxyz")).assign(asset=asset, t=np.arange(n) + 7))
    return pd.concat(parts)


def test_confidence_set_equals_a_loop(spark, losses, monkeypatch):
    df = spark.createDataFrame(losses).repartition(3)
    got = confidence.confidence_set(df, tuple("wxyz"), 8, 60, 0.10).collect()
    assert {r["asset"] for r in got} == {"a", "b"}
    for asset in "ab":
        want = plain_set(asset, losses[losses.asset == asset], tuple("wxyz"), 8, 60, 0.10)
        for r in (r for r in got if r["asset"] == asset):
            mean, p, turn, inside = want[r["model"]]
            assert r["mean_loss"] == pytest.approx(mean) and (r["p_value"], r["round"], r["in_set"]) == (pytest.approx(p), turn, inside)
    assert not next(r for r in got if r["asset"] == "a" and r["model"] == "z")["in_set"]


def test_equal_models_stay_in_the_set(spark):
    df = spark.range(40).select(F.lit("s").alias("asset"), (F.col("id") + 1).alias("t"), (F.col("id") % 5).cast("double").alias("w")).withColumn("x", F.col("w"))
    got = {r["model"]: r for r in confidence.confidence_set(df, ("w", "x"), 4, 20).collect()}
    assert got["w"]["in_set"] and got["x"]["in_set"] and got["w"]["round"] == 1


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(9)
    parts = []
    for asset, n in (("long", 330), ("short", 60), ("flat", 150)):
        r = draw.normal(size=n) * (0.01 + 0.02 * (np.arange(n) // 50 % 2)) * (asset != "flat")
        parts.append(pd.DataFrame({"asset": asset, "t": np.arange(1, n + 1), "date": pd.date_range("2024-01-01", periods=n), "log_return": r}))
    return pd.concat(parts)


def frame(spark, panel):
    return spark.createDataFrame(panel).withColumn("date", F.col("date").cast("timestamp_ntz")).repartition(4)


@pytest.mark.parametrize("model", ["GARCH", "GJR-GARCH"])
def test_refits_equal_single_fits(spark, panel, model):
    got = rolling.refits(frame(spark, panel), model, 100, 10, 25, 4)
    rows = {r["refit"]: r for r in got.where("asset = 'long'").collect()}
    assert sorted(rows) == list(range(24))  # after rows 100, 110, ... 330
    r = 100 * panel[panel.asset == "long"]["log_return"].to_numpy()
    for k in (0, 9, 20):
        x = r[k * 10 : 100 + k * 10]
        _, alone, _ = maximise(x, model, 25)
        found = rows[k]
        theta = np.array([found["omega"] * 1e4, found["alpha"], *([found["gamma"]] if model != "GARCH" else []), found["beta"]])
        value = found["log_likelihood"] - 100 * np.log(100)
        assert log_likelihood(theta, x, model, float(np.mean(x**2)))[0] == pytest.approx(value)
        assert value >= alone - 0.05 * abs(alone) and (k % 4 or value == pytest.approx(alone))
        path = garch_variances(theta, r[k * 10 : 110 + k * 10], model, float(np.mean(x**2)))[0][100:] / 1e4
        assert [f["variance"] for f in found["forecasts"]] == pytest.approx(path.tolist())
        assert [f["t"] for f in found["forecasts"]] == list(range(101 + k * 10, 111 + k * 10))


def test_each_row_is_forecast_once_by_the_last_refit(spark, panel):
    got = rolling.refits(frame(spark, panel), "GARCH", 100, 10, 5, 4)
    rows = sorted(tuple(r) for r in rolling.forecasts(got).where("asset = 'long'").select("t", "refit").collect())
    assert rows == [(t, (t - 101) // 10) for t in range(101, 331)]
    assert got.where("asset = 'short'").count() == 0
    flat = got.where("asset = 'flat'").collect()
    assert len(flat) == 6 and all(r["status"].startswith("FAIL") and not r["forecasts"] for r in flat)


def test_rows_go_to_a_bounded_number_of_chains(spark, panel):
    most = rolling.windows(frame(spark, panel), 100, 10, 4).groupBy("asset", "t").count().agg(F.max("count")).first()[0]
    assert most <= 2 + 100 / 40
