"""EGARCH in parallel along time against the loop, and the network's expressions against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel.operators import gate, recursion
from volpanel.sources.schema import FEATURES, MODELS, Parameters

OOS = "2024-02-01 00:00:00"


def frame(spark, sizes, seed=3):
    draw = np.random.default_rng(seed)
    parts = [pd.DataFrame({"asset": a, "t": np.arange(1, n + 1), "date": pd.date_range("2024-01-01", periods=n, freq="h"), "log_return": draw.standard_t(3, size=n) * scale}) for a, n, scale in sizes]
    return spark.createDataFrame(pd.concat(parts)).withColumn("date", F.col("date").cast("timestamp_ntz")).withColumn("realized_var_proxy", F.col("log_return") ** 2).repartition(5)


@pytest.mark.parametrize(("block_rows", "egarch"), [(48, (1.03, 0.10, -0.05, 0.90)), (90, (0.02, 0.3, -0.2, 0.995)), (4096, (5.0, 0.0, 0.0, 0.0))])
def test_egarch_over_blocks_equals_the_loop(spark, block_rows, egarch):
    panel = frame(spark, [("a", 200, 0.01), ("b", 33, 3.0), ("c", 1, 0.1), ("zero", 40, 0.0)])
    p = Parameters(egarch=egarch)
    got = {(r["asset"], r["t"]): r["egarch"] for r in recursion.egarch_path(panel, OOS, p, block_rows).collect()}
    want = {(r["asset"], r["t"]): r["egarch"] for r in recursion.sequential_paths(panel, OOS, p).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_blocks_under_own_parameters_and_without_any(spark):
    panel = frame(spark, [("a", 90, 0.02), ("b", 90, 0.02)]).withColumn("seed", F.lit(4e-4))
    rows = panel.select("*", *(F.when(F.col("asset") == "a", x).alias(f"_e{i}") for i, x in enumerate((0.1, 0.2, -0.1, 0.9))))
    got = recursion.egarch_blocks(rows, 45).collect()
    assert len(got) == 180 and all((r["egarch"] is None) == (r["asset"] == "b") for r in got)


def test_no_block_is_longer_than_asked_for(spark, monkeypatch):
    seen = []
    run = recursion._egarch_run
    monkeypatch.setattr(recursion, "_egarch_run", lambda s, before, *a: (seen.append(len(before)), run(s, before, *a))[1])
    out, slope = recursion._egarch_run(0.5, np.full(50, 0.01), (0.1, 0.1, 0.0, 0.9), False)
    assert len(out) == 50 and abs(slope) < 0.9**40 and seen == [50]


def test_network_expressions_equal_numpy(spark):
    draw = np.random.default_rng(1)
    rows = pd.DataFrame(draw.normal(size=(30, len(FEATURES))), columns=list(FEATURES)).assign(asset=["a", "b"] * 15, date=pd.date_range("2024-01-01", periods=30), split="test")
    for c in (*MODELS, "log_return", "realized_var_proxy", "parkinson_var_proxy"):
        rows[c] = draw.gamma(2, size=30)
    nets = {a: draw.normal(size=gate.N_WEIGHTS) for a in "ab"}
    trained = spark.createDataFrame([(a, w.tolist()) for a, w in nets.items()], "asset string, weights array<double>")
    got = gate.predict(spark.createDataFrame(rows), trained).toPandas().sort_values("date").reset_index(drop=True)
    want = np.concatenate([gate.gate_weights(nets[a], x[None]) for a, x in zip(rows["asset"], rows[list(FEATURES)].to_numpy(), strict=True)])
    assert np.allclose(got[[f"{m}_neural_weight" for m in MODELS]].to_numpy(), want, rtol=1e-12)
    assert np.allclose(got["neural_ensemble_variance"], (want * rows[list(MODELS)].to_numpy()).sum(1))


def test_gradient_equals_finite_differences():
    draw = np.random.default_rng(2)
    w, x, f, y = draw.normal(size=gate.N_WEIGHTS), draw.normal(size=(20, len(FEATURES))), draw.gamma(2, size=(20, 4)), draw.gamma(2, size=20)
    _, g = gate.loss_and_gradient(w, x, f, y)
    for i in draw.choice(gate.N_WEIGHTS, 25, replace=False):
        e = np.zeros_like(w)
        e[i] = 1e-6
        slope = (gate.loss_and_gradient(w + e, x, f, y)[0] - gate.loss_and_gradient(w - e, x, f, y)[0]) / 2e-6
        assert slope == pytest.approx(g[i], rel=1e-4, abs=1e-7)
