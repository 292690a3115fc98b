"""A small learned gate: from causal features to weights of the four forecasts."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.metrics import TINY
from volpanel.sources.schema import FEATURES, MODELS, TARGETS, Calendar

SCALED = tuple(f for f in FEATURES if f != "return_sign_lag1")
HIDDEN = 12
N_WEIGHTS = len(FEATURES) * HIDDEN + HIDDEN + HIDDEN * len(MODELS) + len(MODELS)


def dataset(features: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Features and forecasts of the same row; rows with any missing feature are left out."""
    return features.join(forecasts.drop("t"), ["asset", "date"]).dropna(subset=[*FEATURES, *MODELS])


def time_split(table: DataFrame, calendar: Calendar) -> DataFrame:
    """Add ``split``: train, validation or test by inclusive dates, else null; one pass."""
    def inside(bounds: tuple[str, str]) -> Column:
        return F.col("date").between(F.lit(bounds[0]).cast("timestamp_ntz"), F.lit(bounds[1]).cast("timestamp_ntz"))

    return table.withColumn("split", F.when(inside(calendar.train), "train").when(inside(calendar.validation), "validation").when(inside(calendar.test), "test"))


def scaler(table: DataFrame) -> DataFrame:
    """By asset and feature, from the train split alone: mean, spread (1 where it is none), range, fallback."""
    cells = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("raw"), F.min(f).alias("low"), F.max(f).alias("high")).alias(f) for f in SCALED]
    long = table.where("split = 'train'").groupBy("asset").agg(*cells).select("asset", F.explode(F.array(*SCALED)).alias("c")).select("asset", "c.*")
    none = F.col("raw").isNull() | F.isnan("raw") | (F.col("raw") < 1e-8)
    return long.select("asset", "feature", "mean", F.when(none, 1.0).otherwise(F.col("raw")).alias("std"), "low", "high", none.alias("fallback"))


def scaled(table: DataFrame, scalers: DataFrame) -> DataFrame:
    """Standardised features; the sign is left as it is."""
    wide = scalers.groupBy("asset").pivot("feature", list(SCALED)).agg(F.first(F.struct("mean", "std")))
    joined = table.join(wide.select("asset", *(F.col(f).alias(f"_{f}") for f in SCALED)), "asset")
    return joined.withColumns({f: (F.col(f) - F.col(f"_{f}.mean")) / F.col(f"_{f}.std") for f in SCALED}).drop(*(f"_{f}" for f in SCALED))


def unpacked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights and biases of both layers; a unit's own weights lie together, so that expressions can slice them."""
    n, m = len(FEATURES), len(MODELS)
    a, b = n * HIDDEN, n * HIDDEN + HIDDEN
    return w[:a].reshape(HIDDEN, n).T, w[a:b], w[b : b + HIDDEN * m].reshape(m, HIDDEN).T, w[b + HIDDEN * m :]


def gate_weights(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forecast weights of each row: one hidden layer of rectified units, then softmax."""
    w1, b1, w2, b2 = unpacked(w)
    z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss_and_gradient(w: np.ndarray, x: np.ndarray, f: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean clamped QLIKE of the gated variance, and its gradient."""
    w1, b1, w2, b2 = unpacked(w)
    h = x @ w1 + b1
    on = np.maximum(h, 0)
    z = on @ w2 + b2
    e = np.exp(z - z.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    raw = (p * f).sum(1)
    v, t = np.maximum(raw, TINY), np.maximum(y, TINY)
    loss = float(np.mean(t / v - np.log(t / v) - 1))
    dv = np.where(raw > TINY, (1 / v - t / v**2) / len(y), 0.0)
    dz = p * (f - raw[:, None]) * dv[:, None]
    dh = (dz @ w2.T) * (h > 0)
    return loss, np.concatenate([(dh.T @ x).ravel(), dh.sum(0), (dz.T @ on).ravel(), dz.sum(0)])


def train_one(asset: str, rows: pd.DataFrame, epochs: int, patience: int, rate: float = 1e-3, decay: float = 1e-4, batch: int = 32) -> tuple[np.ndarray, list[tuple]]:
    """Adam with early stopping on the validation loss; the seed comes from the asset's name.

    The weights kept never do worse on validation than equal weights, the start.
    """
    draw = np.random.default_rng(zlib.crc32(asset.encode()))
    parts = {s: rows[rows["split"] == s].sort_values("date") for s in ("train", "validation")}
    data = {s: tuple(p[list(c)].to_numpy(np.float64) for c in (FEATURES, MODELS)) + (p["realized_var_proxy"].to_numpy(np.float64),) for s, p in parts.items()}
    w = np.zeros(N_WEIGHTS)
    w[: len(FEATURES) * HIDDEN] = draw.normal(0, np.sqrt(2 / len(FEATURES)), len(FEATURES) * HIDDEN)
    best, history = w.copy(), []
    x, f, y = data["train"]
    if not len(y) or not len(data["validation"][2]):
        return best, history
    lowest, waited = loss_and_gradient(w, *data["validation"])[0], 0
    history.append((asset, 0, loss_and_gradient(w, x, f, y)[0], lowest))
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(1, epochs + 1):
        order = draw.permutation(len(y))
        for low in range(0, len(y), batch):
            pick = order[low : low + batch]
            _, g = loss_and_gradient(w, x[pick], f[pick], y[pick])
            g = g + decay * w
            step += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        train, valid = loss_and_gradient(w, x, f, y)[0], loss_and_gradient(w, *data["validation"])[0]
        history.append((asset, epoch, train, valid))
        if not np.isfinite(train + valid):
            break
        if valid < lowest:
            best, lowest, waited = w.copy(), valid, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, history


def train(table: DataFrame, epochs: int = 200, patience: int = 15) -> DataFrame:
    """One row per asset: the weights, and the history as an array of (epoch, train_loss, val_loss)."""
    used = table.where(F.col("split").isin("train", "validation")).select("asset", "date", "split", "realized_var_proxy", *FEATURES, *MODELS)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, history = train_one(key[0], rows, epochs, patience)
        return pd.DataFrame([(key[0], w.tolist(), [{"epoch": e, "train_loss": a, "val_loss": b} for _, e, a, b in history])], columns=["asset", "weights", "history"])

    return used.groupBy("asset").applyInPandas(run, "asset string, weights array<double>, history array<struct<epoch:int,train_loss:double,val_loss:double>>")


def history(trained: DataFrame) -> DataFrame:
    return trained.select("asset", F.explode("history").alias("h")).select("asset", "h.*")


def best_epochs(trained: DataFrame) -> DataFrame:
    long = history(trained)
    return long.groupBy("asset").agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.max("epoch").alias("last_epoch"), F.min("val_loss").alias("best_val_loss"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _layer(inputs: Column, n: int, weights: Column, start: int, units: int) -> Column:
    """Outputs of a layer: each unit's own weights from ``start`` on, then all biases."""
    bias = start + n * units
    return F.transform(F.sequence(F.lit(0), F.lit(units - 1)), lambda j: F.get(weights, F.lit(bias) + j) + _dot(inputs, F.slice(weights, F.lit(start + 1) + j * n, F.lit(n))))


def predict(table: DataFrame, trained: DataFrame) -> DataFrame:
    """Weights and gated variance of every row by the network of its asset (asset, weights).

    One hidden layer of rectified units, then softmax, as array expressions: no Python, and
    the table of weights, one row an asset, is the small side of the join.
    """
    keep = ["asset", "date", "split", "log_return", *TARGETS, *MODELS]
    x = F.array(*(F.col(f).cast("double") for f in FEATURES))
    n, first = len(FEATURES), len(FEATURES) * HIDDEN + HIDDEN
    rows = table.select(*(c for c in keep if c in table.columns), x.alias("_x")).join(trained.select("asset", F.col("weights").alias("_w")), "asset")
    rows = rows.withColumn("_h", F.transform(_layer(F.col("_x"), n, F.col("_w"), 0, HIDDEN), lambda v: F.greatest(v, F.lit(0.0))))
    rows = rows.withColumn("_z", _layer(F.col("_h"), HIDDEN, F.col("_w"), first, len(MODELS)))
    rows = rows.withColumn("_e", F.transform("_z", lambda v: F.exp(v - F.array_max("_z"))))
    rows = rows.withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda total, v: total + v))
    rows = rows.withColumns({f"{m}_neural_weight": F.get("_e", F.lit(i)) / F.col("_t") for i, m in enumerate(MODELS)})
    variance = sum((F.col(f"{m}_neural_weight") * F.col(m) for m in MODELS[1:]), F.col("ewma_neural_weight") * F.col("ewma"))
    rows = rows.withColumn("neural_ensemble_variance", variance).withColumn("neural_ensemble_volatility", F.sqrt("neural_ensemble_variance"))
    return rows.drop("_x", "_w", "_h", "_z", "_e", "_t")


def summary(predictions: DataFrame) -> DataFrame:
    """By asset: rows of each split, and test losses of the gate."""
    test = F.col("split") == "test"
    error = F.when(test, F.col("neural_ensemble_variance") - F.col("realized_var_proxy"))
    ratio = F.greatest(F.col("realized_var_proxy"), F.lit(TINY)) / F.greatest(F.col("neural_ensemble_variance"), F.lit(TINY))
    return predictions.groupBy("asset").agg(
        *(F.sum((F.col("split") == s).cast("long")).alias(f"n_{s}") for s in ("train", "validation", "test")),
        F.avg(F.abs(error)).alias("test_mae"), F.sqrt(F.avg(error * error)).alias("test_rmse"),
        F.avg(F.when(test, ratio - F.ln(ratio) - 1)).alias("test_qlike_yf_clamped"),
    )
