"""Causal features of the gate: what is known before each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.operators.blocks import by_block, own_rows, with_halo
from volpanel.operators.ensemble import full, out_of_sample
from volpanel.sources.schema import FEATURES, MODELS

VOL_WINDOWS = (5, 20, 60)


def gating_features(paths: DataFrame, oos: str, lookback: int = 60) -> DataFrame:
    """Nine features of each out-of-sample row, all of rows before it; incomplete frames are null.

    One window specification serves every frame, so an asset block is sorted once.  The
    volatility of volatility covers 30 completed 5-row windows that end at t-30 ... t-1.
    """
    r2 = F.col("log_return") * F.col("log_return")
    out = with_halo(paths, lookback)
    frame = by_block().rowsBetween(-lookback, -1)
    for m in MODELS:
        error = (F.col(m) - F.col("realized_var_proxy")) * (F.col(m) - F.col("realized_var_proxy"))
        out = out.withColumn(f"{m}_rmse_60", full(F.sqrt(F.avg(error).over(frame)), frame, lookback, "realized_var_proxy"))
    for k in VOL_WINDOWS:
        back = by_block().rowsBetween(-k, -1)
        out = out.withColumn(f"realized_vol_{k}", full(F.sqrt(F.avg(r2).over(back)), back, k, "log_return"))
    inner = by_block().rowsBetween(-4, 0)
    out = out.withColumn("_rv5", full(F.sqrt(F.avg(r2).over(inner)), inner, 5, "log_return"))
    spread = by_block().rowsBetween(-30, -1)
    out = out.withColumn("vol_of_vol_30", full(F.stddev_samp("_rv5").over(spread), spread, 30, "_rv5"))
    out = out.withColumn("return_sign_lag1", F.when(F.lag("log_return").over(by_block()) < 0, 1).otherwise(0))
    return out_of_sample(own_rows(out.drop("_rv5")), oos).select("asset", "date", "t", *FEATURES)


def feature_audit(features: DataFrame) -> DataFrame:
    """By asset: rows, missing or not finite values, negative values, signs other than 0 and 1."""
    numbers = [f for f in FEATURES if f != "return_sign_lag1"]
    missing = sum((F.col(f).isNull() | F.isnan(f)).cast("int") for f in numbers)
    negative = sum(F.coalesce((F.col(f) < 0).cast("int"), F.lit(0)) for f in numbers)
    return features.groupBy("asset").agg(
        F.count("*").alias("n_rows"), F.sum(missing).alias("n_missing"), F.sum(negative).alias("n_negative"),
        F.sum((~F.col("return_sign_lag1").isin(0, 1)).cast("int")).alias("n_bad_sign"),
    )


def feature_profile(features: DataFrame) -> DataFrame:
    """Long table by asset and feature: count, missing, min, max, mean, sample deviation; from one wide aggregate."""
    cells = []
    for f in FEATURES:
        x = F.col(f).cast("double")
        cells.append(F.struct(F.lit(f).alias("feature"), F.count(x).alias("n"), F.sum(x.isNull().cast("long")).alias("n_missing"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).alias(f))
    return features.groupBy("asset").agg(*cells).select("asset", F.explode(F.array(*FEATURES)).alias("c")).select("asset", "c.*")


def recomputed(paths: DataFrame, sampled: DataFrame, lookback: int = 60) -> DataFrame:
    """The nine features of ``sampled`` rows (asset, t) once more, from arrays of the raw rows before each.

    Each row names the positions before it, which are joined by index, not by a window; rows
    with fewer than ``lookback`` rows before them are left out.
    """
    asked = sampled.select("asset", "t", F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("k")).withColumn("at", F.col("t") - F.col("k"))
    raw = paths.select("asset", F.col("t").alias("at"), "log_return", "realized_var_proxy", *MODELS)
    rows = asked.join(raw, ["asset", "at"]).groupBy("asset", "t").agg(F.sort_array(F.collect_list(F.struct("k", "log_return", "realized_var_proxy", *MODELS))).alias("back"))
    rows = rows.where(F.size("back") == lookback)

    def mean(x):
        return F.aggregate(x, F.lit(0.0), lambda total, v: total + v) / F.size(x)

    squares = F.transform("back", lambda b: b["log_return"] * b["log_return"])
    inner = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda j: F.sqrt(mean(F.slice(squares, j, F.lit(5)))))
    middle = mean(inner)
    spread = F.sqrt(F.aggregate(F.transform(inner, lambda v: (v - middle) * (v - middle)), F.lit(0.0), lambda total, v: total + v) / 29)
    def error(m: str):
        return F.sqrt(mean(F.transform("back", lambda b: (b[m] - b["realized_var_proxy"]) * (b[m] - b["realized_var_proxy"]))))

    errors = {f"{m}_rmse_60": error(m) for m in MODELS}
    volatilities = {f"realized_vol_{k}": F.sqrt(mean(F.slice(squares, 1, k))) for k in VOL_WINDOWS}
    sign = F.when(F.get("back", F.lit(0))["log_return"] < 0, 1).otherwise(0)
    found = errors | volatilities | {"vol_of_vol_30": spread, "return_sign_lag1": sign}
    return rows.select("asset", "t", *(found[f].alias(f) for f in FEATURES))


def recheck(features: DataFrame, again: DataFrame) -> DataFrame:
    """By asset: rows in both, and the largest difference of each feature."""
    both = again.join(features.select("asset", "t", *(F.col(f).alias(f"_{f}") for f in FEATURES)), ["asset", "t"])
    return both.groupBy("asset").agg(F.count("*").alias("n_rows"), *(F.max(F.abs(F.col(f) - F.col(f"_{f}"))).cast("double").alias(f"max_diff_{f}") for f in FEATURES))
