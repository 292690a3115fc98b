"""Maximum-likelihood fits of the static models, one per asset and model."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions.kernels import maximise

LN_SCALE = math.log(1e4)
FITTED = ("GARCH", "EGARCH", "GJR-GARCH")
SCHEMA = (
    "asset string, model string, omega double, alpha double, gamma double, beta double, lambda double, "
    "log_likelihood double, n_params int, n_rows long, converged boolean, status string"
)
MIN_ROWS = 30


def fit_one(asset: str, model: str, r: np.ndarray, rounds: int) -> tuple:
    """One row of the parameter table; a failed fit is a row too, with its reason."""
    n = len(r)
    try:
        if n < MIN_ROWS or not np.isfinite(r).all() or not np.any(r):
            raise ValueError(f"{n} usable rows")
        theta, value, converged = maximise(100.0 * r, model, rounds)
        if not math.isfinite(value):
            raise ValueError("no admissible parameters")
        omega = float(theta[0])
        gamma = None if model == "GARCH" else float(theta[2])
        stored = omega - LN_SCALE if model == "EGARCH" else omega / 1e4
        return asset, model, stored, float(theta[1]), gamma, float(theta[-1]), None, value + n * math.log(100), len(theta), n, converged, "OK" if converged else "WARNING: not converged"
    except (ValueError, FloatingPointError) as error:
        return asset, model, None, None, None, None, None, None, 4 if model != "GARCH" else 3, n, False, f"FAIL: {error}"


def fit(panel: DataFrame, models: tuple[str, ...] = FITTED, rounds: int = 60) -> DataFrame:
    """Parameter rows of each asset and model, fitted on the given (in-sample) panel.

    The unit of work is one series of one model, so that fits of a few long series spread
    as well as those of many short ones.  A fit needs its whole series; only its returns
    move.
    """
    jobs = panel.select("asset", "t", "log_return", F.explode(F.array(*map(F.lit, models))).alias("model"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("t")["log_return"].to_numpy(np.float64)
        return pd.DataFrame([fit_one(key[0], key[1], r, rounds)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return jobs.groupBy("asset", "model").applyInPandas(run, SCHEMA)


def with_ewma(fitted: DataFrame, assets: DataFrame, lam: float) -> DataFrame:
    """The parameter table: four rows per asset; the EWMA row has a decay only and counts as converged."""
    ewma = assets.select("asset").distinct().withColumns({"model": F.lit("EWMA"), "lambda": F.lit(lam), "converged": F.lit(True), "status": F.lit("OK")})
    return fitted.unionByName(ewma, allowMissingColumns=True)


def persistence(model: Column, alpha: Column, gamma: Column, beta: Column) -> Column:
    return F.when(model == "GARCH", alpha + beta).when(model == "EGARCH", beta).when(model == "GJR-GARCH", alpha + beta + gamma / 2)


def information_criteria(table: DataFrame) -> DataFrame:
    """AIC and BIC on the scale of returns times 100, on which the likelihood was maximised."""
    scaled = F.col("log_likelihood") - F.col("n_rows") * math.log(100)
    return table.withColumn("aic", 2 * F.col("n_params") - 2 * scaled).withColumn("bic", F.col("n_params") * F.ln("n_rows") - 2 * scaled)


def diagnostics(table: DataFrame) -> DataFrame:
    """Labels of each fit: persistence, signs of the parameters, leverage."""
    p = F.round(persistence(F.col("model"), F.col("alpha"), F.col("gamma"), F.col("beta")), 12)
    labels = [
        F.when(p >= 1, "explosive").when(p > 0.98, "near unit root").when(p.isNotNull(), "stationary"),
        F.when(F.col("model").isin("GARCH", "GJR-GARCH") & (F.col("omega") <= 0), "omega not positive"),
        F.when(F.col("model").isin("GARCH", "GJR-GARCH") & (F.col("alpha") < 0), "alpha negative"),
        F.when(F.col("model").isin("GARCH", "GJR-GARCH") & (F.col("beta") < 0), "beta negative"),
        F.when(F.abs("gamma") < 1e-4, "no leverage").when((F.col("model") == "GJR-GARCH") & (F.col("gamma") > 0), "leverage").when((F.col("model") == "EGARCH") & (F.col("gamma") < 0), "leverage"),
    ]
    return table.withColumn("persistence", p).withColumn("labels", F.array_join(F.array_compact(F.array(*labels)), "; "))


def summary(table: DataFrame) -> DataFrame:
    """One row per asset: the status of each model, and how many passed."""
    models = ("EWMA", *FITTED)
    wide = table.groupBy("asset").pivot("model", list(models)).agg(F.first("converged"))
    ok = [F.coalesce(F.col(f"`{m}`").cast("int"), F.lit(0)) for m in models]
    return wide.select("asset", *(F.col(f"`{m}`").alias(m.lower().replace("-", "_")) for m in models), reduce(lambda a, b: a + b, ok).alias("n_passed"))
