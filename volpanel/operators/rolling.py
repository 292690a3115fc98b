"""Rolling re-estimation: parameters fitted anew along the way, forecasts by the last fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions.kernels import garch_variances, maximise
from volpanel.operators.fit import LN_SCALE, MIN_ROWS

WINDOW = 500
STEP = 20
CHAIN = 8  # refits of one group, each started from the one before
SCHEMA = (
    "asset string, model string, refit long, refit_date timestamp_ntz, omega double, alpha double, gamma double, beta double, "
    "log_likelihood double, n_rows int, converged boolean, status string, forecasts array<struct<t:long,date:timestamp_ntz,variance:double>>"
)


def windows(panel: DataFrame, window: int = WINDOW, step: int = STEP, chain: int = CHAIN) -> DataFrame:
    """Rows of each (asset, chain): those that its refits are fitted on or forecast.

    Refit k stands after row ``window + k * step`` of its asset and forecasts the ``step``
    rows after it.  A row goes to the chains whose refits reach it: 2 + window / (chain *
    step) at most, however long the asset is.
    """
    span = chain * step
    # Chain c needs the rows from c * span + 1 to window + (c + 1) * span.
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - window) / span) - 1)
    high = F.floor((F.col("t") - 1) / span)
    return panel.select("asset", "t", "date", "log_return", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("chain"))


def refit_chain(asset: str, model: str, rows: pd.DataFrame, first: int, window: int, step: int, chain: int, rounds: int) -> list[tuple]:
    """The refits of a chain; ``first`` is the index of its first one.  A failed fit is a row too, and forecasts nothing."""
    rows = rows.sort_values("t")
    t, r = rows["t"].to_numpy(np.int64), 100.0 * rows["log_return"].to_numpy(np.float64)
    dates = rows["date"].tolist()
    known, out = None, []
    for k in range(first, first + chain):
        last = window + k * step
        begin, end = np.searchsorted(t, [last - window + 1, last + 1])
        if end - begin < window or t[end - 1] != last:
            break  # the asset ends here
        x, ahead = r[begin:end], r[begin : end + step]
        n = len(x)
        try:
            if n < MIN_ROWS or not np.isfinite(x).all() or not np.any(x):
                raise ValueError(f"{n} usable rows")
            theta, value, converged = maximise(x, model, rounds, known)
            if not math.isfinite(value):
                raise ValueError("no admissible parameters")
        except (ValueError, FloatingPointError) as error:
            out.append((asset, model, k, dates[end - 1], None, None, None, None, None, n, False, f"FAIL: {error}", []))
            continue
        known = theta
        path = garch_variances(theta, ahead, model, float(np.mean(x**2)) or 1e-12)[0] / 1e4
        omega = float(theta[0]) - LN_SCALE if model == "EGARCH" else float(theta[0]) / 1e4
        gamma = None if model == "GARCH" else float(theta[2])
        made = [{"t": int(t[begin + i]), "date": dates[begin + i], "variance": float(path[i])} for i in range(n, len(ahead))]
        out.append((asset, model, k, dates[end - 1], omega, float(theta[1]), gamma, float(theta[-1]), value + n * math.log(100), n, converged, "OK" if converged else "WARNING: not converged", made))
    return out


def refits(panel: DataFrame, model: str = "GARCH", window: int = WINDOW, step: int = STEP, rounds: int = 60, chain: int = CHAIN) -> DataFrame:
    """Parameters of each refit of each asset, with the forecasts of the rows up to the next one.

    The fits of a chain start from the grid and from the optimum before, so each scores as
    well as either; chains are independent and bounded in rows, so a long asset is many
    tasks.  Forecasts come from the recursion over the fitted window, carried on.  Assets
    shorter than ``window`` have none.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(refit_chain(key[0], model, rows, key[1] * chain, window, step, chain, rounds), columns=names)

    return windows(panel, window, step, chain).groupBy("asset", "chain").applyInPandas(run, SCHEMA)


def forecasts(fitted: DataFrame) -> DataFrame:
    """(asset, t, date, refit, refit_date, variance): each row by the last refit before it."""
    return fitted.select("asset", "model", "refit", "refit_date", F.explode("forecasts").alias("f")).select("asset", "model", "f.t", "f.date", "refit", "refit_date", "f.variance")
