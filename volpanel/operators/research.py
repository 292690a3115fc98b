"""Tests and studies on finished forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.blocks import by_block, own_rows, with_halo
from volpanel.operators.ensemble import trailing_rmse

NORMAL_TAIL = {0.01: 2.3263478740408408, 0.05: 1.6448536269514722}


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by the polynomial of Abramowitz and Stegun 26.2.17 (error 7.5e-8)."""
    z = F.abs(x)
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def diebold_mariano(losses: DataFrame, first: str, second: str, lags: int = 5) -> DataFrame:
    """By asset: mean loss difference, its Newey-West variance (Bartlett weights) and the statistic.

    ``losses`` has (asset, t, and a loss column per model).  Autocovariances are products of
    a row with the rows up to ``lags`` before it.
    """
    d = losses.select("asset", "t", (F.col(first) - F.col(second)).alias("d"))
    mean = d.groupBy("asset").agg(F.avg("d").alias("mean_d"), F.count("*").alias("n"))
    centred = own_rows(with_halo(d.join(mean, "asset").withColumn("e", F.col("d") - F.col("mean_d")), lags).withColumns({f"p{k}": F.col("e") * F.lag("e", k).over(by_block()) for k in range(1, lags + 1)}))
    sums = centred.groupBy("asset").agg(F.first("mean_d").alias("mean_d"), F.first("n").alias("n"), F.avg(F.col("e") * F.col("e")).alias("g0"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(1, lags + 1)))
    variance = reduce(lambda a, k: a + 2 * (1 - k / (lags + 1)) * F.col(f"s{k}") / F.col("n"), range(1, lags + 1), F.col("g0"))
    return sums.select("asset", "n", "mean_d", variance.alias("nw_variance")).withColumn("dm_stat", F.when(F.col("nw_variance") > 0, F.col("mean_d") / F.sqrt(F.col("nw_variance") / F.col("n"))))


def var_backtest(forecasts: DataFrame, model: str, level: float = 0.05) -> DataFrame:
    """Value-at-risk exceptions of one model by asset, with Kupiec's and Christoffersen's likelihood ratios."""
    hit = (F.col("log_return") < -NORMAL_TAIL[level] * F.sqrt(F.col(model))).cast("int")
    rows = own_rows(with_halo(forecasts.withColumn("hit", hit), 1).withColumn("before", F.lag("hit").over(by_block())))

    def pair(a: int, b: int) -> Column:
        return F.sum(((F.col("before") == a) & (F.col("hit") == b)).cast("long"))

    c = rows.groupBy("asset").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("x"), *(F.coalesce(pair(a, b), F.lit(0)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)))

    def xlogy(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.ln(y)).otherwise(0.0)

    n, x = F.col("n"), F.col("x")
    rate = x / n
    kupiec = -2 * (xlogy(n - x, F.lit(1 - level)) + xlogy(x, F.lit(level)) - xlogy(n - x, 1 - rate) - xlogy(x, rate))
    p0, p1 = F.try_divide("n01", F.col("n00") + F.col("n01")), F.try_divide("n11", F.col("n10") + F.col("n11"))
    p = F.try_divide(F.col("n01") + F.col("n11"), F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    free = xlogy(F.col("n00"), 1 - p0) + xlogy(F.col("n01"), p0) + xlogy(F.col("n10"), 1 - p1) + xlogy(F.col("n11"), p1)
    bound = xlogy(F.col("n00") + F.col("n10"), 1 - p) + xlogy(F.col("n01") + F.col("n11"), p)
    return c.select("asset", "n", x.alias("n_exceptions"), kupiec.alias("lr_kupiec"), (-2 * (bound - free)).alias("lr_christoffersen"))


def lookback_grid(paths: DataFrame, oos: str, lookbacks: tuple[int, ...] = (30, 60, 90), models: tuple[str, ...] = ("ewma", "garch")) -> DataFrame:
    """Mean out-of-sample trailing errors for several windows: long table (asset, lookback, model, mean_rmse)."""
    parts = []
    for k in lookbacks:
        rows = trailing_rmse(paths, k).where(F.col("date") >= F.lit(oos).cast("timestamp_ntz"))
        cells = [F.struct(F.lit(m).alias("model"), F.avg(f"{m}_rmse").alias("mean_rmse")).alias(m) for m in models]
        parts.append(rows.groupBy("asset").agg(*cells).select("asset", F.lit(k).alias("lookback"), F.explode(F.array(*models)).alias("c")).select("asset", "lookback", "c.*"))
    return reduce(DataFrame.unionByName, parts)


def regime_cuts(features: DataFrame, quantile: float = 0.5, accuracy: int = 10_000) -> DataFrame:
    """(asset, cut): a quantile of the 60-row volatility, by a mergeable sketch.

    The rank of the value found is off by at most 1 / ``accuracy`` of the asset's rows; up to
    ``accuracy`` / 2 rows it is exact (of two middle values the lower).  The sketch is of bounded size
    and combined before the shuffle, so a long asset is not sorted in one task.
    """
    return features.groupBy("asset").agg(F.percentile_approx("realized_vol_60", quantile, accuracy).alias("cut"))


def regime_losses(features: DataFrame, forecasts: DataFrame, models: tuple[str, ...], quantile: float = 0.5) -> DataFrame:
    """Mean absolute errors by asset and regime: calm or wild, by the asset's median 60-row volatility."""
    cut = regime_cuts(features, quantile)
    rows = features.select("asset", "date", "realized_vol_60").join(cut, "asset").withColumn("regime", F.when(F.col("realized_vol_60") > F.col("cut"), "wild").otherwise("calm"))
    joined = forecasts.join(rows.select("asset", "date", "regime"), ["asset", "date"])
    return joined.groupBy("asset", "regime").agg(F.count("*").alias("n_rows"), *(F.avg(F.abs(F.col(m) - F.col("realized_var_proxy"))).alias(f"mae_{m}") for m in models))


def at_the_money(forecasts: DataFrame, model: str, rate: float = 0.065, years: float = 30 / 365) -> DataFrame:
    """Black-Scholes call of unit spot and strike under a forecast's annualised volatility."""
    sigma = F.least(F.sqrt(F.col(model)), F.lit(5.0))
    d1 = (rate + sigma * sigma / 2) * years / (sigma * years**0.5)
    price = normal_cdf(d1) - F.exp(F.lit(-rate * years)) * normal_cdf(d1 - sigma * years**0.5)
    return forecasts.select("asset", "date", sigma.alias("sigma"), price.alias("call_price"))
