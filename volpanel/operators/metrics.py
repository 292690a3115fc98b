"""Forecast losses, rankings and comparison tables.

There are two QLIKE losses, and they are never mixed: ``qlike_fy_masked`` is the mean of
f/y - ln(f/y) - 1 over rows where both are positive and finite, ``qlike_yf_clamped`` that of
y/f - ln(y/f) - 1 over all rows, both sides being at least 1e-12.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def masked_term(forecast: Column, target: Column) -> Column:
    good = finite(forecast) & finite(target) & (forecast > 0) & (target > 0)
    ratio = F.when(good, forecast) / F.when(good, target)
    return ratio - F.ln(ratio) - 1


def clamped_term(forecast: Column, target: Column) -> Column:
    ratio = F.greatest(target, F.lit(TINY)) / F.greatest(forecast, F.lit(TINY))
    return ratio - F.ln(ratio) - 1


def forecast_metrics(forecasts: DataFrame, models: list[str], targets: list[str], by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Long table (by, model, target, mae, rmse, both QLIKEs, n_observations, n_valid, n_zero_target).

    The losses of all models and targets are columns of one aggregate over the wide panel;
    only its few rows are turned into a long table.
    """
    wide, parts = [], []
    for m in models:
        for y in targets:
            error, mask = F.col(m) - F.col(y), masked_term(F.col(m), F.col(y))
            cells = {
                "mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "qlike_fy_masked": F.avg(mask),
                "qlike_yf_clamped": F.avg(clamped_term(F.col(m), F.col(y))), "n_observations": F.count(F.lit(1)), "n_valid": F.count(mask),
            }
            wide.append(F.struct(F.lit(m).alias("model"), F.lit(y).alias("target"), *(c.alias(k) for k, c in cells.items())).alias(f"{m}|{y}"))
            parts.append(f"`{m}|{y}`")
    table = forecasts.groupBy(*by).agg(*wide).select(*by, F.explode(F.array(*parts)).alias("cell")).select(*by, "cell.*")
    return table.withColumn("n_zero_target", F.col("n_observations") - F.col("n_valid"))


def ranking(table: DataFrame, by: tuple[str, ...] = ("asset", "target"), losses: tuple[str, ...] = ("qlike_fy_masked", "mae", "rmse")) -> DataFrame:
    """Rank of each model, 1 the best; ties take the least rank, a missing loss has none."""
    out = table
    for loss in losses:
        missing = F.col(loss).isNull() | F.isnan(loss)
        order = Window.partitionBy(*by, missing).orderBy(loss)
        out = out.withColumn(f"rank_{loss}", F.when(~missing, F.rank().over(order).cast("long")))
    return out


def mean_ranks(ranked: DataFrame, target: str, losses: tuple[str, ...] = ("qlike_fy_masked", "mae", "rmse")) -> DataFrame:
    return ranked.where(F.col("target") == target).groupBy("model").agg(*(F.avg(f"rank_{x}").alias(f"mean_rank_{x}") for x in losses))


def integrity(table: DataFrame, expected_rows: int, models: list[str], losses: tuple[str, ...] = ("mae", "rmse", "qlike_fy_masked")) -> DataFrame:
    """One row: expected rows met, non-finite losses, repeated keys, missing and foreign models."""
    keyed = table.groupBy("asset", "target", "model").agg(F.count("*").alias("k"), *(F.sum((~finite(F.col(x))).cast("int")).alias(x) for x in losses))
    names = F.collect_set("model")
    return keyed.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"),
        (F.coalesce(F.sum("k"), F.lit(0)) == expected_rows).alias("rows_ok"),
        reduce(lambda a, b: a + b, (F.coalesce(F.sum(x), F.lit(0)) for x in losses)).cast("long").alias("n_not_finite"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_repeated"),
        F.size(F.array_except(F.array(*map(F.lit, models)), names)).cast("long").alias("n_missing_models"),
        F.size(F.array_except(names, F.array(*map(F.lit, models)))).cast("long").alias("n_foreign_models"),
    )


def recheck(stored: DataFrame, computed: DataFrame, losses: tuple[str, ...] = ("mae", "rmse", "qlike_fy_masked")) -> DataFrame:
    """Greatest absolute difference of each loss between two tables of the same keys."""
    other = computed.select("asset", "model", "target", *(F.col(x).alias(f"_{x}") for x in losses))
    return stored.join(other, ["asset", "model", "target"]).agg(F.count("*").alias("n_rows"), *(F.max(F.abs(F.col(x) - F.col(f"_{x}"))).alias(f"max_diff_{x}") for x in losses))


def improvement(table: DataFrame, base: str, other: str, losses: tuple[str, ...] = ("mae", "rmse", "qlike_yf_clamped")) -> DataFrame:
    """Percent by target: a ratio of averages over assets, not an average of ratios."""
    mean = [F.avg(F.when(F.col("model") == m, F.col(x))).alias(f"{x}_{m}") for x in losses for m in (base, other)]
    wide = table.where(F.col("model").isin(base, other)).groupBy("target").agg(*mean)
    return wide.select("target", *(F.try_divide(100 * (F.col(f"{x}_{base}") - F.col(f"{x}_{other}")), F.col(f"{x}_{base}")).alias(f"improvement_{x}") for x in losses))
