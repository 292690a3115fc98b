"""Preparation: cleaning, returns, variance proxies, pooling, coverage."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.blocks import by_block, indexed, own_rows, with_halo

PARKINSON_SCALE = 4 * 0.6931471805599453  # 4 ln 2


def clean_bars(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Drop bars with any null, keep the last ingested of equal (asset, date).

    A skewed key is impossible to order by: the last row is a ``max_by``, combined before
    the shuffle.
    """
    prices = ["open", "high", "low", "close"]
    kept = raw.dropna(subset=["asset", "date", *prices])
    return kept.groupBy("asset", "date").agg(F.max_by(F.struct(*prices), F.col(seq)).alias("bar")).select("asset", "date", "bar.*")


def parkinson(high: Column, low: Column) -> Column:
    """Range-based variance; null unless both prices are positive."""
    ratio = F.when((high > 0) & (low > 0), F.ln(high / low))
    return ratio * ratio / PARKINSON_SCALE


def returns(bars: DataFrame, unit: str = "month") -> DataFrame:
    """Panel of bars with ``t``, log_return and both variance proxies; an asset's first bar goes.

    A return spans any gap of time between two bars of an asset; bars without a positive
    close are left out first.
    """
    r = F.ln(F.col("close") / F.lag("close").over(by_block()))
    priced = indexed(bars.where(F.col("close") > 0), unit)
    panel = own_rows(with_halo(priced, 1).withColumn("log_return", r)).where(F.col("t") > 1).withColumn("t", F.col("t") - 1)
    return panel.withColumn("realized_var_proxy", F.col("log_return") * F.col("log_return")).withColumn("parkinson_var_proxy", parkinson(F.col("high"), F.col("low")))


def dimension(assets: dict[str, tuple[str, str]], asset: Column) -> tuple[Column, Column]:
    """Category and sector as a literal map: the dimension is part of the configuration."""
    def of(i: int) -> Column:
        return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[i])) for k, v in assets.items())), asset)

    return of(0).alias("category"), of(1).alias("sector")


def pooled(panel: DataFrame, assets: dict[str, tuple[str, str]]) -> DataFrame:
    """Attach category and sector; order (date, asset) only when writing to a sink."""
    return panel.select("*", *dimension(assets, F.col("asset")))


def coverage(panel: DataFrame, per_year: int, days: float = 365.0, extreme: float = 0.10) -> DataFrame:
    """Rows, span in days, coverage against ``per_year`` bars a year, extreme returns; span 0 gives null."""
    span = F.datediff(F.max("date"), F.min("date"))
    return panel.groupBy("asset").agg(
        F.count("*").alias("n_rows"),
        span.alias("span_days"),
        F.try_divide(100.0 * F.count("*"), span * per_year / days).alias("coverage_pct"),
        F.sum(F.when(F.abs("log_return") > extreme, 1).otherwise(0)).alias("n_extreme"),
    )


def category_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("category", "asset").agg(F.count("*").alias("n_rows"))


def reference_series(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """A market reference: the mean of all assets by date."""
    return ticks.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("date")).agg(F.avg("price").alias("reference"), F.count("*").alias("ticks"))


def index_series(bars: DataFrame, asset: str, name: str) -> DataFrame:
    """One asset's closes by date as a market reference, under a name of their own."""
    return bars.where(F.col("asset") == asset).select("date", F.col("close").alias(name))


def window_of(panel: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows of an inclusive range of dates: a filter that reaches the scan."""
    if low is not None:
        panel = panel.where(F.col("date") >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        panel = panel.where(F.col("date") <= F.lit(high).cast("timestamp_ntz"))
    return panel


def before(panel: DataFrame, bound: str) -> DataFrame:
    return panel.where(F.col("date") < F.lit(bound).cast("timestamp_ntz"))

