"""Data-quality audits: each is one aggregate over the panel, combined before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.blocks import by_block, own_rows, with_halo
from volpanel.operators.metrics import finite

PRICES = ("open", "high", "low", "close")


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def missing(x: Column, kind: str) -> Column:
    return x.isNull() | F.isnan(x) if kind in ("double", "float") else x.isNull()


def missing_columns(table: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that the table lacks: metadata only."""
    return [c for c in required if c not in table.columns]


def series_profile(panel: DataFrame) -> DataFrame:
    return panel.groupBy("asset").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def missing_counts(table: DataFrame) -> DataFrame:
    """Missing (null or NaN) values of each column: one pass, then a table of a row per column."""
    kinds = dict(table.dtypes)
    cells = [F.struct(F.lit(c).alias("column_name"), _count(missing(F.col(c), kinds[c])).alias("n_missing")).alias(f"_{i}") for i, c in enumerate(table.columns)]
    return table.agg(*cells).select(F.explode(F.array(*(f"_{i}" for i in range(len(table.columns))))).alias("c")).select("c.*")


def duplicate_dates(panel: DataFrame) -> DataFrame:
    """Rows beyond the first of each (asset, date), by asset."""
    return panel.groupBy("asset", "date").agg(F.count("*").alias("k")).groupBy("asset").agg(F.sum(F.col("k") - 1).alias("n_duplicates"))


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """The (asset, date) that occur more than once, and how often."""
    return panel.groupBy("asset", "date").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def violations() -> dict[str, Column]:
    """The ten ways in which a bar may be wrong; comparisons with NaN or null are not violations."""
    x = {c: F.when(~F.isnan(c), F.col(c)) for c in PRICES}
    out = {f"{c}_not_positive": x[c] <= 0 for c in PRICES}
    out |= {f"high_below_{c}": x["high"] < x[c] for c in ("open", "low", "close")}
    return out | {f"low_above_{c}": x["low"] > x[c] for c in ("open", "high", "close")}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def ohlc_checks(bars: DataFrame) -> DataFrame:
    v = violations()
    return bars.groupBy("asset").agg(
        _count(_any([v[k] for k in v if k.endswith("positive")])).alias("n_not_positive"),
        _count(_any([v[k] for k in v if k.startswith("high")])).alias("n_high_violations"),
        _count(_any([v[k] for k in v if k.startswith("low_above")])).alias("n_low_violations"),
    )


def ohlc_violations(bars: DataFrame) -> DataFrame:
    return bars.where(_any(list(violations().values())))


def finite_checks(panel: DataFrame) -> DataFrame:
    """Non-finite returns; negative and non-finite variance proxies (of an absent column: null)."""
    cells = [_count(~finite(F.col("log_return"))).alias("n_bad_return")]
    for c, name in (("realized_var_proxy", "realized"), ("parkinson_var_proxy", "parkinson")):
        there = c in panel.columns
        cells.append((_count(F.col(c) < 0) if there else F.lit(None).cast("long")).alias(f"n_negative_{name}"))
        cells.append((_count(~finite(F.col(c))) if there else F.lit(None).cast("long")).alias(f"n_bad_{name}"))
    return panel.groupBy("asset").agg(*cells)


def extreme_rows(panel: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Rows whose return exceeds the threshold (strictly) either way; reported, not removed."""
    return panel.where(F.abs("log_return") > threshold)


def extreme_counts(panel: DataFrame, threshold: float = 0.10) -> DataFrame:
    return panel.groupBy("asset").agg(_count(F.abs("log_return") > threshold).alias("n_extreme"))


def sequence_audit(panel: DataFrame, expected: DataFrame) -> DataFrame:
    """By asset: dates strictly increasing along ``t``, unique, and as many as ``expected`` (asset, n_expected)."""
    steps = own_rows(with_halo(panel.select("asset", "date", "t"), 1).withColumn("step_ok", F.coalesce(F.lag("date").over(by_block()) < F.col("date"), F.lit(True))))
    found = steps.groupBy("asset").agg(F.count("*").alias("n_rows"), F.min("step_ok").alias("increasing"), F.max("t").alias("last_t"))
    return found.join(expected, "asset", "left").select("asset", "n_rows", "increasing", (F.col("last_t") == F.col("n_rows")).alias("unique"), F.coalesce(F.col("n_rows") == F.col("n_expected"), F.lit(False)).alias("count_ok"))


def date_alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """By asset: keys of both tables, of the left alone, of the right alone."""
    a, b = left.select("asset", "date").withColumn("in_left", F.lit(1)), right.select("asset", "date").withColumn("in_right", F.lit(1))
    both = a.join(b, ["asset", "date"], "full_outer")
    return both.groupBy("asset").agg(
        _count(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("n_both"),
        _count(F.col("in_right").isNull()).alias("n_left_only"),
        _count(F.col("in_left").isNull()).alias("n_right_only"),
    )


def parity_audit(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Greatest absolute difference of shared columns over common keys."""
    other = right.select("asset", "date", *(F.col(c).alias(f"_{c}") for c in columns))
    return left.join(other, ["asset", "date"]).groupBy("asset").agg(F.count("*").alias("n_rows"), *(F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(f"max_diff_{c}") for c in columns))


def forecast_audit(table: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """By asset: missing, non-finite, non-positive variances; roots within 1e-9; targets as constructed; a verdict."""
    names = [F.col(m) for m in models]
    cells = {
        "n_rows": F.count("*").cast("long"),
        "n_missing": reduce(lambda a, b: a + b, (_count(x.isNull()) for x in names)),
        "n_not_finite": reduce(lambda a, b: a + b, (_count(x.isNotNull() & ~finite(x)) for x in names)),
        "n_not_positive": reduce(lambda a, b: a + b, (_count(x <= 0) for x in names)),
        "root_ok": F.max(reduce(lambda a, b: F.greatest(a, b), (F.abs(F.sqrt(F.col(m)) - F.col(f"{m}_volatility")) for m in models))) <= 1e-9,
        "target_ok": F.max(F.abs(F.col("realized_var_proxy") - F.col("log_return") * F.col("log_return"))) < 1e-15,
        "n_negative_target": _count((F.col("realized_var_proxy") < 0) | (F.col("parkinson_var_proxy") < 0)),
    }
    out = table.groupBy("asset").agg(*(c.alias(k) for k, c in cells.items()))
    good = (F.col("n_missing") + F.col("n_not_finite") + F.col("n_not_positive") + F.col("n_negative_target") == 0) & F.col("root_ok") & F.col("target_ok")
    return out.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def fingerprint(table: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: rows, and sum and exclusive or of row hashes."""
    h = F.xxhash64(*table.columns)
    return table.agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"))


def reference_check(series: DataFrame, value: str) -> DataFrame:
    """One row about a reference series: rows, first and last date, repeated dates, missing and not positive values."""
    kind = dict(series.dtypes)[value]
    return series.agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), (F.count("date") - F.count_distinct("date")).alias("n_repeated"),
        _count(missing(F.col(value), kind)).alias("n_missing"), _count(F.col(value) <= 0).alias("n_not_positive"),
    )


def variance_integrity(paths: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """By asset and model: rows, variances that are missing or not finite, not positive, and a label; one wide aggregate."""
    cells = []
    for m in models:
        x = F.col(m)
        bad, low = _count(~F.coalesce(finite(x), F.lit(False))), _count(x <= 0)
        cells.append(F.struct(F.lit(m).alias("model"), F.count("*").alias("n_rows"), bad.alias("n_not_finite"), low.alias("n_not_positive"), F.when(bad + low == 0, "sound").otherwise("broken").alias("label")).alias(f"_{m}"))
    return paths.groupBy("asset").agg(*cells).select("asset", F.explode(F.array(*(f"_{m}" for m in models))).alias("c")).select("asset", "c.*")
