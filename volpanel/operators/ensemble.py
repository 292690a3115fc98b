"""Ensemble of the forecasts, weighted by the inverse of their trailing errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.blocks import by_block, own_rows, with_halo
from volpanel.sources.schema import MODELS

LOOKBACK = 60
EPSILON = 1e-12


def full(value: Column, frame, rows: int, counted: str) -> Column:
    """A frame's value, or null unless the frame has all its rows."""
    return F.when(F.count(counted).over(frame) == rows, value)


def trailing_rmse(paths: DataFrame, lookback: int = LOOKBACK, models: tuple[str, ...] = MODELS, target: str = "realized_var_proxy") -> DataFrame:
    """Add ``{model}_rmse``: root mean squared error over the ``lookback`` rows before, null until there are as many.

    Rows, not days; the row itself is never in the frame.
    """
    frame = by_block().rowsBetween(-lookback, -1)
    out = with_halo(paths, lookback)
    for m in models:
        error = (F.col(m) - F.col(target)) * (F.col(m) - F.col(target))
        out = out.withColumn(f"{m}_rmse", full(F.sqrt(F.avg(error).over(frame)), frame, lookback, target))
    return own_rows(out)


def weights(table: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Add ``{model}_weight``: 1 / max(rmse, 1e-12), normalised; null where an error is."""
    inverse = {m: 1 / F.when(F.col(f"{m}_rmse").isNotNull(), F.greatest(f"{m}_rmse", F.lit(EPSILON))) for m in models}
    total = reduce(lambda a, b: a + b, inverse.values())
    return table.select("*", *((x / total).alias(f"{m}_weight") for m, x in inverse.items()))


def combine(table: DataFrame, models: tuple[str, ...] = MODELS, name: str = "static_ensemble") -> DataFrame:
    """Add the weighted variance and its root."""
    variance = reduce(lambda a, b: a + b, (F.col(f"{m}_weight") * F.col(m) for m in models))
    return table.withColumn(f"{name}_variance", variance).withColumn(f"{name}_volatility", F.sqrt(variance))


def out_of_sample(table: DataFrame, oos: str) -> DataFrame:
    return table.where(F.col("date") >= F.lit(oos).cast("timestamp_ntz"))


def inverse_rmse_ensemble(paths: DataFrame, oos: str, lookback: int = LOOKBACK) -> DataFrame:
    """The out-of-sample ensemble; its first frames reach into the in-sample rows of the same paths."""
    return combine(weights(out_of_sample(trailing_rmse(paths, lookback), oos)))


def warm_history(paths: DataFrame, oos: str, rows: int = LOOKBACK) -> DataFrame:
    """The last ``rows`` in-sample rows of each asset: by position, so no asset is ordered in one task."""
    inside = paths.where(F.col("date") < F.lit(oos).cast("timestamp_ntz"))
    last = inside.groupBy("asset").agg(F.max("t").alias("last_t"))
    return inside.join(last, "asset").where(F.col("t") > F.col("last_t") - rows).drop("last_t")


def warmup_audit(history: DataFrame, oos: str, rows: int = LOOKBACK) -> DataFrame:
    bad = reduce(lambda a, b: a | b, ((F.col(m).isNull()) | (F.col(m) <= 0) for m in MODELS))
    return history.groupBy("asset").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") == rows).alias("rows_ok"),
        (F.countDistinct("date") == F.count("*")).alias("unique_ok"),
        (F.max("date") < F.lit(oos).cast("timestamp_ntz")).alias("ends_ok"),
        F.sum(bad.cast("int")).alias("n_bad_variance"),
        F.sum((F.col("realized_var_proxy") < 0).cast("int")).alias("n_bad_target"),
    )


def ensemble_audit(table: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, (F.col(f"{m}_weight") for m in MODELS))
    low = reduce(lambda a, b: F.least(a, b), (F.col(f"{m}_weight") for m in MODELS))
    again = reduce(lambda a, b: a + b, (F.col(f"{m}_weight") * F.col(m) for m in MODELS))
    return table.groupBy("asset").agg(
        F.count("*").alias("n_rows"),
        (F.max(F.abs(total - 1)) < 1e-10).alias("sum_ok"),
        (F.min(low) >= 0).alias("sign_ok"),
        (F.max(F.abs(again - F.col("static_ensemble_variance"))) <= 1e-12).alias("variance_ok"),
        (F.max(F.abs(F.sqrt(again) - F.col("static_ensemble_volatility"))) <= 1e-10).alias("volatility_ok"),
    )


def spaced(table: DataFrame, pieces: int = 10) -> DataFrame:
    """Of each asset the first row, the last, and those at even distances between them: ``pieces`` + 1 at most."""
    ends = table.groupBy("asset").agg(F.min("t").alias("first_t"), (F.max("t") - F.min("t")).alias("span"))
    chosen = ends.select("asset", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda k: F.col("first_t") + F.floor(k * F.col("span") / pieces)))).alias("t"))
    return table.join(chosen, ["asset", "t"], "left_semi")


def window_recheck(paths: DataFrame, computed: DataFrame, every: int = 30, lookback: int = LOOKBACK, model: str = "garch") -> DataFrame:
    """Recompute sampled windows by joining rows j in [i - lookback, i - 1]; greatest difference by asset.

    The range is an equality on blocks of ``lookback`` positions: each sampled row meets
    the two blocks that its window touches.
    """
    sampled = computed.where(F.col("t") % every == 0).select("asset", F.col("t").alias("i"), F.col(f"{model}_rmse").alias("given"))
    sampled = sampled.withColumn("cell", F.explode(F.array(F.floor((F.col("i") - lookback) / lookback), F.floor((F.col("i") - 1) / lookback)))).distinct()
    rows = paths.select("asset", "t", F.floor(F.col("t") / lookback).alias("cell"), ((F.col(model) - F.col("realized_var_proxy")) * (F.col(model) - F.col("realized_var_proxy"))).alias("square"))
    met = sampled.join(rows, ["asset", "cell"]).where((F.col("t") >= F.col("i") - lookback) & (F.col("t") < F.col("i")))
    again = met.groupBy("asset", "i", "given").agg(F.sqrt(F.avg("square")).alias("again"), F.count("*").alias("rows")).where(F.col("rows") == lookback)
    return again.groupBy("asset").agg(F.count("*").alias("n_windows"), (F.max(F.abs(F.col("given") - F.col("again"))) <= 1e-9).alias("equal"))
