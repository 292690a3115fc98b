"""Out-of-sample forecast tables with frozen parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.operators.blocks import by_block, own_rows, with_halo
from volpanel.operators.ensemble import out_of_sample
from volpanel.sources.schema import MODELS, TARGETS


def warm_start(paths: DataFrame, oos: str) -> DataFrame:
    """State of each asset at its last in-sample row: four variances and the return."""
    inside = paths.where(F.col("date") < F.lit(oos).cast("timestamp_ntz"))
    last = F.max_by(F.struct("date", F.col("log_return").alias("last_return"), *MODELS), F.col("t"))
    return inside.groupBy("asset").agg(last.alias("s")).select("asset", "s.*")


def oos_table(paths: DataFrame, oos: str) -> DataFrame:
    """Forecast table: targets, four one-step variances and their roots."""
    rows = out_of_sample(paths, oos)
    return rows.select("asset", "date", "t", "log_return", *TARGETS, *MODELS, *(F.sqrt(m).alias(f"{m}_volatility") for m in MODELS))


def first_k(paths: DataFrame, oos: str, k: int = 3) -> DataFrame:
    """The first k out-of-sample rows of each asset with the return before, by position."""
    with_previous = own_rows(with_halo(paths, 1).withColumn("previous_return", F.lag("log_return").over(by_block())))
    rows = out_of_sample(with_previous, oos)
    first = rows.groupBy("asset").agg(F.min("t").alias("first_t"))
    return rows.join(first, "asset").where(F.col("t") < F.col("first_t") + k).withColumn("position", (F.col("t") - F.col("first_t") + 1)).drop("first_t")
