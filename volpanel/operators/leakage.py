"""Causality audits: perturb one row of each asset, run again, compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Build = Callable[[DataFrame], DataFrame]


def middle_rows(panel: DataFrame, oos: str) -> DataFrame:
    """(asset, t0): the middle out-of-sample position of each asset with at least two rows there."""
    rows = panel.where(F.col("date") >= F.lit(oos).cast("timestamp_ntz")).groupBy("asset").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return rows.where("b > a").select("asset", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("t0"))


def perturbed(panel: DataFrame, at: DataFrame, factor: float | Column, offset: int = 0, targets_only: bool = False) -> DataFrame:
    """The panel with the return (and so its square) at t0 + offset multiplied; or its target alone."""
    hit = F.coalesce(F.col("t") == F.col("t0") + offset, F.lit(False))
    out = panel.join(at, "asset", "left")
    if targets_only:
        return out.withColumn("realized_var_proxy", F.when(hit, F.col("realized_var_proxy") * factor).otherwise(F.col("realized_var_proxy"))).drop("t0")
    r = F.when(hit, F.col("log_return") * factor).otherwise(F.col("log_return"))
    return out.withColumn("log_return", r).withColumn("realized_var_proxy", F.col("log_return") * F.col("log_return")).drop("t0")


def compare(before: DataFrame, after: DataFrame, at: DataFrame, columns: list[str], rtol: float = 1e-12) -> DataFrame:
    """By asset and column: whether t0 is unchanged and t0 + 1 changed."""
    def near(table: DataFrame, name: str) -> DataFrame:
        pick = table.join(at, "asset").where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t0") + 1))
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns]
        return pick.select("asset", (F.col("t") - F.col("t0")).alias("step"), F.explode(F.array(*cells)).alias("c")).select("asset", "step", "c.column_name", F.col("c.x").alias(name))

    both = near(before, "x").join(near(after, "y"), ["asset", "step", "column_name"])
    moved = F.abs(F.col("x") - F.col("y")) > rtol * F.greatest(F.abs("x"), F.abs("y"), F.lit(1e-300))
    return both.groupBy("asset", "column_name").agg(
        F.max((moved & (F.col("step") == 0)).cast("int")).cast("boolean").alias("changed_at_t"),
        F.max((moved & (F.col("step") == 1)).cast("int")).cast("boolean").alias("changed_after_t"),
    )


def audit(panel: DataFrame, build: Build, oos: str, columns: list[str], factor: float = 1000.0, offset: int = 0, targets_only: bool = False) -> DataFrame:
    """Run ``build`` on the panel and on a perturbed copy of it, and compare around the perturbed row."""
    at = middle_rows(panel, oos)
    return compare(build(panel), build(perturbed(panel, at, factor, offset, targets_only)), at, columns)


RUNS = ("base", "own", "next")


def three_runs(panel: DataFrame, build: Build, oos: str, columns: list[str], same: float = 1e-12, moved: float = 1e-6) -> DataFrame:
    """Three checks of each asset and column at its middle out-of-sample row t, from one panel that holds all runs.

    A changed return (ten times, or 0.05 where it is next to nothing) must leave the column at
    t as it is (``own_row_kept``), move it at t + 1 (``next_row_moved``), and the return of t + 1 changed
    must leave t (``future_unseen``).  The runs are assets of one tagged panel, so ``build`` plans and runs once.
    """
    at = middle_rows(panel, oos)
    tagged = panel.join(at, "asset").select("*", F.explode(F.array(*map(F.lit, RUNS))).alias("run"))
    hit = (F.col("run") == "own") & (F.col("t") == F.col("t0")) | (F.col("run") == "next") & (F.col("t") == F.col("t0") + 1)
    changed = F.when(F.abs("log_return") > 1e-4, 10 * F.col("log_return")).otherwise(0.05)
    tagged = tagged.withColumn("log_return", F.when(hit, changed).otherwise(F.col("log_return"))).withColumn("realized_var_proxy", F.when(hit, F.col("log_return") * F.col("log_return")).otherwise(F.col("realized_var_proxy")))
    built = build(tagged.withColumn("asset", F.concat_ws("|", "run", "asset")).drop("run", "t0"))
    rows = built.withColumn("run", F.substring_index("asset", "|", 1)).withColumn("asset", F.expr("substring(asset, length(run) + 2)")).join(at, "asset")
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns]
    near = rows.withColumn("step", F.col("t") - F.col("t0")).where(F.col("step").isin(0, 1)).select("asset", "run", "step", F.explode(F.array(*cells)).alias("c")).select("asset", "run", "step", "c.*")

    def x(run: str, step: int) -> Column:
        return F.max(F.when((F.col("run") == run) & (F.col("step") == step), F.col("x")))

    wide = near.groupBy("asset", "column_name").agg(x("base", 0).alias("b0"), x("base", 1).alias("b1"), x("own", 0).alias("o0"), x("own", 1).alias("o1"), x("next", 0).alias("n0"))
    return wide.select("asset", "column_name", (F.abs(F.col("o0") - F.col("b0")) <= same).alias("own_row_kept"), (F.abs(F.col("o1") - F.col("b1")) > moved).alias("next_row_moved"), (F.abs(F.col("n0") - F.col("b0")) <= same).alias("future_unseen"))
