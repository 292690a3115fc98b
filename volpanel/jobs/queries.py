"""The registered queries of the volatility panel: Spark on one side, the same in SQL on the other."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.operators import confidence, ensemble, features, fit, forecast, gate, leakage, metrics, prep, quality, recursion, research, rolling
from volpanel.session import shared_dir, written
from volpanel.sources import bars as source
from volpanel.sources.schema import DIMENSION, FEATURES, MODELS, TARGETS, Calendar, Parameters
from volpanel.streaming import bars as tick_stream
from volpanel.streaming import walk_forward

CALENDAR, FROZEN = Calendar(), Parameters()
OOS = CALENDAR.oos
ENSEMBLE = (*MODELS, "static_ensemble_variance")
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return prep.returns(source.event_bars(spark, d))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """The four variance paths, written once: features, forecasts and losses of a query read the same rows."""
    return written(recursion.variance_paths(panel(spark, d), OOS, FROZEN))


def affine(spark: SparkSession, d: str) -> DataFrame:
    return recursion.affine_paths(panel(spark, d), OOS, FROZEN)


def combined(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.inverse_rmse_ensemble(paths(spark, d), OOS)


def oos(spark: SparkSession, d: str) -> DataFrame:
    return forecast.oos_table(paths(spark, d), OOS)


def metric_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.forecast_metrics(oos(spark, d), list(MODELS), list(TARGETS))


def recomputed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The losses once more, from one row per forecast and target in place of the wide aggregate."""
    rows = ensemble.out_of_sample(paths(spark, d), OOS)
    rows = rows.select("asset", *TARGETS, F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("f")) for m in MODELS))).alias("m"))
    rows = rows.select("asset", "m.*", F.explode(F.array(*(F.struct(F.lit(y).alias("target"), F.col(y).alias("y")) for y in TARGETS))).alias("t")).select("asset", "model", "f", "t.*")
    ratio = F.when((F.col("f") > 0) & (F.col("y") > 0), F.col("f") / F.col("y"))
    e = F.col("f") - F.col("y")
    return rows.groupBy("asset", "model", "target").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(ratio - F.ln(ratio) - 1).alias("qlike_fy_masked"))


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    return dataset_of(paths(spark, d), CALENDAR)


def dataset_of(p: DataFrame, calendar: Calendar) -> DataFrame:
    """Features and forecasts of a panel with its splits, written once: the scaler, the training and the forecasts read it."""
    return written(gate.time_split(gate.dataset(features.gating_features(p, calendar.oos), forecast.oos_table(p, calendar.oos)), calendar))


def ruled_weights(table: DataFrame) -> DataFrame:
    """Weights of the network for each asset of ``table`` by a rule that SQL can repeat, in place of training."""
    k = F.length("asset")
    rule = F.transform(F.sequence(F.lit(0), F.lit(gate.N_WEIGHTS - 1)), lambda i: ((i * 37 + k * 11) % 29 - 14) / F.lit(40.0))
    return table.select("asset").distinct().select("asset", rule.alias("weights"))


def gated(rows: DataFrame) -> DataFrame:
    """The network under ruled weights over scaled features."""
    return gate.predict(gate.scaled(rows, gate.scaler(rows)), ruled_weights(rows))


def versus(base: DataFrame, predictions: DataFrame) -> DataFrame:
    """Losses of the ensemble and of the gate on the rows of the test window that both have."""
    test = predictions.where("split = 'test'").select("asset", "date", *TARGETS, "neural_ensemble_variance")
    both = base.select("asset", "date", "static_ensemble_variance").join(test, ["asset", "date"])
    return metrics.forecast_metrics(both, ["static_ensemble_variance", "neural_ensemble_variance"], list(TARGETS))


def gate_versus(spark: SparkSession, d: str, trained_gate: bool = False) -> DataFrame:
    p = paths(spark, d)
    rows = dataset_of(p, CALENDAR)
    return versus(ensemble.inverse_rmse_ensemble(p, OOS), gate.predict(*trained_on(rows)) if trained_gate else gated(rows))


def dirty_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Raw bars as they come: two ingests of each bar, prices of the second slightly later in order."""
    b = source.event_bars(spark, d).drop("ticks")
    again = b.where(F.hour("date") % 6 == 0).withColumn("close", F.col("close") * 1.5).withColumn("seq", F.lit(2))
    bad = b.where(F.hour("date") % 7 == 0).withColumn("close", F.lit(None).cast("double")).withColumn("seq", F.lit(3))
    return b.withColumn("seq", F.lit(1)).unionByName(again).unionByName(bad)


def loaded_window(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as CSV, and a window of them loaded again; one of the paths is not there."""
    folder = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    source.write_bars(source.event_bars(spark, d), f"{folder}/bars")
    return source.load_window(spark, [f"{folder}/none", f"{folder}/bars"], OOS, CALENDAR.test[1])


def raw_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of all ticks, zero prices included, and with high and low of the following type of violation in some hours."""
    ticks = source.event_ticks(spark, d)
    order = F.struct("ts", "seq")
    b = ticks.groupBy("asset", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"))
    wrong = F.hour("date") == 5
    return b.withColumn("high", F.when(wrong, F.col("open") * 0.5).otherwise(F.col("high"))).withColumn("open", F.when(F.hour("date") == 6, -1.0).otherwise(F.col("open")))


def fitted(spark: SparkSession, d: str) -> DataFrame:
    inside = prep.before(panel(spark, d), OOS)
    return fit.fit(inside)


def fitted_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The parameter table of the fits themselves, failed and unconverged ones included."""
    return fit.with_ewma(fitted(spark, d), source.event_bars(spark, d), FROZEN.lam)


def ruled_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A parameter table that differs by asset, by a rule that SQL can repeat: k is the length of the name modulo 3."""
    k = F.length("asset") % 3

    def row(model: str, **values: object) -> F.Column:
        cells = [values.get(c, F.lit(None)).cast("double").alias(c.rstrip("_")) for c in ("omega", "alpha", "gamma", "beta", "lambda_")]
        return F.struct(F.lit(model).alias("model"), *cells)

    rows = F.array(
        row("EWMA", lambda_=0.90 + 0.02 * k),
        row("GARCH", omega=0.05 + 0.01 * k, alpha=0.05 + 0.02 * k, beta=0.85 - 0.03 * k),
        row("EGARCH", omega=1.0 + 0.05 * k - fit.LN_SCALE, alpha=0.10 + 0.02 * k, gamma=-0.05 + 0.01 * k, beta=0.88 - 0.02 * k),
        row("GJR-GARCH", omega=0.04 + 0.01 * k, alpha=0.03 + 0.01 * k, gamma=F.lit(0.08), beta=0.82 + 0.03 * k),
    )
    return source.event_bars(spark, d).select("asset").distinct().select("asset", F.explode(rows).alias("p")).select("asset", "p.*")


def judged_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The ruled parameters, of which those that forget too slowly count as not converged."""
    table = ruled_parameters(spark, d)
    return table.withColumn("converged", F.coalesce(_persistence() < 0.92, F.lit(True)))


def _persistence() -> F.Column:
    return fit.persistence(F.col("model"), F.col("alpha"), F.col("gamma"), F.col("beta"))


def paths_by_asset(spark: SparkSession, d: str) -> DataFrame:
    return recursion.fitted_paths(panel(spark, d), OOS, ruled_parameters(spark, d))


def fitted_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Fit each asset in sample, then run its own parameters through the whole panel."""
    return recursion.fitted_paths(panel(spark, d), OOS, fitted_parameters(spark, d))


def scored_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The frozen GARCH row of each asset with its in-sample likelihood under the frozen path."""
    inside = prep.before(affine(spark, d), OOS)
    term = -0.5 * (F.lit(1.8378770664093453) + F.ln("garch") + F.col("realized_var_proxy") / F.col("garch"))
    return inside.groupBy("asset").agg(F.sum(term).alias("log_likelihood"), F.count("*").alias("n_rows")).withColumn("n_params", F.lit(3))


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """Drive the walk-forward stream over the panel's bars, written to the shared folder as its source."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    p = panel(spark, d)
    p.join(recursion.seeds(p, OOS), "asset").select("asset", "date", "log_return", "seed").write.parquet(f"{folder}/bars")
    stream = spark.readStream.schema("asset string, date timestamp_ntz, log_return double, seed double").parquet(f"{folder}/bars")
    return walk_forward.run_to_end(stream, FROZEN, folder)


def streamed_ticks(spark: SparkSession, d: str) -> DataFrame:
    """From ticks up to five hours late, in eight micro-batches, to bars and on to forecasts, all as streams."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    late = F.col("ts").cast("timestamp") + F.make_interval(secs=F.pmod(F.xxhash64("seq"), F.lit(5 * 3600)))
    ticks = tick_stream.replay(source.event_ticks(spark, d), f"{folder}/ticks", late)
    made = tick_stream.run_to_end(tick_stream.bars(ticks), folder)
    seeds = recursion.seeds(panel(spark, d), OOS)
    seen = spark.readStream.schema("asset string, date timestamp_ntz, open double, high double, low double, close double").option("maxFilesPerTrigger", 8).parquet(made)
    return walk_forward.run_to_end(seen.join(F.broadcast(seeds), "asset").select("asset", "date", "close", "seed"), FROZEN, folder)


def trained_on(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scaled rows, and the networks trained on them, written once: a row an asset."""
    ready = gate.scaled(rows, gate.scaler(rows))
    return ready, written(gate.train(ready))


def trained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return trained_on(gate_rows(spark, d))


def trained_summary(spark: SparkSession, d: str) -> DataFrame:
    ready, networks = trained(spark, d)
    return gate.summary(gate.predict(ready, networks)).join(gate.best_epochs(networks), "asset")


def losses(spark: SparkSession, d: str) -> DataFrame:
    rows = oos(spark, d)
    return rows.select("asset", "t", *(((F.col(m) - F.col("realized_var_proxy")) * (F.col(m) - F.col("realized_var_proxy"))).alias(m) for m in MODELS))


def ensemble_losses(spark: SparkSession, d: str) -> DataFrame:
    """Squared errors of the four models and of their ensemble."""
    rows = combined(spark, d)
    return rows.select("asset", "t", *(((F.col(m) - F.col("realized_var_proxy")) * (F.col(m) - F.col("realized_var_proxy"))).alias(m) for m in ENSEMBLE))


def gate_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Causality of the network: scaler and weights stay those of the panel as it is."""
    rows = gate_rows(spark, d)
    scalers, weights = written(gate.scaler(rows)), ruled_weights(rows)

    def build(p: DataFrame) -> DataFrame:
        v = recursion.variance_paths(p, OOS, FROZEN)
        table = gate.dataset(features.gating_features(v, OOS), forecast.oos_table(v, OOS))
        return gate.predict(gate.scaled(table, scalers), weights).join(v.select("asset", "date", "t"), ["asset", "date"])

    return leakage.audit(panel(spark, d), build, OOS, ["neural_ensemble_variance", "garch_neural_weight"])


def wide_panel(spark: SparkSession, d: str) -> DataFrame:
    """A panel that grows with the tables: users by hour, and the hot asset ``ALL`` by minute."""
    return prep.returns(source.wide_bars(spark, d), "day")


def wide_calendar(spark: SparkSession, d: str) -> Calendar:
    """Calendar bounds from the days of the priced events."""
    days = source.user_ticks(spark, d).where("price > 0").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return Calendar.between(*days) if days[0] else CALENDAR


def wide_paths(spark: SparkSession, d: str) -> tuple[DataFrame, Calendar]:
    calendar = wide_calendar(spark, d)
    return written(recursion.variance_paths(wide_panel(spark, d), calendar.oos, FROZEN)), calendar


def wide_gate(spark: SparkSession, d: str) -> DataFrame:
    return dataset_of(*wide_paths(spark, d))


def _on_wide(build: Callable[[DataFrame, str], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p, c = wide_paths(spark, d)
        return build(p, c.oos)

    return run


QUERIES: dict[str, Query] = {
    # preparation
    "ohlc_bars": lambda s, d: rounded(source.event_bars(s, d)),
    "clean_bars": lambda s, d: rounded(prep.clean_bars(dirty_ticks(s, d))),
    "log_returns": lambda s, d: rounded(panel(s, d).select("asset", "date", "log_return", "realized_var_proxy")),
    "parkinson": lambda s, d: rounded(panel(s, d).select("asset", "date", "parkinson_var_proxy")),
    "fit_window": lambda s, d: rounded(prep.before(panel(s, d), OOS).select("asset", "date", "close", "log_return")),
    "pooled_panel": lambda s, d: rounded(prep.pooled(panel(s, d), DIMENSION).select("date", "asset", "category", "sector", "close", "log_return")),
    "reference_series": lambda s, d: rounded(prep.reference_series(source.event_ticks(s, d))),
    "index_series": lambda s, d: rounded(prep.index_series(source.event_bars(s, d), "view", "market_index")),
    "loaded_window": lambda s, d: rounded(loaded_window(s, d)),
    "coverage": lambda s, d: rounded(prep.coverage(panel(s, d), per_year=8760, extreme=1.0)),
    "category_counts": lambda s, d: prep.category_counts(prep.pooled(panel(s, d), DIMENSION)),
    "brand_bars": lambda s, d: rounded(source.ohlc(source.brand_ticks(s, d), "day"), 8),
    "brand_returns": lambda s, d: rounded(prep.returns(source.ohlc(source.brand_ticks(s, d), "day"), "year").select("asset", "date", "log_return")),
    # audits
    "series_profile": lambda s, d: quality.series_profile(panel(s, d)),
    "missing_counts": lambda s, d: quality.missing_counts(dirty_ticks(s, d)),
    "duplicate_dates": lambda s, d: quality.duplicate_dates(dirty_ticks(s, d)),
    "duplicate_keys": lambda s, d: quality.duplicate_keys(dirty_ticks(s, d)),
    "ohlc_checks": lambda s, d: quality.ohlc_checks(raw_bars(s, d)),
    "ohlc_violations": lambda s, d: rounded(quality.ohlc_violations(raw_bars(s, d))),
    "finite_checks": lambda s, d: quality.finite_checks(panel(s, d)),
    "extreme_rows": lambda s, d: rounded(quality.extreme_rows(panel(s, d), 3.0).select("asset", "date", "log_return")),
    "extreme_counts": lambda s, d: quality.extreme_counts(panel(s, d), 3.0),
    "asset_coverage": lambda s, d: quality.series_profile(source.event_bars(s, d)),
    "sequence_audit": lambda s, d: quality.sequence_audit(panel(s, d), source.event_bars(s, d).groupBy("asset").agg((F.count("*") - 1).alias("n_expected"))),
    "date_alignment": lambda s, d: quality.date_alignment(panel(s, d), ensemble.out_of_sample(source.event_bars(s, d), OOS)),
    "parity_audit": lambda s, d: rounded(quality.parity_audit(prep.clean_bars(dirty_ticks(s, d)), source.event_bars(s, d), ("open", "high", "close"))),
    "forecast_audit": lambda s, d: quality.forecast_audit(oos(s, d), MODELS),
    "table_fingerprint": lambda s, d: quality.fingerprint(source.event_ticks(s, d)),
    # static models
    "ewma_insample": lambda s, d: rounded(prep.before(affine(s, d), OOS).select("asset", "date", "ewma")),
    "garch_filter": lambda s, d: rounded(prep.before(affine(s, d), OOS).select("asset", "date", "garch")),
    "egarch_filter": lambda s, d: rounded(prep.before(paths(s, d), OOS).select("asset", "date", "egarch")),
    "gjr_filter": lambda s, d: rounded(prep.before(affine(s, d), OOS).select("asset", "date", "gjr_garch")),
    "garch_fit": lambda s, d: fitted(s, d).where("model = 'GARCH'"),
    "egarch_fit": lambda s, d: fitted(s, d).where("model = 'EGARCH'"),
    "gjr_fit": lambda s, d: fitted(s, d).where("model = 'GJR-GARCH'"),
    "param_table": lambda s, d: rounded(judged_parameters(s, d), 9),
    "persistence": lambda s, d: rounded(ruled_parameters(s, d).select("asset", "model", _persistence().alias("persistence"))),
    "info_criteria": lambda s, d: rounded(fit.information_criteria(scored_parameters(s, d)).select("asset", "log_likelihood", "aic", "bic"), 4),
    "fit_diagnostics": lambda s, d: rounded(fit.diagnostics(ruled_parameters(s, d)).select("asset", "model", "persistence", "labels")),
    "fit_summary": lambda s, d: fit.summary(judged_parameters(s, d)),
    "fitted_param_table": lambda s, d: fitted_parameters(s, d),
    "fitted_persistence": lambda s, d: fitted_parameters(s, d).select("asset", "model", _persistence().alias("persistence")),
    "fitted_diagnostics": lambda s, d: fit.diagnostics(fitted_parameters(s, d)).select("asset", "model", "persistence", "labels", "converged", "status"),
    "fitted_summary": lambda s, d: fit.summary(fitted_parameters(s, d)),
    # out-of-sample forecasts
    "warm_start": lambda s, d: rounded(forecast.warm_start(paths(s, d), OOS)),
    "ewma_oos": lambda s, d: rounded(ensemble.out_of_sample(affine(s, d), OOS).select("asset", "date", "ewma")),
    "garch_oos": lambda s, d: rounded(ensemble.out_of_sample(affine(s, d), OOS).select("asset", "date", "garch")),
    "egarch_oos": lambda s, d: rounded(ensemble.out_of_sample(paths(s, d), OOS).select("asset", "date", "egarch")),
    "gjr_oos": lambda s, d: rounded(ensemble.out_of_sample(affine(s, d), OOS).select("asset", "date", "gjr_garch")),
    "oos_table": lambda s, d: rounded(oos(s, d).drop("t")),
    "oos_by_asset": lambda s, d: rounded(forecast.oos_table(paths_by_asset(s, d), OOS).drop("t")),
    "fitted_oos_table": lambda s, d: forecast.oos_table(fitted_forecasts(s, d), OOS).drop("t"),
    "first_k_oos": lambda s, d: rounded(forecast.first_k(paths(s, d), OOS).select("asset", "date", "position", "previous_return", "garch")),
    "oos_leakage": lambda s, d: leakage.audit(panel(s, d), lambda p: recursion.variance_paths(p, OOS, FROZEN), OOS, list(MODELS)),
    # losses and rankings
    "forecast_metrics": lambda s, d: rounded(metric_table(s, d).drop("qlike_yf_clamped"), 5),
    "qlike_clamped": lambda s, d: rounded(metric_table(s, d).select("asset", "model", "target", "qlike_yf_clamped"), 5),
    "model_ranking": lambda s, d: metrics.ranking(metric_table(s, d)).select("asset", "model", "target", "rank_qlike_fy_masked", "rank_mae", "rank_rmse"),
    "mean_ranks": lambda s, d: rounded(metrics.mean_ranks(metrics.ranking(metric_table(s, d)), TARGETS[0])),
    "five_model_table": lambda s, d: rounded(metrics.forecast_metrics(combined(s, d), list(ENSEMBLE), list(TARGETS)).select("asset", "model", "target", "mae", "rmse"), 5),
    "table_integrity": lambda s, d: metrics.integrity(metric_table(s, d), 40, list(MODELS)),
    "metric_recheck": lambda s, d: rounded(metrics.recheck(metric_table(s, d), recomputed_metrics(s, d))),
    "gate_vs_baseline": lambda s, d: rounded(gate_versus(s, d).select("asset", "model", "target", "mae", "rmse", "qlike_yf_clamped"), 5),
    "improvement": lambda s, d: rounded(metrics.improvement(gate_versus(s, d), "static_ensemble_variance", "neural_ensemble_variance"), 4),
    # ensemble
    "warm_history": lambda s, d: rounded(ensemble.warm_history(paths(s, d), OOS).select("asset", "date", "realized_var_proxy", *MODELS)),
    "warmup_audit": lambda s, d: ensemble.warmup_audit(ensemble.warm_history(paths(s, d), OOS), OOS),
    "trailing_rmse": lambda s, d: rounded(ensemble.out_of_sample(ensemble.trailing_rmse(paths(s, d)), OOS).select("asset", "date", *(f"{m}_rmse" for m in MODELS))),
    "inverse_rmse_weights": lambda s, d: rounded(combined(s, d).select("asset", "date", *(f"{m}_weight" for m in MODELS))),
    "inverse_rmse_ensemble": lambda s, d: rounded(combined(s, d).select("asset", "date", "static_ensemble_variance", "static_ensemble_volatility")),
    "ensemble_by_asset": lambda s, d: rounded(ensemble.inverse_rmse_ensemble(paths_by_asset(s, d), OOS).select("asset", "date", "static_ensemble_variance", "static_ensemble_volatility")),
    "fitted_ensemble": lambda s, d: ensemble.inverse_rmse_ensemble(fitted_forecasts(s, d), OOS).select("asset", "date", "static_ensemble_variance", "static_ensemble_volatility"),
    "ensemble_audit": lambda s, d: ensemble.ensemble_audit(combined(s, d)),
    "window_recheck": lambda s, d: ensemble.window_recheck(affine(s, d), ensemble.out_of_sample(ensemble.trailing_rmse(affine(s, d), models=("garch",)), OOS)),
    "window_recheck_spaced": lambda s, d: rounded((lambda p: features.recomputed(p, ensemble.spaced(ensemble.out_of_sample(p, OOS))).select("asset", "t", *(f"{m}_rmse_60" for m in MODELS)))(paths(s, d))),
    "ensemble_leakage": lambda s, d: leakage.audit(paths(s, d), lambda p: ensemble.inverse_rmse_ensemble(p, OOS), OOS, ["static_ensemble_variance", *(f"{m}_weight" for m in MODELS)], targets_only=True),
    # features
    "gating_features": lambda s, d: rounded(features.gating_features(paths(s, d), OOS).drop("t")),
    "feature_audit": lambda s, d: features.feature_audit(features.gating_features(paths(s, d), OOS)),
    "feature_profile": lambda s, d: rounded(features.feature_profile(features.gating_features(paths(s, d), OOS)), 5),
    "feature_recheck": lambda s, d: rounded(quality.parity_audit(features.gating_features(paths(s, d), OOS).withColumnsRenamed({f"{m}_rmse_60": f"{m}_rmse" for m in MODELS}), ensemble.trailing_rmse(paths(s, d)), tuple(f"{m}_rmse" for m in MODELS))),
    "feature_leakage": lambda s, d: leakage.audit(panel(s, d), lambda p: features.gating_features(recursion.variance_paths(p, OOS, FROZEN), OOS), OOS, ["realized_vol_5", "realized_vol_20", "realized_vol_60", "ewma_rmse_60", "garch_rmse_60"], factor=10.0),
    "feature_recompute": lambda s, d: rounded((lambda p: features.recheck(features.gating_features(p, OOS), features.recomputed(p, ensemble.out_of_sample(p, OOS).where("t % 31 = 0"))))(paths(s, d)), 9),
    "feature_three_runs": lambda s, d: leakage.three_runs(panel(s, d), lambda p: features.gating_features(recursion.variance_paths(p, OOS, FROZEN), OOS), OOS, [f for f in FEATURES if f != "return_sign_lag1"]),
    "reference_check": lambda s, d: quality.reference_check(prep.reference_series(source.event_ticks(s, d)), "reference"),
    "variance_integrity": lambda s, d: quality.variance_integrity(paths(s, d), MODELS),
    # gate
    "gate_dataset": lambda s, d: rounded(gate_rows(s, d).select("asset", "date", "realized_vol_5", "vol_of_vol_30", "garch")),
    "time_split": lambda s, d: gate_rows(s, d).groupBy("asset", F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n_rows")),
    "feature_scaler": lambda s, d: rounded(gate.scaler(gate_rows(s, d)), 5),
    "scaled_features": lambda s, d: rounded((lambda t: gate.scaled(t, gate.scaler(t)))(gate_rows(s, d)).select("asset", "date", "realized_vol_5", "realized_vol_60", "garch_rmse_60"), 5),
    "gate_train": lambda s, d: trained(s, d)[1].select("asset", F.size("weights").alias("n_weights"), F.size("history").alias("n_epochs")),
    "gate_history": lambda s, d: gate.best_epochs(trained(s, d)[1]),
    "gate_fixed": lambda s, d: rounded(gated(gate_rows(s, d)).select("asset", "date", *(f"{m}_neural_weight" for m in MODELS), "neural_ensemble_variance"), 5),
    "gate_predict": lambda s, d: gate.predict(*trained(s, d)),
    "gate_trained_summary": trained_summary,
    "gate_trained_vs_baseline": lambda s, d: gate_versus(s, d, trained_gate=True),
    "gate_summary": lambda s, d: rounded(gate.summary(gated(gate_rows(s, d))), 5),
    "gate_leakage": lambda s, d: gate_leaks(s, d),
    # studies
    "diebold_mariano": lambda s, d: rounded(research.diebold_mariano(losses(s, d), "ewma", "garch"), 4),
    "var_backtest": lambda s, d: rounded(research.var_backtest(ensemble.out_of_sample(affine(s, d), OOS), "garch"), 5),
    "model_confidence_set": lambda s, d: rounded(confidence.confidence_set(ensemble_losses(s, d), ENSEMBLE), 5),
    "rolling_refits": lambda s, d: rolling.refits(panel(s, d)).select("asset", "model", "refit", "refit_date", "omega", "alpha", "beta", "log_likelihood", "n_rows", "converged", "status"),
    "rolling_forecasts": lambda s, d: rolling.forecasts(rolling.refits(panel(s, d))),
    "lookback_grid": lambda s, d: rounded(research.lookback_grid(affine(s, d).withColumns({"egarch": F.lit(None).cast("double")}), OOS), 5),
    "lookback_grid_all": lambda s, d: rounded(research.lookback_grid(paths(s, d), OOS, models=MODELS), 5),
    "regime_losses": lambda s, d: rounded((lambda p: research.regime_losses(features.gating_features(p, OOS), forecast.oos_table(p, OOS), MODELS))(paths(s, d)), 5),
    "option_prices": lambda s, d: rounded(research.at_the_money(ensemble.out_of_sample(affine(s, d), OOS), "garch"), 6),
    # a panel that grows with the tables
    "wide_log_returns": lambda s, d: rounded(wide_panel(s, d).select("asset", "date", "log_return", "realized_var_proxy")),
    "wide_oos_table": _on_wide(lambda p, oos: rounded(forecast.oos_table(p, oos).drop("t"))),
    "wide_inverse_rmse_ensemble": _on_wide(lambda p, oos: rounded(ensemble.inverse_rmse_ensemble(p, oos).select("asset", "date", "static_ensemble_variance", "static_ensemble_volatility"))),
    "wide_forecast_metrics": _on_wide(lambda p, oos: rounded(metrics.forecast_metrics(forecast.oos_table(p, oos), list(MODELS), list(TARGETS)).drop("qlike_yf_clamped"), 5)),
    "wide_gating_features": _on_wide(lambda p, oos: rounded(features.gating_features(p, oos).drop("t"))),
    "wide_time_split": lambda s, d: wide_gate(s, d).groupBy("asset", F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n_rows")),
    "wide_gate_fixed": lambda s, d: rounded(gated(wide_gate(s, d)).select("asset", "date", *(f"{m}_neural_weight" for m in MODELS), "neural_ensemble_variance"), 5),
    # streaming
    "stream_walk_forward": lambda s, d: rounded(ensemble.out_of_sample(streamed(s, d), OOS).select("asset", "date", *MODELS, "static_ensemble_variance")),
    "stream_ticks_walk_forward": lambda s, d: rounded(ensemble.out_of_sample(streamed_ticks(s, d), OOS).select("asset", "date", *MODELS, "static_ensemble_variance")),
}
