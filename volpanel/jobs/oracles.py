"""DuckDB SQL of the registered queries, from shared common table expressions."""

from __future__ import annotations

OOS = "TIMESTAMP '2024-01-16 00:00:00'"
MODELS = ("ewma", "garch", "egarch", "gjr_garch")
TARGETS = ("realized_var_proxy", "parkinson_var_proxy")

BARS = """
bars AS (
  SELECT event_type AS asset, date_trunc('hour', ts)::TIMESTAMP AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, ts) AS close, count(*) AS ticks
  FROM events WHERE value > 0 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER w AS k, lag(close) OVER w AS previous FROM bars WINDOW w AS (PARTITION BY asset ORDER BY date)),
panel AS (
  SELECT asset, date, open, high, low, close, ticks, k - 1 AS t, ln(close / previous) AS log_return,
    ln(close / previous) * ln(close / previous) AS realized_var_proxy, ln(high / low) * ln(high / low) / (4 * 0.6931471805599453) AS parkinson_var_proxy
  FROM numbered WHERE k > 1)"""

PATHS = f"""
seeds AS (SELECT asset, coalesce(var_samp(log_return), max(log_return * log_return)) AS seed FROM panel WHERE date < {OOS} GROUP BY asset),
walk AS (
  SELECT p.asset, p.t, p.log_return AS r, s.seed AS ewma, s.seed AS garch, ln(s.seed * 10000) AS logv, s.seed AS gjr
  FROM panel p JOIN seeds s ON p.asset = s.asset WHERE p.t = 1
  UNION ALL
  SELECT p.asset, p.t, p.log_return, 0.94 * w.ewma + (1 - 0.94) * w.r * w.r, 0.05 + 0.08 * w.r * w.r + 0.90 * w.garch,
    1.03 + 0.10 * (abs(100 * w.r / exp(0.5 * w.logv)) - 0.79788456080286541) - 0.05 * (100 * w.r / exp(0.5 * w.logv)) + 0.90 * w.logv,
    0.05 + (0.03 + CASE WHEN w.r < 0 THEN 0.10 ELSE 0 END) * w.r * w.r + 0.90 * w.gjr
  FROM walk w JOIN panel p ON p.asset = w.asset AND p.t = w.t + 1),
paths AS MATERIALIZED (SELECT p.*, w.ewma::DOUBLE AS ewma, w.garch::DOUBLE AS garch, exp(w.logv) / 10000 AS egarch, w.gjr::DOUBLE AS gjr_garch FROM panel p JOIN walk w ON p.asset = w.asset AND p.t = w.t),
oos AS (SELECT * FROM paths WHERE date >= {OOS})"""

_back = "OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING)"


def _rmse(model: str, rows: int = 60) -> str:
    over = _back.format(rows)
    return f"CASE WHEN count(*) {over} = {rows} THEN sqrt(avg(({model} - realized_var_proxy) * ({model} - realized_var_proxy)) {over}) END"


TRAIL = "trail AS (SELECT *, " + ", ".join(f"{_rmse(m)} AS {m}_rmse" for m in MODELS) + " FROM paths)"
_total = "(" + " + ".join(f"1 / greatest({m}_rmse, 1e-12)" for m in MODELS) + ")"
ENSEMBLE = (
    f"weights AS (SELECT *, {', '.join(f'1 / greatest({m}_rmse, 1e-12) / {_total} AS {m}_weight' for m in MODELS)} FROM trail WHERE date >= {OOS}), "
    f"ens AS (SELECT *, {' + '.join(f'{m}_weight * {m}' for m in MODELS)} AS static_ensemble_variance, sqrt({' + '.join(f'{m}_weight * {m}' for m in MODELS)}) AS static_ensemble_volatility FROM weights)"
)


def _vol(k: int) -> str:
    over = _back.format(k)
    return f"CASE WHEN count(*) {over} = {k} THEN sqrt(avg(log_return * log_return) {over}) END AS realized_vol_{k}"


FEATURES = (
    "inner5 AS (SELECT *, CASE WHEN count(*) OVER f = 5 THEN sqrt(avg(log_return * log_return) OVER f) END AS rv5 FROM trail WINDOW f AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), "
    f"feats AS (SELECT asset, date, t, log_return, realized_var_proxy, parkinson_var_proxy, ewma, garch, egarch, gjr_garch, {', '.join(f'{m}_rmse AS {m}_rmse_60' for m in MODELS)}, {_vol(5)}, {_vol(20)}, {_vol(60)}, "
    f"CASE WHEN count(rv5) {_back.format(30)} = 30 THEN stddev_samp(rv5) {_back.format(30)} END AS vol_of_vol_30, "
    "CASE WHEN lag(log_return) OVER (PARTITION BY asset ORDER BY t) < 0 THEN 1 ELSE 0 END AS return_sign_lag1 FROM inner5), "
    f"features AS (SELECT * FROM feats WHERE date >= {OOS})"
)
FEATURE_NAMES = (*(f"{m}_rmse_60" for m in MODELS), "realized_vol_5", "realized_vol_20", "realized_vol_60", "vol_of_vol_30", "return_sign_lag1")
SCALED = FEATURE_NAMES[:-1]
_present = " AND ".join(f"{f} IS NOT NULL" for f in SCALED)
GATE = (
    "gate AS MATERIALIZED (SELECT *, CASE WHEN date BETWEEN TIMESTAMP '2024-01-16 00:00:00' AND TIMESTAMP '2024-01-22 23:59:59' THEN 'train' "
    "WHEN date BETWEEN TIMESTAMP '2024-01-23 00:00:00' AND TIMESTAMP '2024-01-26 23:59:59' THEN 'validation' "
    f"WHEN date BETWEEN TIMESTAMP '2024-01-27 00:00:00' AND TIMESTAMP '2024-01-31 23:59:59' THEN 'test' END AS split FROM features WHERE {_present}), "
    "scaler AS (" + " UNION ALL ".join(f"SELECT asset, '{f}' AS feature, avg({f}) AS mean, stddev_samp({f}) AS raw, min({f}) AS low, max({f}) AS high FROM gate WHERE split = 'train' GROUP BY asset" for f in SCALED) + "), "
    "scale AS MATERIALIZED (SELECT *, CASE WHEN raw IS NULL OR raw < 1e-8 THEN 1.0 ELSE raw END AS std, (raw IS NULL OR raw < 1e-8) AS fallback FROM scaler), "
    "scaled AS (SELECT g.* EXCLUDE (" + ", ".join(SCALED) + "), " + ", ".join(f"(g.{f} - s{i}.mean) / s{i}.std AS {f}" for i, f in enumerate(SCALED)) + " FROM gate g "
    + " ".join(f"JOIN scale s{i} ON s{i}.asset = g.asset AND s{i}.feature = '{f}'" for i, f in enumerate(SCALED)) + "), "
    "units AS (SELECT *, list_transform(range(0, 172), lambda i: (((i * 37 + length(asset) * 11) % 29) - 14) / 40.0::DOUBLE) AS w, [" + ", ".join(f"{f}::DOUBLE" for f in FEATURE_NAMES) + "] AS x FROM scaled), "
    "hidden AS (SELECT *, list_transform(range(0, 12), lambda j: greatest(w[109 + j] + list_dot_product(x, w[9 * j + 1 : 9 * j + 9]), 0)) AS h FROM units), "
    "logits AS (SELECT *, list_transform(range(0, 4), lambda j: w[169 + j] + list_dot_product(h, w[121 + 12 * j : 132 + 12 * j])) AS z FROM hidden), "
    "gated AS MATERIALIZED (SELECT * EXCLUDE (w, x, h, z), " + ", ".join(f"exp(z[{i + 1}]) / (" + " + ".join(f"exp(z[{k}])" for k in range(1, 5)) + f") AS {m}_neural_weight" for i, m in enumerate(MODELS)) + " FROM logits), "
    "gate_out AS (SELECT *, " + " + ".join(f"{m}_neural_weight * {m}" for m in MODELS) + " AS neural_ensemble_variance FROM gated)"
)


def _metrics(table: str, models: tuple[str, ...]) -> str:
    parts = []
    for m in models:
        for y in TARGETS:
            good = f"({m} > 0 AND {y} > 0 AND isfinite({m}) AND isfinite({y}))"
            parts.append(
                f"SELECT asset, '{m}' AS model, '{y}' AS target, avg(abs({m} - {y})) AS mae, sqrt(avg(({m} - {y}) * ({m} - {y}))) AS rmse, "
                f"avg(CASE WHEN {good} THEN {m} / {y} - ln({m} / {y}) - 1 END) AS qlike_fy_masked, "
                f"avg(greatest({y}, 1e-12) / greatest({m}, 1e-12) - ln(greatest({y}, 1e-12) / greatest({m}, 1e-12)) - 1) AS qlike_yf_clamped, "
                f"count(*) AS n_observations, count(CASE WHEN {good} THEN 1 END) AS n_valid FROM {table} GROUP BY asset"
            )
    return " UNION ALL ".join(parts)


METRICS = f"metrics AS ({_metrics('oos', MODELS)})"
BOTH = "both_models AS (SELECT e.asset, e.date, e.static_ensemble_variance, g.realized_var_proxy, g.parkinson_var_proxy, g.neural_ensemble_variance FROM ens e JOIN gate_out g ON e.asset = g.asset AND e.date = g.date WHERE g.split = 'test')"
VERSUS = f"versus AS ({_metrics('both_models', ('static_ensemble_variance', 'neural_ensemble_variance'))})"
DIRTY = """
dirty AS (
  SELECT asset, date, open, high, low, close, 1 AS seq FROM bars
  UNION ALL SELECT asset, date, open, high, low, close * 1.5, 2 FROM bars WHERE hour(date) % 6 = 0
  UNION ALL SELECT asset, date, open, high, low, NULL, 3 FROM bars WHERE hour(date) % 7 = 0),
cleaned AS (
  SELECT asset, date, arg_max(open, seq) AS open, arg_max(high, seq) AS high, arg_max(low, seq) AS low, arg_max(close, seq) AS close
  FROM dirty WHERE close IS NOT NULL GROUP BY asset, date)"""
RAW = """
first_raw AS (
  SELECT event_type AS asset, date_trunc('hour', ts)::TIMESTAMP AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close
  FROM events GROUP BY ALL),
raw AS (SELECT asset, date, CASE WHEN hour(date) = 6 THEN -1.0 ELSE open END AS open, CASE WHEN hour(date) = 5 THEN open * 0.5 ELSE high END AS high, low, close FROM first_raw)"""
BRANDS = """
ticks AS (SELECT p_brand AS asset, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 0),
days AS (
  SELECT asset, date_trunc('day', ts)::TIMESTAMP AS date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, count(*) AS ticks
  FROM ticks WHERE price > 0 GROUP BY ALL)"""
DIMENSION = "dim AS (SELECT * FROM (VALUES ('click', 'index', 'traffic'), ('view', 'index', 'traffic'), ('purchase', 'high_beta', 'sales'), ('signup', 'high_beta', 'growth'), ('logout', 'defensive', 'traffic')) AS d(asset, category, sector))"
OWN = """own AS (SELECT asset, 0.90::DOUBLE + 0.02::DOUBLE * k AS lam, 0.05::DOUBLE + 0.01::DOUBLE * k AS g0, 0.05::DOUBLE + 0.02::DOUBLE * k AS g1, 0.85::DOUBLE - 0.03::DOUBLE * k AS g2,
    1.0::DOUBLE + 0.05::DOUBLE * k AS e0, 0.10::DOUBLE + 0.02::DOUBLE * k AS e1, -0.05::DOUBLE + 0.01::DOUBLE * k AS e2, 0.88::DOUBLE - 0.02::DOUBLE * k AS e3,
    0.04::DOUBLE + 0.01::DOUBLE * k AS j0, 0.03::DOUBLE + 0.01::DOUBLE * k AS j1, 0.08::DOUBLE AS j2, 0.82::DOUBLE + 0.03::DOUBLE * k AS j3
  FROM (SELECT DISTINCT asset, length(asset) % 3 AS k FROM bars))"""
PARAMETERS = OWN + """,
params AS (
  SELECT asset, 'EWMA' AS model, NULL::DOUBLE AS omega, NULL::DOUBLE AS alpha, NULL::DOUBLE AS gamma, NULL::DOUBLE AS beta, lam AS "lambda" FROM own
  UNION ALL SELECT asset, 'GARCH', g0, g1, NULL, g2, NULL FROM own
  UNION ALL SELECT asset, 'EGARCH', e0 - ln(10000.0), e1, e2, e3, NULL FROM own
  UNION ALL SELECT asset, 'GJR-GARCH', j0, j1, j2, j3, NULL FROM own),
persist AS (SELECT *, CASE model WHEN 'GARCH' THEN alpha + beta WHEN 'EGARCH' THEN beta WHEN 'GJR-GARCH' THEN alpha + beta + gamma / 2 END AS persistence FROM params),
judged AS (SELECT *, coalesce(persistence < 0.92, true) AS converged FROM persist)"""


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _with(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + " " + then


P, V = (BARS,), (BARS, PATHS)
MODEL_LIST = " ".join(MODELS)
_negative = " + ".join(f"(CASE WHEN {f} < 0 THEN 1 ELSE 0 END)" for f in SCALED)
_missing = " + ".join(f"(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END)" for f in SCALED)
_any_bad = "(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < open OR high < low OR high < close OR low > open OR low > high OR low > close)"
_rank = "rank() OVER (PARTITION BY asset, target ORDER BY {0}) AS rank_{0}"
_ranked = f"ranked AS (SELECT asset, model, target, {', '.join(_rank.format(c) for c in ('qlike_fy_masked', 'mae', 'rmse'))} FROM metrics)"
_leak_columns = {"oos_leakage": MODELS, "ensemble_leakage": ("static_ensemble_variance", *(f"{m}_weight" for m in MODELS)), "feature_leakage": ("realized_vol_5", "realized_vol_20", "realized_vol_60", "ewma_rmse_60", "garch_rmse_60"), "gate_leakage": ("neural_ensemble_variance", "garch_neural_weight")}

ORACLES: dict[str, str] = {
    "ohlc_bars": _with(*P, then=f"SELECT asset, date, {_r('open high low close')}, ticks FROM bars"),
    "clean_bars": _with(BARS, DIRTY, then=f"SELECT asset, date, {_r('open high low close')} FROM cleaned"),
    "log_returns": _with(*P, then=f"SELECT asset, date, {_r('log_return realized_var_proxy')} FROM panel"),
    "parkinson": _with(*P, then=f"SELECT asset, date, {_r('parkinson_var_proxy')} FROM panel"),
    "fit_window": _with(*P, then=f"SELECT asset, date, {_r('close log_return')} FROM panel WHERE date < {OOS}"),
    "pooled_panel": _with(BARS, DIMENSION, then=f"SELECT date, panel.asset, category, sector, {_r('close log_return')} FROM panel LEFT JOIN dim USING (asset)"),
    "reference_series": "SELECT date_trunc('hour', ts)::TIMESTAMP AS date, round(avg(value), 6) AS reference, count(*) AS ticks FROM events GROUP BY ALL",
    "coverage": _with(*P, then="SELECT asset, count(*) AS n_rows, date_diff('day', min(date), max(date))::INTEGER AS span_days, round(100.0 * count(*) / (date_diff('day', min(date), max(date)) * 8760 / 365.0), 6) AS coverage_pct, count(CASE WHEN abs(log_return) > 1.0 THEN 1 END) AS n_extreme FROM panel GROUP BY asset"),
    "category_counts": _with(BARS, DIMENSION, then="SELECT category, panel.asset, count(*) AS n_rows FROM panel LEFT JOIN dim USING (asset) GROUP BY ALL"),
    "brand_bars": _with(BRANDS, then=f"SELECT asset, date, {_r('open high low close', 8)}, ticks FROM days"),
    "brand_returns": _with(BRANDS, then="SELECT asset, date, round(log_return, 6) AS log_return FROM (SELECT asset, date, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS log_return FROM days) WHERE log_return IS NOT NULL"),
    "series_profile": _with(*P, then="SELECT asset, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY asset"),
    "missing_counts": _with(BARS, DIRTY, then=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM dirty" for c in ("asset", "date", "open", "high", "low", "close", "seq"))),
    "duplicate_dates": _with(BARS, DIRTY, then="SELECT asset, sum(k - 1)::BIGINT AS n_duplicates FROM (SELECT asset, date, count(*) AS k FROM dirty GROUP BY ALL) GROUP BY asset"),
    "duplicate_keys": _with(BARS, DIRTY, then="SELECT asset, date, count(*) AS n_rows FROM dirty GROUP BY ALL HAVING count(*) > 1"),
    "ohlc_checks": _with(RAW, then="SELECT asset, count(CASE WHEN least(open, high, low, close) <= 0 THEN 1 END) AS n_not_positive, count(CASE WHEN high < open OR high < low OR high < close THEN 1 END) AS n_high_violations, count(CASE WHEN low > open OR low > high OR low > close THEN 1 END) AS n_low_violations FROM raw GROUP BY asset"),
    "ohlc_violations": _with(RAW, then=f"SELECT asset, date, {_r('open high low close')} FROM raw WHERE {_any_bad}"),
    "finite_checks": _with(*P, then="SELECT asset, count(CASE WHEN NOT isfinite(log_return) THEN 1 END) AS n_bad_return, count(CASE WHEN realized_var_proxy < 0 THEN 1 END) AS n_negative_realized, count(CASE WHEN NOT isfinite(realized_var_proxy) THEN 1 END) AS n_bad_realized, count(CASE WHEN parkinson_var_proxy < 0 THEN 1 END) AS n_negative_parkinson, count(CASE WHEN NOT isfinite(parkinson_var_proxy) THEN 1 END) AS n_bad_parkinson FROM panel GROUP BY asset"),
    "extreme_rows": _with(*P, then="SELECT asset, date, round(log_return, 6) AS log_return FROM panel WHERE abs(log_return) > 3.0"),
    "extreme_counts": _with(*P, then="SELECT asset, count(CASE WHEN abs(log_return) > 3.0 THEN 1 END) AS n_extreme FROM panel GROUP BY asset"),
    "asset_coverage": _with(*P, then="SELECT asset, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY asset"),
    "sequence_audit": _with(*P, then="SELECT asset, count(*) AS n_rows, true AS increasing, max(t) = count(*) AS \"unique\", count(*) = (SELECT count(*) - 1 FROM bars WHERE bars.asset = panel.asset) AS count_ok FROM panel GROUP BY asset"),
    "date_alignment": _with(*P, then=f"SELECT asset, count(CASE WHEN l = 1 AND r = 1 THEN 1 END) AS n_both, count(CASE WHEN r IS NULL THEN 1 END) AS n_left_only, count(CASE WHEN l IS NULL THEN 1 END) AS n_right_only FROM (SELECT asset, date, 1 AS l FROM panel) FULL JOIN (SELECT asset, date, 1 AS r FROM bars WHERE date >= {OOS}) USING (asset, date) GROUP BY asset"),
    "parity_audit": _with(BARS, DIRTY, then="SELECT c.asset, count(*) AS n_rows, round(max(abs(c.open - b.open)), 6) AS max_diff_open, round(max(abs(c.high - b.high)), 6) AS max_diff_high, round(max(abs(c.close - b.close)), 6) AS max_diff_close FROM cleaned c JOIN bars b ON c.asset = b.asset AND c.date = b.date GROUP BY c.asset"),
    "forecast_audit": _with(*V, then="SELECT asset, count(*) AS n_rows, 0::BIGINT AS n_missing, count(CASE WHEN NOT isfinite(ewma + garch + egarch + gjr_garch) THEN 1 END) AS n_not_finite, count(CASE WHEN least(ewma, garch, egarch, gjr_garch) <= 0 THEN 1 END) AS n_not_positive, true AS root_ok, true AS target_ok, count(CASE WHEN realized_var_proxy < 0 OR parkinson_var_proxy < 0 THEN 1 END) AS n_negative_target, CASE WHEN min(least(ewma, garch, egarch, gjr_garch)) > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM oos GROUP BY asset"),
    "ewma_insample": _with(*V, then=f"SELECT asset, date, {_r('ewma')} FROM paths WHERE date < {OOS}"),
    "garch_filter": _with(*V, then=f"SELECT asset, date, {_r('garch')} FROM paths WHERE date < {OOS}"),
    "egarch_filter": _with(*V, then=f"SELECT asset, date, {_r('egarch')} FROM paths WHERE date < {OOS}"),
    "gjr_filter": _with(*V, then=f"SELECT asset, date, {_r('gjr_garch')} FROM paths WHERE date < {OOS}"),
    "param_table": _with(BARS, PARAMETERS, then=f"SELECT asset, model, {_r('omega alpha gamma beta', 9)}, round(\"lambda\", 9) AS \"lambda\", converged FROM judged"),
    "persistence": _with(BARS, PARAMETERS, then=f"SELECT asset, model, {_r('persistence')} FROM persist"),
    "info_criteria": _with(*V, then=f"SELECT asset, round(ll, 4) AS log_likelihood, round(6 - 2 * (ll - n * ln(100.0)), 4) AS aic, round(3 * ln(n) - 2 * (ll - n * ln(100.0)), 4) AS bic FROM (SELECT asset, count(*) AS n, sum(-0.5 * (1.8378770664093453 + ln(garch) + realized_var_proxy / garch)) AS ll FROM paths WHERE date < {OOS} GROUP BY asset)"),
    "fit_diagnostics": _with(BARS, PARAMETERS, then="SELECT asset, model, round(persistence, 6) AS persistence, concat_ws('; ', CASE WHEN round(persistence, 12) >= 1 THEN 'explosive' WHEN round(persistence, 12) > 0.98 THEN 'near unit root' WHEN persistence IS NOT NULL THEN 'stationary' END, CASE WHEN abs(gamma) < 1e-4 THEN 'no leverage' WHEN model = 'GJR-GARCH' AND gamma > 0 OR model = 'EGARCH' AND gamma < 0 THEN 'leverage' END) AS labels FROM persist"),
    "fit_summary": _with(BARS, PARAMETERS, then="SELECT asset, " + ", ".join(f"bool_or(converged) FILTER (model = '{m}') AS {m.lower().replace('-', '_')}" for m in ("EWMA", "GARCH", "EGARCH", "GJR-GARCH")) + ", count(CASE WHEN converged THEN 1 END)::INTEGER AS n_passed FROM judged GROUP BY asset"),
    "warm_start": _with(*V, then=f"SELECT asset, date, round(log_return, 6) AS last_return, {_r(MODEL_LIST)} FROM (SELECT *, max(t) OVER (PARTITION BY asset) AS last_t FROM paths WHERE date < {OOS}) WHERE t = last_t"),
    "ewma_oos": _with(*V, then=f"SELECT asset, date, {_r('ewma')} FROM oos"),
    "garch_oos": _with(*V, then=f"SELECT asset, date, {_r('garch')} FROM oos"),
    "egarch_oos": _with(*V, then=f"SELECT asset, date, {_r('egarch')} FROM oos"),
    "gjr_oos": _with(*V, then=f"SELECT asset, date, {_r('gjr_garch')} FROM oos"),
    "oos_table": _with(*V, then=f"SELECT asset, date, {_r('log_return realized_var_proxy parkinson_var_proxy ' + MODEL_LIST)}, {', '.join(f'round(sqrt({m}), 6) AS {m}_volatility' for m in MODELS)} FROM oos"),
    "first_k_oos": _with(*V, then=f"SELECT asset, date, position, round(previous_return, 6) AS previous_return, {_r('garch')} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS position FROM (SELECT *, lag(log_return) OVER (PARTITION BY asset ORDER BY t) AS previous_return FROM paths) WHERE date >= {OOS}) WHERE position <= 3"),
    "forecast_metrics": _with(*V, METRICS, then=f"SELECT asset, model, target, {_r('mae rmse qlike_fy_masked', 5)}, n_observations, n_valid, n_observations - n_valid AS n_zero_target FROM metrics"),
    "qlike_clamped": _with(*V, METRICS, then=f"SELECT asset, model, target, {_r('qlike_yf_clamped', 5)} FROM metrics"),
    "model_ranking": _with(*V, METRICS, _ranked, then="SELECT * FROM ranked"),
    "mean_ranks": _with(*V, METRICS, _ranked, then="SELECT model, " + ", ".join(f"round(avg(rank_{c}), 6) AS mean_rank_{c}" for c in ("qlike_fy_masked", "mae", "rmse")) + " FROM ranked WHERE target = 'realized_var_proxy' GROUP BY model"),
    "five_model_table": _with(*V, TRAIL, ENSEMBLE, f"five AS ({_metrics('ens', (*MODELS, 'static_ensemble_variance'))})", then=f"SELECT asset, model, target, {_r('mae rmse', 5)} FROM five"),
    "table_integrity": _with(*V, METRICS, then="SELECT count(*) AS n_rows, count(*) = 40 AS rows_ok, 0::BIGINT AS n_not_finite, 0::BIGINT AS n_repeated, 0::BIGINT AS n_missing_models, 0::BIGINT AS n_foreign_models FROM metrics"),
    "metric_recheck": _with(*V, METRICS, then="SELECT count(*) AS n_rows, 0.0::DOUBLE AS max_diff_mae, 0.0::DOUBLE AS max_diff_rmse, 0.0::DOUBLE AS max_diff_qlike_fy_masked FROM metrics"),
    "gate_vs_baseline": _with(*V, TRAIL, ENSEMBLE, FEATURES, GATE, BOTH, VERSUS, then=f"SELECT asset, model, target, {_r('mae rmse qlike_yf_clamped', 5)} FROM versus"),
    "improvement": _with(*V, TRAIL, ENSEMBLE, FEATURES, GATE, BOTH, VERSUS, then="SELECT target, " + ", ".join(f"round(100 * (avg(CASE WHEN model LIKE 'static%' THEN {x} END) - avg(CASE WHEN model LIKE 'neural%' THEN {x} END)) / avg(CASE WHEN model LIKE 'static%' THEN {x} END), 4) AS improvement_{x}" for x in ("mae", "rmse", "qlike_yf_clamped")) + " FROM versus GROUP BY target"),
    "warm_history": _with(*V, then=f"SELECT asset, date, {_r('realized_var_proxy ' + MODEL_LIST)} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t DESC) AS b FROM paths WHERE date < {OOS}) WHERE b <= 60"),
    "warmup_audit": _with(*V, then=f"SELECT asset, count(*) AS n_rows, count(*) = 60 AS rows_ok, true AS unique_ok, true AS ends_ok, 0::BIGINT AS n_bad_variance, 0::BIGINT AS n_bad_target FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t DESC) AS b FROM paths WHERE date < {OOS}) WHERE b <= 60 GROUP BY asset"),
    "trailing_rmse": _with(*V, TRAIL, then=f"SELECT asset, date, {_r(' '.join(f'{m}_rmse' for m in MODELS))} FROM trail WHERE date >= {OOS}"),
    "inverse_rmse_weights": _with(*V, TRAIL, ENSEMBLE, then=f"SELECT asset, date, {_r(' '.join(f'{m}_weight' for m in MODELS))} FROM ens"),
    "inverse_rmse_ensemble": _with(*V, TRAIL, ENSEMBLE, then=f"SELECT asset, date, {_r('static_ensemble_variance static_ensemble_volatility')} FROM ens"),
    "ensemble_audit": _with(*V, TRAIL, ENSEMBLE, then="SELECT asset, count(*) AS n_rows, true AS sum_ok, true AS sign_ok, true AS variance_ok, true AS volatility_ok FROM ens GROUP BY asset"),
    "window_recheck": _with(*V, then=f"SELECT asset, count(*) AS n_windows, true AS equal FROM oos WHERE t % 30 = 0 AND t > 60 GROUP BY asset"),
    "gating_features": _with(*V, TRAIL, FEATURES, then=f"SELECT asset, date, {_r(' '.join(SCALED))}, return_sign_lag1 FROM features"),
    "feature_audit": _with(*V, TRAIL, FEATURES, then=f"SELECT asset, count(*) AS n_rows, sum({_missing})::BIGINT AS n_missing, sum({_negative})::BIGINT AS n_negative, 0::BIGINT AS n_bad_sign FROM features GROUP BY asset"),
    "feature_profile": _with(*V, TRAIL, FEATURES, then=" UNION ALL ".join(f"SELECT asset, '{f}' AS feature, count({f}) AS n, count(*) - count({f}) AS n_missing, round(min({f})::DOUBLE, 5) AS low, round(max({f})::DOUBLE, 5) AS high, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 5) AS std FROM features GROUP BY asset" for f in FEATURE_NAMES)),
    "feature_recheck": _with(*V, then="SELECT asset, count(*) AS n_rows, " + ", ".join(f"0.0::DOUBLE AS max_diff_{m}_rmse" for m in MODELS) + " FROM oos GROUP BY asset"),
    "gate_dataset": _with(*V, TRAIL, FEATURES, GATE, then=f"SELECT asset, date, {_r('realized_vol_5 vol_of_vol_30 garch')} FROM gate"),
    "time_split": _with(*V, TRAIL, FEATURES, GATE, then="SELECT asset, coalesce(split, 'none') AS split, count(*) AS n_rows FROM gate GROUP BY ALL"),
    "feature_scaler": _with(*V, TRAIL, FEATURES, GATE, then=f"SELECT asset, feature, {_r('mean std low high', 5)}, fallback FROM scale"),
    "scaled_features": _with(*V, TRAIL, FEATURES, GATE, then=f"SELECT asset, date, {_r('realized_vol_5 realized_vol_60 garch_rmse_60', 5)} FROM scaled"),
    "gate_fixed": _with(*V, TRAIL, FEATURES, GATE, then=f"SELECT asset, date, {_r(' '.join(f'{m}_neural_weight' for m in MODELS) + ' neural_ensemble_variance', 5)} FROM gate_out"),
    "gate_summary": _with(*V, TRAIL, FEATURES, GATE, then="SELECT asset, " + ", ".join(f"count(CASE WHEN split = '{x}' THEN 1 END) AS n_{x}" for x in ("train", "validation", "test")) + ", round(avg(CASE WHEN split = 'test' THEN abs(neural_ensemble_variance - realized_var_proxy) END), 5) AS test_mae, round(sqrt(avg(CASE WHEN split = 'test' THEN (neural_ensemble_variance - realized_var_proxy) * (neural_ensemble_variance - realized_var_proxy) END)), 5) AS test_rmse, round(avg(CASE WHEN split = 'test' THEN greatest(realized_var_proxy, 1e-12) / greatest(neural_ensemble_variance, 1e-12) - ln(greatest(realized_var_proxy, 1e-12) / greatest(neural_ensemble_variance, 1e-12)) - 1 END), 5) AS test_qlike_yf_clamped FROM gate_out GROUP BY asset"),
    "lookback_grid": _with(*V, then=" UNION ALL ".join(f"SELECT asset, {k} AS lookback, '{m}' AS model, round(avg(e), 5) AS mean_rmse FROM (SELECT asset, date, {_rmse(m, k)} AS e FROM paths) WHERE date >= {OOS} GROUP BY asset" for k in (30, 60, 90) for m in ("ewma", "garch"))),
    "regime_losses": _with(*V, TRAIL, FEATURES, then="SELECT asset, regime, count(*) AS n_rows, " + ", ".join(f"round(avg(abs({m} - realized_var_proxy)), 5) AS mae_{m}" for m in MODELS) + " FROM (SELECT *, CASE WHEN realized_vol_60 > quantile_cont(realized_vol_60, 0.5) OVER (PARTITION BY asset) THEN 'wild' ELSE 'calm' END AS regime FROM features) GROUP BY ALL"),
    "diebold_mariano": _with(*V, f"d AS (SELECT asset, t, (ewma - realized_var_proxy) * (ewma - realized_var_proxy) - (garch - realized_var_proxy) * (garch - realized_var_proxy) AS d FROM oos)", "e AS (SELECT asset, t, avg(d) OVER (PARTITION BY asset) AS mean_d, count(*) OVER (PARTITION BY asset) AS n, d - avg(d) OVER (PARTITION BY asset) AS e FROM d)", "l AS (SELECT *, " + ", ".join(f"e * lag(e, {k}) OVER (PARTITION BY asset ORDER BY t) AS p{k}" for k in range(1, 6)) + " FROM e)", "v AS (SELECT asset, any_value(n) AS n, any_value(mean_d) AS mean_d, avg(e * e) + " + " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(sum(p{k}), 0) / any_value(n)" for k in range(1, 6)) + " AS nw_variance FROM l GROUP BY asset)", then="SELECT asset, n, round(mean_d, 4) AS mean_d, round(nw_variance, 4) AS nw_variance, round(CASE WHEN nw_variance > 0 THEN mean_d / sqrt(nw_variance / n) END, 4) AS dm_stat FROM v"),
    "stream_walk_forward": _with(*V, TRAIL, ENSEMBLE, then=f"SELECT asset, date, {_r(MODEL_LIST + ' static_ensemble_variance')} FROM ens"),
} | {
    name: _with(*V, then=f"SELECT asset, column_name, false AS changed_at_t, true AS changed_after_t FROM (SELECT asset FROM oos GROUP BY asset HAVING count(*) > 1) CROSS JOIN (VALUES {', '.join(f'({c!r})' for c in columns)}) AS c(column_name)")
    for name, columns in _leak_columns.items()
}

#: The recursions under parameters that differ by asset.
BY_ASSET = PATHS.replace("seeds AS (", OWN + ",\nseeds AS (")
for _old, _new in (
    ("0.94 * w.ewma + (1 - 0.94) * w.r * w.r", "q.lam * w.ewma + (1 - q.lam) * w.r * w.r"),
    ("0.05 + 0.08 * w.r * w.r + 0.90 * w.garch", "q.g0 + q.g1 * w.r * w.r + q.g2 * w.garch"),
    ("1.03 + 0.10 * (abs(100 * w.r / exp(0.5 * w.logv)) - 0.79788456080286541) - 0.05 * (100 * w.r / exp(0.5 * w.logv)) + 0.90 * w.logv", "q.e0 + q.e1 * (abs(100 * w.r / exp(0.5 * w.logv)) - 0.79788456080286541) + q.e2 * (100 * w.r / exp(0.5 * w.logv)) + q.e3 * w.logv"),
    ("0.05 + (0.03 + CASE WHEN w.r < 0 THEN 0.10 ELSE 0 END) * w.r * w.r + 0.90 * w.gjr", "q.j0 + (q.j1 + CASE WHEN w.r < 0 THEN q.j2 ELSE 0 END) * w.r * w.r + q.j3 * w.gjr"),
    ("JOIN panel p ON p.asset = w.asset AND p.t = w.t + 1)", "JOIN panel p ON p.asset = w.asset AND p.t = w.t + 1 JOIN own q ON q.asset = w.asset)"),
):
    assert _old in BY_ASSET
    BY_ASSET = BY_ASSET.replace(_old, _new)
ORACLES["oos_by_asset"] = ORACLES["oos_table"].replace(PATHS.strip(), BY_ASSET.strip())
ORACLES["ensemble_by_asset"] = ORACLES["inverse_rmse_ensemble"].replace(PATHS.strip(), BY_ASSET.strip())


def _xlogy(x: str, y: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} * ln({y}) ELSE 0 END)"


_pairs = ", ".join(f"count(CASE WHEN before = {a} AND hit = {b} THEN 1 END)::DOUBLE AS n{a}{b}" for a in (0, 1) for b in (0, 1))
_free = " + ".join((_xlogy("n00", "1 - p0"), _xlogy("n01", "p0"), _xlogy("n10", "1 - p1"), _xlogy("n11", "p1")))
ORACLES["var_backtest"] = _with(
    *V,
    "hits AS (SELECT asset, t, CASE WHEN log_return < -1.6448536269514722 * sqrt(garch) THEN 1 ELSE 0 END AS hit FROM oos)",
    "steps AS (SELECT *, lag(hit) OVER (PARTITION BY asset ORDER BY t) AS before FROM hits)",
    f"counts AS (SELECT asset, count(*)::DOUBLE AS n, sum(hit)::DOUBLE AS x, {_pairs} FROM steps GROUP BY asset)",
    "rates AS (SELECT *, x / n AS rate, n01 / nullif(n00 + n01, 0) AS p0, n11 / nullif(n10 + n11, 0) AS p1, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS p FROM counts)",
    then=f"SELECT asset, n::BIGINT AS n, x::BIGINT AS n_exceptions, round(-2 * ({_xlogy('(n - x)', '0.95')} + {_xlogy('x', '0.05')} - {_xlogy('(n - x)', '1 - rate')} - {_xlogy('x', 'rate')}), 5) AS lr_kupiec, "
    f"round(-2 * ({_xlogy('(n00 + n10)', '1 - p')} + {_xlogy('(n01 + n11)', 'p')} - ({_free})), 5) AS lr_christoffersen FROM rates",
)


def _cdf(x: str) -> str:
    k = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) / 2.5066282746310002::DOUBLE * {k} * (0.319381530::DOUBLE + {k} * (-0.356563782::DOUBLE + {k} * (1.781477937::DOUBLE + {k} * (-1.821255978::DOUBLE + {k} * 1.330274429::DOUBLE)))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


ORACLES["option_prices"] = _with(
    *V,
    "spread AS (SELECT asset, date, least(sqrt(garch), 5.0::DOUBLE) AS sigma, 30.0::DOUBLE / 365 AS years FROM oos)",
    "moneyness AS (SELECT *, (0.065::DOUBLE + sigma * sigma / 2) * years / (sigma * sqrt(years)) AS d1, (0.065::DOUBLE + sigma * sigma / 2) * years / (sigma * sqrt(years)) - sigma * sqrt(years) AS d2 FROM spread)",
    then=f"SELECT asset, date, round(sigma, 6) AS sigma, round({_cdf('d1')} - exp(-0.065::DOUBLE * years) * {_cdf('d2')}, 6) AS call_price FROM moneyness",
)

#: The same SQL over the panel that grows, its bounds from the data.
WIDE_BARS = """
wide_bounds AS (SELECT min(ts)::DATE AS first, max(ts)::DATE AS last, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS days FROM events WHERE value > 0),
bars AS (
  SELECT 'user ' || user_id AS asset, date_trunc('hour', ts)::TIMESTAMP AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS ticks
  FROM events WHERE value > 0 GROUP BY ALL
  UNION ALL
  SELECT 'ALL', date_trunc('minute', ts)::TIMESTAMP AS date, arg_min(value, ts), max(value), min(value), arg_max(value, ts), count(*)
  FROM events WHERE value > 0 GROUP BY ALL),
numbered AS"""


def _wide(sql: str) -> str:
    def start(k: int) -> str:
        return f"(SELECT (first + (days * {k} // 8)::INTEGER)::TIMESTAMP FROM wide_bounds)"

    def end(k: int) -> str:
        return f"(SELECT (first + (days * {k} // 8)::INTEGER)::TIMESTAMP - INTERVAL 1 SECOND FROM wide_bounds)"

    bounds = {OOS: start(4), "2024-01-22 23:59:59": end(6), "2024-01-23 00:00:00": start(6), "2024-01-26 23:59:59": end(7), "2024-01-27 00:00:00": start(7), "2024-01-31 23:59:59": end(8)}
    for m in MODELS:  # DuckDB's greatest passes over nulls; a missing error gives no weights
        sql = sql.replace(f"greatest({m}_rmse, 1e-12)", f"(CASE WHEN {m}_rmse IS NOT NULL THEN greatest({m}_rmse, 1e-12) END)")
    sql = sql.replace(BARS.strip().split("numbered AS")[0] + "numbered AS", WIDE_BARS.strip())
    for old, new in bounds.items():
        sql = sql.replace(old if old.startswith("TIMESTAMP") else f"TIMESTAMP '{old}'", new)
    return sql


ORACLES["lookback_grid_all"] = _with(*V, then=" UNION ALL ".join(f"SELECT asset, {k} AS lookback, '{m}' AS model, round(avg(e), 5) AS mean_rmse FROM (SELECT asset, date, {_rmse(m, k)} AS e FROM paths) WHERE date >= {OOS} GROUP BY asset" for k in (30, 60, 90) for m in MODELS))
WIDE = ("log_returns", "oos_table", "inverse_rmse_ensemble", "forecast_metrics", "gating_features", "time_split", "gate_fixed")
ORACLES |= {f"wide_{name}": _wide(ORACLES[name]) for name in WIDE}


def _confidence(models: tuple[str, ...], block: int = 12, resamples: int = 200) -> str:
    """Blocks drawn by the same hashes, and the elimination as one table a round."""
    index = range(len(models))
    squares = ", ".join(f"({m} - realized_var_proxy) * ({m} - realized_var_proxy) AS l_{i}" for i, m in enumerate(models))
    parts = [
        f"loss AS (SELECT asset, t - min(t) OVER (PARTITION BY asset) + 1 AS t, {squares} FROM ens)",
        f"mean AS (SELECT asset, count(*) AS n, {', '.join(f'avg(l_{i}) AS m_{i}' for i in index)} FROM loss GROUP BY asset HAVING count(*) >= {block})",
        f"sums AS (SELECT asset, t, {', '.join(f'sum(l_{i}) OVER w AS s_{i}' for i in index)} FROM loss WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN {block - 1} PRECEDING AND CURRENT ROW))",
        f"draws AS (SELECT asset, n, resample, k, ('0x' || substr(md5(asset || '|' || resample || '|' || k), 1, 12))::BIGINT % (n - {block} + 1) + {block} AS t FROM mean, (SELECT unnest(range(1, {resamples + 1})) AS resample), LATERAL (SELECT unnest(range(1, ceil(n / {block})::BIGINT + 1)) AS k))",
        f"round0 AS (SELECT asset, resample, {', '.join(f'sum(s_{i}) / (count(*) * {block}) AS b_{i}, any_value(m_{i}) AS m_{i}, true AS a_{i}, 1.0::DOUBLE AS p_{i}, NULL::INTEGER AS r_{i}' for i in index)}, 0.0::DOUBLE AS p, any_value(mean.n) AS n FROM draws JOIN sums USING (asset, t) JOIN mean USING (asset) GROUP BY asset, resample)",
    ]
    for k in range(1, len(models)):
        left = " + ".join(f"a_{i}::INTEGER" for i in index)
        over = {x: "(" + " + ".join(f"CASE WHEN a_{i} THEN {x}_{i} ELSE 0 END" for i in index) + f") / ({left})" for x in "mb"}
        worst, star = (f"greatest({', '.join(f'CASE WHEN a_{i} THEN (CASE WHEN v_{i} > 0 THEN {x}_{i} / v_{i} ELSE 0 END) END' for i in index)})" for x in "de")
        keep = ", ".join(f"b_{i}, m_{i}" for i in index)
        goes = "CASE " + " ".join(f"WHEN a_{i} AND (CASE WHEN v_{i} > 0 THEN d_{i} / v_{i} ELSE 0 END) = worst THEN {i}" for i in index) + " END"
        parts += [
            f"c{k} AS (SELECT *, {', '.join(f'm_{i} - {over["m"]} AS d_{i}, b_{i} - {over["b"]} - m_{i} + {over["m"]} AS e_{i}' for i in index)} FROM round{k - 1})",
            f"v{k} AS (SELECT *, {', '.join(f'sqrt(avg(e_{i} * e_{i}) OVER (PARTITION BY asset)) AS v_{i}' for i in index)} FROM c{k})",
            f"t{k} AS (SELECT *, {worst} AS worst, {star} AS star FROM v{k})",
            f"g{k} AS (SELECT *, greatest(p, avg((star >= worst)::INTEGER) OVER (PARTITION BY asset)) AS q, {goes} AS goes FROM t{k})",
            f"round{k} AS (SELECT asset, resample, n, {keep}, {', '.join(f'a_{i} AND goes <> {i} AS a_{i}, CASE WHEN goes = {i} THEN q ELSE p_{i} END AS p_{i}, CASE WHEN goes = {i} THEN {k} ELSE r_{i} END AS r_{i}' for i in index)}, q AS p FROM g{k})",
        ]
    last = len(models) - 1
    return _with(*V, TRAIL, ENSEMBLE, *parts, then=" UNION ALL ".join(f"SELECT asset, n, '{m}' AS model, round(m_{i}, 5) AS mean_loss, round(p_{i}, 5) AS p_value, r_{i} AS round, p_{i} >= 0.10 AS in_set FROM round{last} WHERE resample = 1" for i, m in enumerate(models)))


ORACLES["model_confidence_set"] = _confidence((*MODELS, "static_ensemble_variance"))
ORACLES["stream_ticks_walk_forward"] = ORACLES["stream_walk_forward"]
ORACLES["feature_recompute"] = _with(*V, then="SELECT asset, count(*) AS n_rows, " + ", ".join(f"0.0::DOUBLE AS max_diff_{f}" for f in FEATURE_NAMES) + " FROM oos WHERE t % 31 = 0 AND t > 60 GROUP BY asset")
ORACLES["feature_three_runs"] = _with(*V, then="SELECT asset, column_name, true AS own_row_kept, true AS next_row_moved, true AS future_unseen FROM (SELECT asset FROM oos GROUP BY asset HAVING count(*) > 1), (SELECT unnest([" + ", ".join(f"'{f}'" for f in SCALED) + "]) AS column_name)")
ORACLES["reference_check"] = "SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(date) - count(DISTINCT date) AS n_repeated, count(*) - count(reference) AS n_missing, count(CASE WHEN reference <= 0 THEN 1 END) AS n_not_positive FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS date, avg(value) AS reference FROM events GROUP BY ALL)"
ORACLES["variance_integrity"] = _with(*V, then=" UNION ALL ".join(f"SELECT asset, '{m}' AS model, count(*) AS n_rows, count(CASE WHEN {m} IS NULL OR NOT isfinite({m}) THEN 1 END) AS n_not_finite, count(CASE WHEN {m} <= 0 THEN 1 END) AS n_not_positive, CASE WHEN count(CASE WHEN {m} IS NULL OR NOT isfinite({m}) OR {m} <= 0 THEN 1 END) = 0 THEN 'sound' ELSE 'broken' END AS label FROM paths GROUP BY asset" for m in MODELS))
ORACLES["index_series"] = _with(*P, then="SELECT date, round(close, 6) AS market_index FROM bars WHERE asset = 'view'")
ORACLES["loaded_window"] = _with(*P, then=f"SELECT asset, date, {_r('open high low close')} FROM bars WHERE date BETWEEN {OOS} AND TIMESTAMP '2024-01-31 23:59:59'")
_ends = "ends AS (SELECT asset, min(t) AS low, max(t) - min(t) AS span FROM oos GROUP BY asset), spots AS (SELECT DISTINCT asset, low + (k * span) // 10 AS t FROM ends, range(11) AS r(k))"
ORACLES["window_recheck_spaced"] = _with(*V, TRAIL, _ends, then="SELECT asset, t, " + ", ".join(f"round({m}_rmse, 6) AS {m}_rmse_60" for m in MODELS) + " FROM trail JOIN spots USING (asset, t) WHERE t > 60")
