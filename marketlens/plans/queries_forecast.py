"""Bound queries, batch 3: forecasting over the shortlisted monthly series."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from marketlens.functions.numeric import round_half_even
from marketlens.operators import forecast, periods, run, store, trees
from marketlens.plans import bindings as b
from marketlens.plans import modelsql
from marketlens.plans import sqlparts as S
from marketlens.plans.queries import frame
from marketlens.plans.queries_series import TOP_K, WINDOW, WINDOW_CTES, _share_sql, windowed
from marketlens.plans.registry import ORACLE, query
from marketlens.session import checkpoint_dir

HORIZON = 12


def targets(spark, d):
    w = windowed(spark, d)
    return forecast.forecast_targets(w["monthly_roles"], w["monthly_skills"], w["role_keys"], w["skill_keys"])


def _dense(src, key, keys, value_expr, agg):
    return f"""SELECT key, month, value, row_number() OVER (PARTITION BY key ORDER BY month) - 1 AS t FROM (
  SELECT c.key, c.month, m.value FROM
   (SELECT key, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM
     (SELECT {key} AS key, CAST(date_trunc('month', period_start) AS DATE) AS month FROM {src} WHERE {key} IN (SELECT * FROM {keys}))
    GROUP BY key) c
  LEFT JOIN (SELECT {key} AS key, CAST(date_trunc('month', period_start) AS DATE) AS month, {agg}({value_expr}) AS value
             FROM {src} WHERE {key} IN (SELECT * FROM {keys}) GROUP BY 1, 2) m
  ON m.key = c.key AND m.month = c.month)"""


def target_ctes(roles: str = "rk", skills: str = "sk") -> tuple[str, ...]:
    """Dense series of the listed keys (SQL of forecast_targets)."""
    return (*WINDOW_CTES, f"""
rd AS ({_dense('mr', 'role_title_en', roles, 'CAST(posting_count AS DOUBLE)', 'sum')}),
sd0 AS ({_dense('mr', 'role_title_en', roles, S.finite('avg_salary'), 'avg')}),
sd AS (
  SELECT key, month, t,
    CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE coalesce(v1, v0) END AS value
  FROM (SELECT *,
    last(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
    last(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
    first(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
    first(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
    FROM sd0)),
kd AS ({_dense('ms', 'display_name_en', skills, 'CAST(posting_count AS DOUBLE)', 'sum')}),
targets AS (
  SELECT 'role' AS target_type, key AS target_key, month, coalesce(value, 0.0) AS value, t FROM rd
  UNION ALL SELECT 'salary_role', key, month, value, t FROM sd
  UNION ALL SELECT 'skill', key, month, coalesce(value, 0.0), t FROM kd),
ser AS (SELECT *, count(*) OVER (PARTITION BY target_type, target_key) AS n,
               count(value) OVER (PARTITION BY target_type, target_key) AS known FROM targets)""")


TARGET_CTES = target_ctes()
#: All keys of the window instead of the shortlists.
ALL_KEYS = ('allr AS (SELECT DISTINCT role_title_en FROM mr)', 'alls AS (SELECT DISTINCT display_name_en FROM ms)')


def _model_sql(model: str, what=modelsql.points, how=None) -> str:
    return modelsql.recursive(*TARGET_CTES, *modelsql.model_ctes(model, HORIZON, how)) + what(model)


@query("forecast_targets", S.with_(*TARGET_CTES) + f"SELECT target_type, target_key, month, {S.rnd('value', 6)} AS value, t, n FROM ser")
def q_targets(spark, d):
    return targets(spark, d).select("target_type", "target_key", "month", round_half_even("value", 6).alias("value"), "t", "n")


#: Boosting with leaves of three rows: at the default of 20 a window of up to 36
#: months has no room for a cut, and the forecast is the mean of the targets.
SMALL_LEAVES = replace(trees.HGB, trees=20, least=3)

for _m in forecast.MODEL_KEYS:
    def _points(spark, d, _m=_m):
        return forecast.forecaster(_m)(targets(spark, d), HORIZON).points

    def _metrics(spark, d, _m=_m):
        return forecast.forecaster(_m)(targets(spark, d), HORIZON).metrics

    query(f"forecast_{_m}", _model_sql(_m))(_points)
    query(f"forecast_{_m}_metrics", _model_sql(_m, modelsql.metrics))(_metrics)


@query("forecast_hgb_small_leaves", _model_sql("hgb", how=SMALL_LEAVES))
def q_small_leaves(spark, d):
    return forecast._trees(targets(spark, d), HORIZON, "hgb", SMALL_LEAVES).points


SHORT_WINDOW = 12


def _short_targets(spark, d):
    """Role series and the demand of every company in a 12-month window: most
    companies have only a few months."""
    f = frame(spark, d)
    starts = periods.window_starts(f, {"M": SHORT_WINDOW})["M"]
    recent = f if starts is None else f.where(F.col("date_added") >= F.lit(starts))
    own = b.postings(spark, d).select("company_id", F.trunc("date_added", "MM").alias("period_start"))
    own = own if starts is None else own.where(F.col("period_start") >= F.lit(starts))
    skills = own.groupBy("period_start", F.concat(F.lit("company "), "company_id").alias("display_name_en")).agg(F.count(F.lit(1)).alias("posting_count"))
    return forecast.forecast_targets(periods.role_series(recent, "M"), skills)


_SHORT_SQL = S.with_(*S.BASE, S.role_series("M", "mr_all"), S.last_periods("mr_all", SHORT_WINDOW, "mr"),
    """ms AS (SELECT CAST(date_trunc('month', date_added) AS DATE) AS period_start, 'company ' || company_id AS display_name_en, count(*) AS posting_count
  FROM postings WHERE date_trunc('month', date_added) >= (SELECT min(period_start) FROM mr) GROUP BY 1, 2)""",
    *ALL_KEYS, target_ctes("allr", "alls")[-1])


@query("forecast_history_gate", _SHORT_SQL + """
SELECT m.model_name, target_type, target_key,
  CASE WHEN n < m.min_n THEN m.msg ELSE 'no salary history' END AS error
FROM (SELECT DISTINCT target_type, target_key, n, known FROM ser) s,
     (VALUES ('prophet', 6, 'Need at least 6 months of history for Prophet.'),
             ('arima', 8, 'Need at least 8 months of history for ARIMA/SARIMA.'),
             ('rf', 10, 'Need at least 10 months of history for rf.')) m(model_name, min_n, msg)
WHERE n < m.min_n OR known < n""")
def q_gate(spark, d):
    s = _short_targets(spark, d)
    return reduce(lambda x, y: x.unionByName(y), [forecast._gate(s, m)[1] for m in ("prophet", "arima", "rf")])


# ------------------------------------------------------------------ I11
RUN_HORIZONS = [3, 6, 12]
CLASSICAL = ["baseline", "arima", "sarima"]
RUN_MODELS = ["baseline", "arima", "sarima", "prophet", "rf", "hgb"]
_METRIC_COLS = ["metric_ma_3", "metric_ma_6", "metric_ma_12", "metric_growth_rate_pct", "metric_slope",
                "metric_intercept", "metric_direction", "metric_r2"]
_HEAD = "model_name, target_type, target_key, horizon_months, period_start, predicted_value"


def _run_sql(models) -> str:
    nulls = ", ".join(f"CAST(NULL AS {'VARCHAR' if c == 'metric_direction' else 'DOUBLE'}) AS {c}" for c in _METRIC_COLS)
    hz = ", ".join(str(h) for h in RUN_HORIZONS)
    return "\nUNION ALL ".join([f"SELECT {_HEAD}, {', '.join(_METRIC_COLS)} FROM ({ORACLE['baseline_rows']})"] + [
        f"SELECT {_HEAD}, {nulls} FROM ({ORACLE['forecast_' + m]}) WHERE horizon_months IN ({hz})" for m in models if m != "baseline"])


def _errors_sql(models) -> str:
    least = ", ".join(f"('{m}', {forecast.MIN_HISTORY[m]})" for m in models if m != "baseline")
    return f"SELECT m, target_type, target_key FROM ({S.with_(*TARGET_CTES)} SELECT DISTINCT target_type, target_key, n, known FROM ser), (VALUES {least}) v(m, least) WHERE n < least OR known < n"


def _run(spark, d, models, staging=None):
    w = windowed(spark, d)
    return run.run_forecast(**{k: w[k] for k in ("monthly_roles", "weekly_roles", "monthly_skills", "weekly_skills")}, sliced=True,
                            training_window_months=WINDOW, horizons=RUN_HORIZONS, models=models, top_k=TOP_K, staging=staging)


def _staging(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _flat(results):
    m = F.col("metrics")
    ma = lambda c: round_half_even(m[c], 6)  # noqa: E731 - same presentation rounding as the baseline report query
    return results.select("model_name", "target_type", "target_key", "horizon_months", "period_start", "predicted_value",
                          ma("ma_3").alias("metric_ma_3"), ma("ma_6").alias("metric_ma_6"), ma("ma_12").alias("metric_ma_12"),
                          m["growth_rate_pct"].alias("metric_growth_rate_pct"), m["trend"]["slope"].alias("metric_slope"),
                          m["trend"]["intercept"].alias("metric_intercept"), m["trend"]["direction"].alias("metric_direction"),
                          m["trend"]["r2"].alias("metric_r2"))


_STATUS = "CASE WHEN e.n = 0 THEN 'completed' WHEN r.n > 0 THEN 'completed_with_errors' ELSE 'failed' END AS status"


def _summary_sql(models) -> str:
    return f"""
SELECT {_STATUS}, r.n AS n_results, e.n AS error_count FROM (SELECT count(*) AS n FROM ({_run_sql(models)})) r, (SELECT count(*) AS n FROM ({_errors_sql(models)})) e"""


@query("forecast_run_results", _run_sql(RUN_MODELS))
def q_run_results(spark, d):
    return _flat(_run(spark, d, RUN_MODELS, _staging(spark, "run")).results)


@query("forecast_run_summary", _summary_sql(RUN_MODELS))
def q_run_summary(spark, d):
    return _run(spark, d, RUN_MODELS, _staging(spark, "run")).summary.select("status", "n_results", "error_count")


@query("forecast_run_classical", _run_sql(CLASSICAL))
def q_run_classical(spark, d):
    return _flat(_run(spark, d, CLASSICAL).results)


@query("forecast_run_classical_summary", _summary_sql(CLASSICAL))
def q_run_classical_summary(spark, d):
    return _run(spark, d, CLASSICAL).summary.select("status", "n_results", "error_count")


def _short_run(spark, d):
    """A run over all series of the last 12 months by part: many are too short
    for a model, so it completes with errors."""
    s = _short_targets(spark, d)
    out = forecast.forecaster("arima")(s, 3)
    return run.run_summary(out.points, out.errors, model_list=["arima"], horizons=[3], window=SHORT_WINDOW, data_source="database")


@query("forecast_run_with_errors", _SHORT_SQL + """
SELECT 'completed_with_errors' AS status, CAST(3 * count(*) FILTER (n >= 8 AND known = n) AS BIGINT) AS n_results, count(*) FILTER (n < 8 OR known < n) AS error_count
FROM (SELECT DISTINCT target_type, target_key, n, known FROM ser)""")
def q_run_with_errors(spark, d):
    return _short_run(spark, d).select("status", "n_results", "error_count")


@query("run_saved_report", f"""
WITH rows AS ({_run_sql(CLASSICAL)}), head AS (SELECT count(*) AS n FROM rows), e AS (SELECT count(*) AS n FROM ({_errors_sql(CLASSICAL)}))
SELECT 2 AS n_runs, CAST(7 AS BIGINT) AS run_id, (SELECT CASE WHEN e.n = 0 THEN 'completed' ELSE 'completed_with_errors' END FROM e) AS status, '{WINDOW}' AS "window", '{', '.join(map(str, RUN_HORIZONS))}' AS horizons,
  '{', '.join(CLASSICAL)}' AS models, CAST((SELECT n FROM head) AS VARCHAR) AS n_results, CAST((SELECT n FROM e) AS VARCHAR) AS error_count,
  model_name, row_number() OVER (PARTITION BY model_name ORDER BY predicted_value DESC NULLS LAST, horizon_months, target_type, target_key) AS row_in_model,
  target_type AS type, target_key AS target FROM rows""")
def q_run_saved_report(spark, d):
    """A run saved twice under one id, and once under another: the report of
    the first from the stored tables, with its header facts."""
    out = _run(spark, d, CLASSICAL, _staging(spark, "run"))
    base = _staging(spark, "store")
    for run_id in (7, 8, 7):
        paths = store.save_outcome(out, base, run_id=run_id, created_at=datetime(2024, 1, run_id))
    runs, results = (spark.read.option("mergeSchema", "true").parquet(paths[n]) for n in ("runs", "results"))
    head = store.report_header(store.get_run(runs, 7)).drop("source", "data_source", "timed_models")
    n = runs.agg(F.count(F.lit(1)).cast("int").alias("n_runs"))
    report = store.report_table(results.where("run_id = 7"), "database").select("model_name", "row_in_model", "type", "target")
    return report.join(F.broadcast(head)).join(F.broadcast(n))


@query("run_shares", f"""
SELECT 'role' AS kind, role_title_en AS key, posting_count, share_pct FROM ({S.with_(*WINDOW_CTES)} {_share_sql("mr", "role_title_en")})
UNION ALL SELECT 'skill', display_name_en, posting_count, share_pct FROM ({S.with_(*WINDOW_CTES)} {_share_sql("ms", "display_name_en")})""")
def q_run_shares(spark, d):
    return _run(spark, d, ["baseline"]).shares
