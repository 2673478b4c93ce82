"""Whole forecast run (I11): slice -> shortlist -> baseline -> forecasts ->
horizon filter -> status -> summary, all as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators import baseline, forecast, periods
from marketlens.operators.forecast import COMPLETED, COMPLETED_WITH_ERRORS, FAILED, POINT_COLS

METRICS_TYPE = T.StructType([
    T.StructField("ma_3", T.DoubleType()), T.StructField("ma_6", T.DoubleType()), T.StructField("ma_12", T.DoubleType()),
    T.StructField("growth_rate_pct", T.DoubleType()),
    T.StructField("trend", T.StructType([
        T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
        T.StructField("direction", T.StringType()), T.StructField("r2", T.DoubleType()),
    ])),
])
ERROR_SCHEMA = "model_name string, target_type string, target_key string, error string"
METRIC_SCHEMA = "model_name string, target_type string, target_key string, mae double, rmse double"


@dataclass
class RunOutcome:
    results: DataFrame   # result rows (baseline + forecasts), horizon-filtered
    errors: DataFrame    # one row per failed (model, target)
    metrics: DataFrame   # holdout metrics per (model, target) (Q1: not on result rows)
    report: DataFrame | None  # baseline report table (I1)
    summary: DataFrame   # one row: status, counts, parameters (D16, D17)
    role_keys: DataFrame
    skill_keys: DataFrame
    shares: DataFrame | None = None  # market shares of the window (with the report)
    summarise: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # the summary of stored results and errors
    top_k: int = forecast.DEFAULT_TOP_K
    seconds: dict[str, float] = field(default_factory=dict)  # building, and with ``staging`` running, each model


def run_forecast(*, monthly_roles: DataFrame, weekly_roles: DataFrame, monthly_skills: DataFrame,
                 weekly_skills: DataFrame, training_window_months: int = 24, horizons=None, models=None,
                 top_k: int = forecast.DEFAULT_TOP_K, data_source: str = "database",
                 sliced: bool = False, staging: str | None = None) -> RunOutcome:
    """I11 over the series of both granularities. ``sliced``: the frames are
    the training window already. With ``staging`` (a shared folder) each model's
    rows are written there as it runs, so that its seconds are its own and later
    reads do not fit it again."""
    model_list, horizon_list, window = forecast.run_parameters(models, horizons, training_window_months)
    max_h = max(horizon_list)
    spark = monthly_roles.sparkSession

    part = (lambda df, n: df) if sliced else periods.last_periods
    mr, wr = part(monthly_roles, window), part(weekly_roles, periods.weekly_window(window))
    ms, ws = part(monthly_skills, window), part(weekly_skills, periods.weekly_window(window))
    role_keys = periods.rank_top_keys(mr, "role_title_en", "posting_count", top_k)
    skill_keys = periods.rank_top_keys(ms, "display_name_en", "posting_count", top_k)

    rows: list[DataFrame] = []
    errors: list[DataFrame] = [spark.createDataFrame([], ERROR_SCHEMA)]
    metrics: list[DataFrame] = [spark.createDataFrame([], METRIC_SCHEMA)]
    report, shares, seconds = None, None, {}

    def kept(df: DataFrame, name: str) -> DataFrame:
        if staging is None:
            return df
        path = f"{staging.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    if "baseline" in model_list:
        report = baseline.baseline_report(monthly_roles=mr, weekly_roles=wr, monthly_skills=ms, weekly_skills=ws,
                                          role_keys=role_keys, skill_keys=skill_keys)
        started = time.perf_counter()
        b = baseline.baseline_rows(report)
        rows.append(kept(b.withColumn("metrics", F.col("metrics").cast(METRICS_TYPE)), "baseline-points"))
        shares = baseline.share_tables(mr, ms)
        seconds["baseline"] = round(time.perf_counter() - started, 3)

    fmodels = [m for m in model_list if m in forecast.MODEL_KEYS or m in forecast.USER_MODELS]
    if fmodels:
        series = forecast.forecast_targets(mr, ms, role_keys, skill_keys).persist()
        for m in fmodels:
            started = time.perf_counter()
            out = forecast.forecaster(m)(series, max_h)
            rows.append(kept(out.points, f"{m}-points").select(*POINT_COLS, F.lit(None).cast(METRICS_TYPE).alias("metrics")))
            errors.append(kept(out.errors, f"{m}-errors").select("model_name", "target_type", "target_key", "error"))
            metrics.append(kept(out.metrics, f"{m}-metrics"))
            seconds[m] = round(time.perf_counter() - started, 3)

    if rows:
        results = reduce(lambda a, c: a.unionByName(c), rows)                         # G1
    else:
        results = spark.createDataFrame([], T.StructType([
            T.StructField("model_name", T.StringType()), T.StructField("target_type", T.StringType()),
            T.StructField("target_key", T.StringType()), T.StructField("horizon_months", T.IntegerType()),
            T.StructField("period_start", T.DateType()), T.StructField("predicted_value", T.DoubleType()),
            T.StructField("metrics", METRICS_TYPE)]))
    results = forecast.filter_by_horizons(results, horizon_list)                       # G5
    all_errors = reduce(lambda a, c: a.unionByName(c), errors)                         # G2
    all_metrics = reduce(lambda a, c: a.unionByName(c), metrics)
    summarise = partial(run_summary, model_list=model_list, horizons=horizon_list, window=window, data_source=data_source)
    return RunOutcome(results, all_errors, all_metrics, report, summarise(results, all_errors), role_keys, skill_keys,
                      shares, summarise, top_k, seconds)


def run_status(n_results, n_errors) -> F.Column:
    """No errors -> completed; errors and rows -> completed_with_errors;
    errors and no rows -> failed."""
    return (
        F.when(n_errors == 0, F.lit(COMPLETED))
        .when(n_results > 0, F.lit(COMPLETED_WITH_ERRORS))
        .otherwise(F.lit(FAILED))
    )


def run_summary(results: DataFrame, errors: DataFrame, *, model_list, horizons, window, data_source) -> DataFrame:
    """One row with counts, status and parameters; rows per model as a
    map. Both inputs are reduced to one row before they are combined."""
    per_model = results.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
    r = per_model.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_results"),
        F.map_from_entries(F.collect_list(F.struct("model_name", "n"))).alias("rows_per_model"),
    ).withColumn("_k", F.lit(1))
    e = errors.agg(F.count(F.lit(1)).alias("error_count")).withColumn("_k", F.lit(1))
    return r.join(e, "_k").select(
        run_status(F.col("n_results"), F.col("error_count")).alias("status"),
        "n_results", "error_count", "rows_per_model",
        F.lit(data_source).alias("data_source"), F.lit(int(window)).alias("training_window_months"),
        F.array(*[F.lit(int(h)) for h in horizons]).alias("horizons"),
        F.array(*[F.lit(m) for m in model_list]).alias("models"),
    )
