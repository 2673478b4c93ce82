import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketlens.operators import baseline, forecast, run, series


def _long(spark, values, key="A", start=dt.date(2023, 1, 1)):
    rows = [(key, (pd.Timestamp(start) + pd.DateOffset(months=i)).date(), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, period_start date, v double")


def test_moving_average_and_growth(spark):
    r = series.series_stats(_long(spark, [10, 12, 14, 16, 18]), "k", "v").collect()[0]
    assert r.ma_3 == 16.0 and r.ma_6 is None and r.growth_rate_pct == 12.5 and r.latest == 18.0 and r.n_periods == 5


def test_trend_up_and_polyfit(spark):
    r = series.series_stats(_long(spark, [1, 2, 3, 4, 5]), "k", "v").collect()[0]
    assert r.direction == "up" and r.slope == 1.0 and r.r2 == 1.0
    ys = [3.0, 7.5, 2.0, 9.0, 11.0, 4.0]
    r = series.series_stats(_long(spark, ys), "k", "v").collect()[0]
    slope, icpt = np.polyfit(np.arange(6.0), ys, 1)
    assert r.slope == round(slope, 4) and r.intercept == round(icpt, 4)
    flat = series.series_stats(_long(spark, [5, 5, 5]), "k", "v").collect()[0]
    assert flat.direction == "flat" and flat.r2 == 1.0
    one = series.series_stats(_long(spark, [5]), "k", "v").collect()[0]
    assert one.direction == "unknown" and one.slope is None and one.growth_rate_pct is None


def test_nan_skipped_in_trend_and_growth_guards(spark):
    r = series.series_stats(_long(spark, [1, float("nan"), 3, 0, 0]), "k", "v").collect()[0]
    assert r.growth_rate_pct is None  # previous value 0
    assert r.slope is not None and r.n_periods == 5


def test_market_share(spark):
    df = spark.createDataFrame([("A", 10), ("A", 12), ("B", 5)], "role_title_en string, posting_count long")
    rows = series.market_share(df, "role_title_en").collect()
    assert [r.role_title_en for r in rows] == ["A", "B"]
    assert rows[0].share_pct == round(22 / 27 * 100, 2)
    zero = spark.createDataFrame([("A", 0)], "role_title_en string, posting_count long")
    assert series.market_share(zero, "role_title_en").collect()[0].share_pct == 0.0


def test_interpolation_matches_pandas(spark):
    vals = [None, 10.0, None, None, 16.0, None, 20.0, None]
    months = [dt.date(2024, m, 1) for m in range(1, 9)]
    df = spark.createDataFrame([("r", m, v) for m, v in zip(months, vals)], "k string, month date, value double")
    dense = series.dense_months(df, "k", fill=None)
    got = [r.value for r in series.interpolate_fill(dense, "k").orderBy("t").collect()]
    want = pd.Series(vals, dtype=float).interpolate().bfill().ffill().tolist()
    assert got == want


def test_dense_months_fill_zero(spark):
    df = spark.createDataFrame([("r", dt.date(2024, 1, 1), 3.0), ("r", dt.date(2024, 4, 1), 5.0)], "k string, month date, value double")
    got = [(r.month.month, r.value, r.t) for r in series.dense_months(df, "k").orderBy("t").collect()]
    assert got == [(1, 3.0, 0), (2, 0.0, 1), (3, 0.0, 2), (4, 5.0, 3)]


def _model_series(spark, n=36, key="data engineer"):
    i = np.arange(n)
    y = 20 + 5 * np.sin(i / 6) + np.linspace(0, 3, n)
    start = pd.Timestamp("2023-01-01")
    rows = [((start + pd.DateOffset(months=int(k))).date(), key, float(v), 200.0, 0.0, 0.0) for k, v in zip(i, y)]
    mr = spark.createDataFrame(rows, "period_start date, role_title_en string, posting_count double, avg_salary double, a double, b double")
    mr = mr.withColumn("avg_salary", F.col("posting_count") * 1000)
    ms = spark.createDataFrame([(r[0], "python", r[2]) for r in rows], "period_start date, display_name_en string, posting_count double")
    return mr, ms


def test_every_model_gives_h_points(spark):
    mr, ms = _model_series(spark)
    s = forecast.forecast_targets(mr, ms)
    for model in ("arima", "sarima", "prophet", "rf"):
        out = forecast.forecaster(model)(s, 6)
        pts = out.points.collect()
        assert len(pts) == 3 * 6, model
        assert all(p.predicted_value >= 0 for p in pts), model
        for tt in ("role", "salary_role", "skill"):
            months = sorted(p.period_start for p in pts if p.target_type == tt)
            assert months == [dt.date(2026, m, 1) for m in range(1, 7)], (model, tt)
        assert all(float(p.predicted_value).is_integer() for p in pts if p.target_type == "salary_role")
        assert out.errors.count() == 0
        assert out.metrics.count() == 3


def test_arima_recovers_random_walk_drift(spark):
    mr, ms = _model_series(spark)
    pts = {(p.target_type, p.horizon_months): p.predicted_value
           for p in forecast.forecaster("arima")(forecast.forecast_targets(mr, ms), 3).points.collect()}
    assert abs(pts[("role", 1)] - 23.0) < 3.0


def test_short_history_is_an_error_row(spark):
    mr, ms = _model_series(spark, n=7)
    out = forecast.forecaster("arima")(forecast.forecast_targets(mr, ms), 3)
    assert out.points.count() == 0
    errs = out.errors.collect()
    assert len(errs) == 3 and all("at least 8 months" in e.error for e in errs)
    p = forecast.forecaster("prophet")(forecast.forecast_targets(mr, ms), 3)
    assert p.points.count() == 9 and p.errors.count() == 0


def test_salary_without_history(spark):
    mr, ms = _model_series(spark, n=12)
    mr = mr.withColumn("avg_salary", F.lit(None).cast("double"))
    out = forecast.forecaster("arima")(forecast.forecast_targets(mr, ms), 3)
    errs = out.errors.collect()
    assert [(e.target_type, e.error) for e in errs] == [("salary_role", "no salary history")]


def test_horizon_filter_and_params(spark):
    rows = spark.createDataFrame([("baseline", 0), ("rf", 3), ("rf", 6), ("rf", 12)], "model_name string, horizon_months int")
    got = [r.horizon_months for r in forecast.filter_by_horizons(rows, [3, 12]).collect()]
    assert got == [0, 3, 12]
    assert forecast.run_parameters(horizons=[12, 3, 3, 5])[1] == [3, 12]
    assert forecast.run_parameters()[0] == ["baseline", "prophet", "arima"]
    assert forecast.run_parameters(["ARIMA", "arima", "x", "rf"])[0] == ["arima", "rf"]
    try:
        forecast.run_parameters(window=18)
        raise AssertionError
    except ValueError:
        pass


def test_baseline_rows_and_run(spark):
    mr, ms = _model_series(spark, n=24)
    wr = mr
    out = run.run_forecast(monthly_roles=mr, weekly_roles=wr, monthly_skills=ms, weekly_skills=ms,
                           training_window_months=12, horizons=[3], models=["baseline", "arima"], top_k=3)
    res = out.results.collect()
    assert {r.model_name for r in res} == {"baseline", "arima"}
    assert all(r.horizon_months in (0, 3) for r in res)
    base = [r for r in res if r.model_name == "baseline"]
    assert {r.target_type for r in base} == {"baseline_role", "baseline_skill"}
    skill = [r for r in base if r.target_type == "baseline_skill"][0]
    assert skill.metrics.ma_6 is None and skill.metrics.trend.direction in ("up", "down", "flat")
    s = out.summary.collect()[0]
    assert s.status == "completed" and s.n_results == len(res) and s.error_count == 0


def test_non_finite_forecast_is_an_error_row(spark):
    from marketlens.operators.forecast import _outputs

    est = spark.createDataFrame(
        [("role", "a", dt.date(2024, 1, 1), False, [], [1.0, 2.0], None), ("role", "b", dt.date(2024, 1, 1), False, [], [1.0, float("nan")], None)],
        "target_type string, target_key string, last_month date, has_ho boolean, tail array<double>, path_f array<double>, path_h array<double>")
    pts, _, errs = _outputs("arima", est, 2)
    assert {r.target_key for r in pts.collect()} == {"a"}
    assert [(r.target_key, r.error) for r in errs.collect()] == [("b", "forecast is not finite")]
