"""Bound queries, batch 2: series operators and the baseline report."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions.dates import period_start
from marketlens.functions.numeric import round_half_even
from marketlens.operators import baseline, periods, series
from marketlens.plans import bindings as b
from marketlens.plans import sqlparts as S
from marketlens.plans.queries import frame
from marketlens.plans.registry import query
from marketlens.session import read_table

WINDOW = 24
TOP_K = 15
MA_DIGITS = 6


FREQS = ("M", "W-MON")


def _pick(df, g):
    return df.where(F.col("granularity") == g).drop("granularity")


def _rollups(spark, d, f):
    """Monthly and weekly role and skill series, each pair from one pass (D8
    roll-up: one scan of the postings, one link join)."""
    return periods.role_rollup(f, FREQS), periods.skill_rollup(b.link_rows(spark, d), f, b.skills(spark, d), FREQS, distinct=True, parts=b.link_parts(spark, d))


def windowed(spark, d, window=WINDOW, with_skills=True):
    """The four sliced series frames of a run (E1, E2) and both shortlists
    (D10). The history is cut from the posting dates before the link join, at
    the first day that any window needs; the slices are then plain filters.
    Should periods without links lie inside a window, so that the skill series
    have fewer periods than asked for, those are sliced from the whole history
    (found out only ``with_skills``)."""
    f = frame(spark, d)
    windows = {"M": window, "W-MON": periods.weekly_window(window)}
    starts = periods.window_starts(f, windows)
    cut = None if None in starts.values() else min(starts.values())
    recent = f if cut is None else f.where(F.col("date_added") >= F.lit(cut))
    roles, skills = (x.persist() for x in _rollups(spark, d, recent))

    def part(df, g):
        rows = _pick(df, g)
        return rows if starts[g] is None else rows.where(F.col("period_start") >= F.lit(starts[g]))

    sliced = {g: part(skills, g) for g in FREQS}
    if cut is not None and with_skills:
        found = {r.granularity: r.p for r in skills.groupBy("granularity").agg(F.collect_set("period_start").alias("p")).collect()}
        if any(sum(p >= starts[g] for p in found.get(g, [])) < n for g, n in windows.items()):
            skills = _rollups(spark, d, f)[1].persist()
            sliced = {g: periods.last_periods(_pick(skills, g), windows[g]) for g in FREQS}
    mr, wr, ms, ws = part(roles, "M"), part(roles, "W-MON"), sliced["M"], sliced["W-MON"]
    return dict(monthly_roles=mr, weekly_roles=wr, monthly_skills=ms, weekly_skills=ws,
                role_keys=periods.rank_top_keys(mr, "role_title_en", "posting_count", TOP_K).persist(),
                skill_keys=periods.rank_top_keys(ms, "display_name_en", "posting_count", TOP_K).persist())


def _round_ma(df):
    return df.select(*[round_half_even(c, MA_DIGITS).alias(c) if c.startswith("ma_") else c for c in df.columns])


WINDOW_CTES = (
    *S.BASE,
    S.role_series("M", "mr_all"), S.role_series("W-MON", "wr_all"),
    S.skill_series("M", "ms_all"), S.skill_series("W-MON", "ws_all"),
    S.last_periods("mr_all", WINDOW, "mr"), S.last_periods("wr_all", min(WINDOW * 5, 200), "wr"),
    S.last_periods("ms_all", WINDOW, "ms"), S.last_periods("ws_all", min(WINDOW * 5, 200), "ws"),
    S.top_keys("mr", "role_title_en", TOP_K, "rk"), S.top_keys("ms", "display_name_en", TOP_K, "sk"),
    """long AS (
  SELECT 'roles_monthly' AS series_set, role_title_en AS key, period_start, CAST(posting_count AS DOUBLE) AS value FROM mr WHERE role_title_en IN (SELECT * FROM rk)
  UNION ALL SELECT 'roles_weekly', role_title_en, period_start, posting_count FROM wr WHERE role_title_en IN (SELECT * FROM rk)
  UNION ALL SELECT 'skills_monthly', display_name_en, period_start, posting_count FROM ms WHERE display_name_en IN (SELECT * FROM sk)
  UNION ALL SELECT 'skills_weekly', display_name_en, period_start, posting_count FROM ws WHERE display_name_en IN (SELECT * FROM sk)
  UNION ALL SELECT 'salary_monthly', role_title_en, period_start, avg_salary FROM mr WHERE role_title_en IN (SELECT * FROM rk))""",
)


@query("baseline_report", S.with_(*WINDOW_CTES) + S.series_stats("long", ["series_set", "key"], ma_digits=MA_DIGITS))
def q_baseline_report(spark, d):
    w = windowed(spark, d)
    return _round_ma(baseline.baseline_report(**w))


@query("role_shortlist", S.with_(*WINDOW_CTES) + """
SELECT role_title_en, CAST(sum(posting_count) AS BIGINT) AS posting_count FROM mr
GROUP BY 1 ORDER BY 2 DESC, 1 ASC LIMIT 15""")
def q_role_shortlist(spark, d):
    return windowed(spark, d, with_skills=False)["role_keys"]


@query("skill_shortlist", S.with_(*WINDOW_CTES) + """
SELECT display_name_en, CAST(sum(posting_count) AS BIGINT) AS posting_count FROM ms
GROUP BY 1 ORDER BY 2 DESC, 1 ASC LIMIT 15""")
def q_skill_shortlist(spark, d):
    return windowed(spark, d)["skill_keys"]


def _share_sql(src, key):
    return f"""SELECT {key}, posting_count,
  {S.rnd(f"posting_count / (CASE WHEN sum(posting_count) OVER () = 0 THEN 1.0 ELSE CAST(sum(posting_count) OVER () AS DOUBLE) END) * 100.0", 2)} AS share_pct
FROM (SELECT {key}, CAST(sum(posting_count) AS BIGINT) AS posting_count FROM {src} GROUP BY 1)
ORDER BY posting_count DESC, {key} ASC LIMIT 20"""


@query("role_market_share", S.with_(*WINDOW_CTES) + _share_sql("mr", "role_title_en"))
def q_role_share(spark, d):
    return series.market_share(windowed(spark, d, with_skills=False)["monthly_roles"], "role_title_en", head=20)


@query("skill_market_share", S.with_(*WINDOW_CTES) + _share_sql("ms", "display_name_en"))
def q_skill_share(spark, d):
    return series.market_share(windowed(spark, d)["monthly_skills"], "display_name_en", head=20)


@query("baseline_rows", S.with_(*WINDOW_CTES) + f"""
, rep AS ({S.series_stats("long", ["series_set", "key"], ma_digits=MA_DIGITS)})
SELECT 'baseline' AS model_name,
       CASE WHEN series_set = 'roles_monthly' THEN 'baseline_role' ELSE 'baseline_skill' END AS target_type,
       key AS target_key, 0 AS horizon_months, CAST(NULL AS DATE) AS period_start, latest AS predicted_value,
       ma_3 AS metric_ma_3,
       CASE WHEN series_set = 'roles_monthly' THEN ma_6 END AS metric_ma_6,
       CASE WHEN series_set = 'roles_monthly' THEN ma_12 END AS metric_ma_12,
       growth_rate_pct AS metric_growth_rate_pct, slope AS metric_slope, intercept AS metric_intercept,
       direction AS metric_direction, r2 AS metric_r2
FROM rep WHERE series_set IN ('roles_monthly', 'skills_monthly')""")
def q_baseline_rows(spark, d):
    rows = baseline.baseline_rows(_round_ma(baseline.baseline_report(**windowed(spark, d))))
    m = F.col("metrics")
    return rows.select(
        "model_name", "target_type", "target_key", "horizon_months", "period_start", "predicted_value",
        m["ma_3"].alias("metric_ma_3"), m["ma_6"].alias("metric_ma_6"), m["ma_12"].alias("metric_ma_12"),
        m["growth_rate_pct"].alias("metric_growth_rate_pct"), m["trend"]["slope"].alias("metric_slope"),
        m["trend"]["intercept"].alias("metric_intercept"), m["trend"]["direction"].alias("metric_direction"),
        m["trend"]["r2"].alias("metric_r2"),
    )


# Dense monthly demand (E7, D12, C10) and salary (E8, D13) for every role.
_DENSE_SQL = S.with_(*S.BASE, S.role_series("M", "mr")) + """
, m AS (SELECT role_title_en AS key, CAST(date_trunc('month', period_start) AS DATE) AS month,
               sum(CAST(posting_count AS DOUBLE)) AS value, avg({fin}) AS salary FROM mr GROUP BY 1, 2)
, cal AS (SELECT key, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY key)
, dense AS (SELECT c.key, c.month, m.value, m.salary,
                   row_number() OVER (PARTITION BY c.key ORDER BY c.month) - 1 AS t
            FROM cal c LEFT JOIN m ON m.key = c.key AND m.month = c.month)
""".replace("{fin}", S.finite("avg_salary"))


@query("dense_role_demand", _DENSE_SQL + "SELECT key AS role_title_en, month, coalesce(value, 0.0) AS value, t FROM dense")
def q_dense_demand(spark, d):
    mr = periods.role_series(frame(spark, d), "M")
    return series.dense_months(series.month_sums(mr, "role_title_en", "posting_count"), "role_title_en")


@query("dense_role_salary", _DENSE_SQL + f"""
, filled AS (
  SELECT key, month, t, salary,
         last(salary IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
         last(CASE WHEN salary IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
         first(salary IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
         first(CASE WHEN salary IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
  FROM dense)
SELECT key AS role_title_en, month,
       {S.rnd("CASE WHEN salary IS NOT NULL THEN salary WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE coalesce(v1, v0) END", 6)} AS value, t
FROM filled""")
def q_dense_salary(spark, d):
    mr = periods.role_series(frame(spark, d), "M")
    dense = series.dense_months(series.month_means(mr, "role_title_en", "avg_salary"), "role_title_en", fill=None)
    out = series.interpolate_fill(dense, "role_title_en")
    return out.select("role_title_en", "month", round_half_even("value", 6).alias("value"), "t")


# Fine-grained series: daily event counts and mean values per event type.
def _event_daily(spark, d):
    ev = read_table(spark, d, "events")
    return ev.groupBy(period_start("ts", "D").alias("period_start"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), round_half_even(F.avg("value"), 6).alias("mean_value")
    )


_EV_SQL = f"""WITH ev AS (SELECT CAST(ts AS DATE) AS period_start, event_type, count(*) AS n_events, {S.rnd("avg(value)", 6)} AS mean_value
FROM events GROUP BY 1, 2)
"""


@query("event_count_trend", _EV_SQL + S.series_stats("ev", ["event_type"], "n_events", ma_digits=MA_DIGITS))
def q_event_count_trend(spark, d):
    return _round_ma(series.series_stats(_event_daily(spark, d), "event_type", "n_events"))


@query("event_value_trend", _EV_SQL + S.series_stats("ev", ["event_type"], "mean_value", ma_digits=MA_DIGITS))
def q_event_value_trend(spark, d):
    return _round_ma(series.series_stats(_event_daily(spark, d), "event_type", "mean_value"))


@query("event_lag_matrix", _EV_SQL + """
, dense AS (SELECT event_type, period_start AS month, CAST(n_events AS DOUBLE) AS value,
                   row_number() OVER (PARTITION BY event_type ORDER BY period_start) - 1 AS t FROM ev)
SELECT event_type, month, t, value,
       [lag(value, 6) OVER w, lag(value, 5) OVER w, lag(value, 4) OVER w, lag(value, 3) OVER w, lag(value, 2) OVER w, lag(value, 1) OVER w] AS lags
FROM dense WINDOW w AS (PARTITION BY event_type ORDER BY t)
QUALIFY t >= 6""")
def q_event_lag_matrix(spark, d):
    ev = _event_daily(spark, d).select("event_type", F.col("period_start").alias("month"), F.col("n_events").cast("double").alias("value"))
    from pyspark.sql import Window
    dense = ev.withColumn("t", F.row_number().over(Window.partitionBy("event_type").orderBy("month")) - 1)
    return series.lag_matrix(dense, "event_type")


@query("totals_rollup", S.with_(*S.BASE) + "".join(f"""{' UNION ALL ' if i else ''}SELECT '{g}' AS granularity, {S.period('date_added', g)} AS period_start, count(*) AS total_postings,
  count(*) AS total_role_mentions, CAST(sum(n) AS BIGINT) AS total_skill_mentions
FROM (SELECT f.posting_id, f.date_added, count(skill_id) AS n FROM frame f LEFT JOIN links l ON l.posting_id = f.posting_id GROUP BY ALL) GROUP BY 1, 2
""" for i, g in enumerate(("D", "W-MON", "M"))))
def q_totals_rollup(spark, d):
    return periods.totals_rollup(frame(spark, d), b.link_rows(spark, d), distinct=True)
