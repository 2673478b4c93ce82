"""Baseline trend report (I1) and its result rows.

All series sets (roles / skills x monthly / weekly, plus monthly salary) are
stacked into one long frame ``(series_set, key, period_start, value)`` and
summarised by one grouped pass of ``series.series_stats``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.series import market_share, series_stats

# Target types and the baseline model name.
ROLE = "role"
SALARY_ROLE = "salary_role"
SKILL = "skill"
BASELINE_ROLE = "baseline_role"
BASELINE_SKILL = "baseline_skill"
BASELINE_MODEL = "baseline"
SHARE_HEAD = 20

ROLE_KEY = "role_title_en"
SKILL_KEY = "display_name_en"


def _restrict(df: DataFrame, key_col: str, keys: DataFrame | None) -> DataFrame:
    """Keep only shortlisted keys (the shortlist is bounded by top-k)."""
    if keys is None:
        return df
    return df.join(F.broadcast(keys.select(F.col(key_col))), key_col, "left_semi")


def long_series(*, monthly_roles: DataFrame, weekly_roles: DataFrame, monthly_skills: DataFrame,
                weekly_skills: DataFrame, role_keys: DataFrame | None = None,
                skill_keys: DataFrame | None = None) -> DataFrame:
    """The five baseline series sets in one long frame."""
    parts = [
        ("roles_monthly", monthly_roles, ROLE_KEY, "posting_count", role_keys),
        ("roles_weekly", weekly_roles, ROLE_KEY, "posting_count", role_keys),
        ("skills_monthly", monthly_skills, SKILL_KEY, "posting_count", skill_keys),
        ("skills_weekly", weekly_skills, SKILL_KEY, "posting_count", skill_keys),
        ("salary_monthly", monthly_roles, ROLE_KEY, "avg_salary", role_keys),
    ]
    frames = [
        _restrict(df, key, keys).select(
            F.lit(name).alias("series_set"), F.col(key).alias("key"), "period_start", F.col(val).cast("double").alias("value")
        )
        for name, df, key, val, keys in parts
    ]
    return reduce(DataFrame.unionByName, frames)


def baseline_report(**frames) -> DataFrame:
    """One row per (series_set, key) with latest, n_periods, ma_3/6/12,
    growth_rate_pct and the linear trend."""
    return series_stats(long_series(**frames), ["series_set", "key"], "value")


def share_tables(monthly_roles: DataFrame, monthly_skills: DataFrame, head: int = SHARE_HEAD) -> DataFrame:
    """D9/F5 for roles and skills (against all keys of the window, Q9)."""
    r = market_share(monthly_roles, ROLE_KEY, head=head).select(F.lit("role").alias("kind"), F.col(ROLE_KEY).alias("key"), "posting_count", "share_pct")
    s = market_share(monthly_skills, SKILL_KEY, head=head).select(F.lit("skill").alias("kind"), F.col(SKILL_KEY).alias("key"), "posting_count", "share_pct")
    return r.unionByName(s)


def baseline_rows(report: DataFrame) -> DataFrame:
    """Result rows of the baseline model: horizon 0, no period, value =
    latest, metrics struct (skills carry no ma_6 / ma_12)."""
    trend = F.struct("slope", "intercept", "direction", "r2").alias("trend")
    is_role = F.col("series_set") == "roles_monthly"
    metrics = F.struct(
        F.col("ma_3"),
        F.when(is_role, F.col("ma_6")).alias("ma_6"),
        F.when(is_role, F.col("ma_12")).alias("ma_12"),
        F.col("growth_rate_pct"),
        trend,
    )
    return report.where(F.col("series_set").isin("roles_monthly", "skills_monthly")).select(
        F.lit(BASELINE_MODEL).alias("model_name"),
        F.when(is_role, F.lit(BASELINE_ROLE)).otherwise(F.lit(BASELINE_SKILL)).alias("target_type"),
        F.col("key").alias("target_key"),
        F.lit(0).alias("horizon_months"),
        F.lit(None).cast("date").alias("period_start"),
        F.col("latest").alias("predicted_value"),
        metrics.alias("metrics"),
    )
