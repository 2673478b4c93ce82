"""Series operators over long frames (key, period, value): E3-E13, D9,
D12-D15, C9-C10.

Every operator runs for all keys at once. Windows are partitioned by the
series key; a series holds one row per period, so a window partition is
bounded by the number of periods in the frame (months, weeks), not by the
number of source rows behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numeric import finite_or_null, round_half_even

# Moving-average windows, growth lag and trend threshold.
MA_WINDOWS = (3, 6, 12)
GROWTH_LAG = 1
TREND_FLAT_BAND = 0.05


def series_stats(df: DataFrame, key_cols, value_col: str, period_col: str = "period_start",
                 windows=MA_WINDOWS, lag: int = GROWTH_LAG) -> DataFrame:
    """E3-E6 + D14 for every key in one window pass and one aggregate.

    Per key: ``latest`` (value of the last period), ``n_periods``, ``ma_<w>``
    (mean of the last w rows, NULL if fewer rows; NULL values skipped),
    ``growth_rate_pct`` (last vs ``lag`` rows before, 2 decimals; NULL when a
    side is missing or the earlier value is 0), and the OLS trend over the row
    index of the finite values: ``slope``, ``intercept``, ``r2`` (4 decimals)
    and ``direction`` (up / down / flat at +-0.05 on the unrounded slope;
    unknown under 2 finite points). Series are not densified (Q3)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    v = finite_or_null(value_col)
    by_key = Window.partitionBy(*keys)
    s = df.select(*keys, F.col(period_col).alias("_p"), v.alias("_v"))
    s = s.withColumn("_rd", F.row_number().over(by_key.orderBy(F.desc("_p"))))
    # Row index among finite values only (trend x), 0-based.
    s = s.withColumn(
        "_x",
        F.when(F.col("_v").isNotNull(),
               (F.count("_v").over(by_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("double")),
    )
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n_periods"),
        F.max(F.when(F.col("_rd") == 1, F.col("_v"))).alias("latest"),
        F.max(F.when(F.col("_rd") == lag + 1, F.col("_v"))).alias("_prev"),
        F.count("_v").alias("_m"),
        F.regr_slope("_v", "_x").alias("_slope"),
        F.regr_intercept("_v", "_x").alias("_icpt"),
        F.regr_r2("_v", "_x").alias("_r2"),
    ]
    for w in windows:
        aggs.append(F.when(n >= w, F.avg(F.when(F.col("_rd") <= w, F.col("_v")))).alias(f"ma_{w}"))
    g = s.groupBy(*keys).agg(*aggs)
    growth = F.when(
        (F.col("n_periods") > lag) & F.col("_prev").isNotNull() & F.col("latest").isNotNull() & (F.col("_prev") != 0),
        round_half_even(F.lit(100.0) * (F.col("latest") - F.col("_prev")) / F.col("_prev"), 2),
    )
    ok = F.col("_m") >= 2
    direction = (
        F.when(~ok, F.lit("unknown"))
        .when(F.col("_slope") > TREND_FLAT_BAND, F.lit("up"))
        .when(F.col("_slope") < -TREND_FLAT_BAND, F.lit("down"))
        .otherwise(F.lit("flat"))
    )
    return g.select(
        *keys,
        "latest",
        "n_periods",
        *[f"ma_{w}" for w in windows],
        growth.alias("growth_rate_pct"),
        F.when(ok, round_half_even(F.col("_slope"), 4)).alias("slope"),
        F.when(ok, round_half_even(F.col("_icpt"), 4)).alias("intercept"),
        direction.alias("direction"),
        F.when(ok, round_half_even(F.col("_r2"), 4)).alias("r2"),
    )


def market_share(df: DataFrame, key_col: str, value_col: str = "posting_count", head: int | None = None) -> DataFrame:
    """D9 (+F5): sum per key, share of the grand total in percent (2 decimals);
    a zero total divides by 1. Sorted by value desc, key asc (Q8); ``head``
    keeps the first rows. The grand total is a one-row aggregate joined on a
    constant key (broadcast of one row; no window over all keys)."""
    sums = df.groupBy(key_col).agg(F.sum(value_col).alias(value_col))
    total = sums.agg(F.sum(value_col).cast("double").alias("_grand")).withColumn("_k", F.lit(1))
    out = (
        sums.withColumn("_k", F.lit(1))
        .join(F.broadcast(total), "_k")
        .select(
            key_col,
            value_col,
            round_half_even(
                F.col(value_col) / F.when(F.col("_grand") == 0, F.lit(1.0)).otherwise(F.col("_grand")) * F.lit(100.0), 2
            ).alias("share_pct"),
        )
    )
    ordered = out.orderBy(F.desc(value_col), F.asc(key_col))
    return ordered.limit(head) if head is not None else ordered


def month_sums(df: DataFrame, key_col: str, value_col: str, period_col: str = "period_start") -> DataFrame:
    """Sum per (key, month)."""
    return df.groupBy(key_col, F.trunc(F.to_date(period_col), "MM").alias("month")).agg(
        F.sum(finite_or_null(value_col)).alias("value")
    )


def month_means(df: DataFrame, key_col: str, value_col: str, period_col: str = "period_start") -> DataFrame:
    """Mean per (key, month), non-finite values scrubbed first (Q17)."""
    return df.groupBy(key_col, F.trunc(F.to_date(period_col), "MM").alias("month")).agg(
        F.avg(finite_or_null(value_col)).alias("value")
    )


def month_calendar(monthly: DataFrame, key_col: str) -> DataFrame:
    """Every month between the key's own first and last month."""
    bounds = monthly.groupBy(key_col).agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    return bounds.select(key_col, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("month"))


def dense_months(monthly: DataFrame, key_col: str, fill: float | None = 0.0) -> DataFrame:
    """Dense monthly series (key, month, value, t) with ``fill`` for the
    missing months; ``t`` is the 0-based month index within the key."""
    cal = month_calendar(monthly, key_col)
    out = cal.join(monthly, [key_col, "month"], "left")
    value = F.coalesce(F.col("value"), F.lit(fill)) if fill is not None else F.col("value")
    w = Window.partitionBy(key_col).orderBy("month")
    return out.select(key_col, "month", value.cast("double").alias("value")).withColumn(
        "t", F.row_number().over(w) - 1
    )


def interpolate_fill(dense: DataFrame, key_col: str) -> DataFrame:
    """Linear interpolation over the row index between known values, then
    back-fill before the first and forward-fill after the last known value.
    A key with no known value keeps NULLs (reported as an error later, Q11)."""
    w = Window.partitionBy(key_col).orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    known_t = F.when(F.col("value").isNotNull(), F.col("t"))
    d = (
        dense.withColumn("_v0", F.last("value", ignorenulls=True).over(before))
        .withColumn("_t0", F.last(known_t, ignorenulls=True).over(before))
        .withColumn("_v1", F.first("value", ignorenulls=True).over(after))
        .withColumn("_t1", F.first(known_t, ignorenulls=True).over(after))
    )
    interp = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    filled = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(F.col("_v0").isNotNull() & F.col("_v1").isNotNull(), interp)
        .otherwise(F.coalesce(F.col("_v1"), F.col("_v0")))
    )
    return d.select(key_col, "month", filled.alias("value"), "t")


def holdout_size(n) -> F.Column:
    """min(3, max(1, n // 5))."""
    return F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 5).cast("int")))


def lag_matrix(dense: DataFrame, key_col: str, lags: int = 6) -> DataFrame:
    """One row per target position with its ``lags`` previous values as an
    array (oldest first); the first ``lags`` positions are dropped."""
    w = Window.partitionBy(key_col).orderBy("t")
    feats = F.array(*[F.lag("value", k).over(w) for k in range(lags, 0, -1)])
    return dense.select(key_col, "month", "t", "value", feats.alias("lags")).where(F.col("t") >= lags)


def holdout_metrics(df: DataFrame, group_cols, actual_col: str = "actual", pred_col: str = "pred") -> DataFrame:
    """MAE and RMSE (4 decimals) per group."""
    e = F.col(actual_col) - F.col(pred_col)
    return df.groupBy(*group_cols).agg(
        round_half_even(F.avg(F.abs(e)), 4).alias("mae"),
        round_half_even(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
    )
