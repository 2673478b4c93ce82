"""Period series.

Long frames keyed by ``period_start`` with the column contract of the
reference's series sources:

- roles:  period_start, role_title_en, posting_count, avg_salary_min,
          avg_salary_max, avg_salary
- skills: period_start, display_name_en, posting_count
- totals: period_start, total_postings, total_role_mentions,
          total_skill_mentions
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.dates import FREQ_MONTH, first_day, period_start
from marketlens.functions.labels import role_label, skill_label_series
from marketlens.functions.numeric import finite_or_null, round_half_even, salary_midpoint

ROLES_SCHEMA = T.StructType([
    T.StructField("period_start", T.DateType()),
    T.StructField("role_title_en", T.StringType()),
    T.StructField("posting_count", T.LongType()),
    T.StructField("avg_salary_min", T.DoubleType()),
    T.StructField("avg_salary_max", T.DoubleType()),
    T.StructField("avg_salary", T.DoubleType()),
])
SKILLS_SCHEMA = T.StructType([
    T.StructField("period_start", T.DateType()),
    T.StructField("display_name_en", T.StringType()),
    T.StructField("posting_count", T.LongType()),
])
TOTALS_SCHEMA = T.StructType([
    T.StructField("period_start", T.DateType()),
    T.StructField("total_postings", T.LongType()),
    T.StructField("total_role_mentions", T.LongType()),
    T.StructField("total_skill_mentions", T.LongType()),
])


def posting_frame(postings: DataFrame, *, id_col="id", date_col="date_added", en_col="role_title_en",
                  title_col="role_title", min_col="salary_min", max_col="salary_max") -> DataFrame:
    """A2 derived columns: role label (B7), scrubbed salaries (B20) and the
    salary midpoint (B8). Output: posting_id, date_added, role_title_en,
    salary_min, salary_max, avg_salary."""
    lo, hi = finite_or_null(min_col), finite_or_null(max_col)
    return postings.select(
        F.col(id_col).alias("posting_id"),
        F.to_date(date_col).alias("date_added"),
        role_label(en_col, title_col).alias("role_title_en"),
        lo.alias("salary_min"),
        hi.alias("salary_max"),
        salary_midpoint(lo, hi).alias("avg_salary"),
    )


def role_series(frame: DataFrame, freq: str = FREQ_MONTH) -> DataFrame:
    """Per (period, role): posting count and mean salaries (2 decimals,
    half-even). ``frame`` is the output of ``posting_frame``."""
    return (
        frame.groupBy(period_start("date_added", freq).alias("period_start"), "role_title_en")
        .agg(
            F.count("posting_id").alias("posting_count"),
            round_half_even(F.avg("salary_min"), 2).alias("avg_salary_min"),
            round_half_even(F.avg("salary_max"), 2).alias("avg_salary_max"),
            round_half_even(F.avg("avg_salary"), 2).alias("avg_salary"),
        )
    )


def dated_links(links: DataFrame, frame: DataFrame, *, posting_col="posting_id", skill_col="skill_id", distinct: bool = False) -> DataFrame:
    """(posting_id, skill_id, date_added) of the links of the postings in
    ``frame``. With ``distinct`` repeated links count once; they are removed
    after the join, so links of postings that ``frame`` leaves out are never
    shuffled for it."""
    dated = links.select(F.col(posting_col).alias("posting_id"), F.col(skill_col).alias("skill_id")).join(
        frame.select("posting_id", "date_added"), "posting_id"
    )
    return dated.groupBy("posting_id", "skill_id").agg(F.first("date_added").alias("date_added")) if distinct else dated


def skill_day_counts(links: DataFrame, frame: DataFrame, *, distinct: bool = False, parts: int | None = None) -> DataFrame:
    """(date_added, skill_id, n): links per day and skill. With ``parts`` the
    rows are dealt by day and skill into as many tasks, so that what a task
    keeps does not grow with the input; no group is larger than a day's postings."""
    dated = dated_links(links, frame, distinct=distinct).select("date_added", "skill_id")
    dealt = dated.repartition(parts, "date_added", "skill_id") if parts else dated
    return dealt.groupBy("date_added", "skill_id").agg(F.count(F.lit(1)).alias("n"))


def _labelled(counts: DataFrame, skills: DataFrame, id_col: str, en_col: str, display_col: str, name_col: str) -> DataFrame:
    dim = skills.select(F.col(id_col).alias("skill_id"), skill_label_series(en_col, display_col, name_col).alias("display_name_en"))
    return counts.join(dim, "skill_id")


def skill_series(links: DataFrame, frame: DataFrame, skills: DataFrame, freq: str = FREQ_MONTH, *,
                 id_col="id", en_col="display_name_en", display_col="display_name", name_col="name",
                 parts: int | None = None) -> DataFrame:
    """D6 (+C2): link count per (period, skill label B10). The big link table is
    reduced to one row per day and skill (``parts`` as there) before it meets
    the skill dimension."""
    counts = skill_day_counts(links, frame, parts=parts)
    return _labelled(counts, skills, id_col, en_col, display_col, name_col).groupBy(
        period_start("date_added", freq).alias("period_start"), "display_name_en"
    ).agg(F.sum("n").cast("bigint").alias("posting_count"))


def period_totals(frame: DataFrame, roles: DataFrame, skills_series: DataFrame, freq: str = FREQ_MONTH) -> DataFrame:
    """D7 (+C4): postings per period, left-joined with summed role and skill
    mentions, missing sums filled with 0."""
    posts = frame.groupBy(period_start("date_added", freq).alias("period_start")).agg(
        F.count("posting_id").alias("total_postings")
    )
    role_sums = roles.groupBy("period_start").agg(F.sum("posting_count").alias("total_role_mentions"))
    skill_sums = skills_series.groupBy("period_start").agg(F.sum("posting_count").alias("total_skill_mentions"))
    return (
        posts.join(role_sums, "period_start", "left")
        .join(skill_sums, "period_start", "left")
        .select(
            "period_start",
            F.col("total_postings").cast("bigint").alias("total_postings"),
            F.coalesce("total_role_mentions", F.lit(0)).cast("bigint").alias("total_role_mentions"),
            F.coalesce("total_skill_mentions", F.lit(0)).cast("bigint").alias("total_skill_mentions"),
        )
    )


def _granularities(date_col: str, freqs) -> F.Column:
    return F.explode(F.array(*[
        F.struct(F.lit(f).alias("granularity"), period_start(date_col, f).alias("period_start")) for f in freqs
    ]))


def role_rollup(frame: DataFrame, freqs=("D", "W-MON", "M")) -> DataFrame:
    """D5 at several granularities in one aggregate (one shuffle): each
    posting is expanded to one (granularity, period) row per code."""
    g = frame.select("*", _granularities("date_added", freqs).alias("_g"))
    return (
        g.groupBy(F.col("_g.granularity").alias("granularity"), F.col("_g.period_start").alias("period_start"), "role_title_en")
        .agg(
            F.count("posting_id").alias("posting_count"),
            round_half_even(F.avg("salary_min"), 2).alias("avg_salary_min"),
            round_half_even(F.avg("salary_max"), 2).alias("avg_salary_max"),
            round_half_even(F.avg("avg_salary"), 2).alias("avg_salary"),
        )
    )


def skill_rollup(links: DataFrame, frame: DataFrame, skills: DataFrame, freqs=("D", "W-MON", "M"), *,
                 id_col="id", en_col="display_name_en", display_col="display_name", name_col="name",
                 distinct: bool = False, parts: int | None = None) -> DataFrame:
    """D8 for skills: links are counted per day and skill id (``parts`` as in
    ``skill_day_counts``), named by the dimension and summed per day and label;
    only those sums are expanded to the granularities."""
    counts = skill_day_counts(links, frame, distinct=distinct, parts=parts)
    days = _labelled(counts, skills, id_col, en_col, display_col, name_col).groupBy("date_added", "display_name_en").agg(F.sum("n").alias("n"))
    g = days.select("display_name_en", "n", _granularities("date_added", freqs).alias("_g"))
    return g.groupBy(F.col("_g.granularity").alias("granularity"), F.col("_g.period_start").alias("period_start"), "display_name_en").agg(
        F.sum("n").cast("bigint").alias("posting_count")
    )


def totals_rollup(frame: DataFrame, links: DataFrame, freqs=("D", "W-MON", "M"), *, distinct: bool = False) -> DataFrame:
    """D8 for totals (D7 at several granularities): postings, role mentions and
    skill mentions per (granularity, period). Postings take their number of
    links with them, so both sums come from one scan of the postings; periods
    are grouping sets of one aggregate over the days."""
    own = links.groupBy("posting_id").agg((F.count_distinct("skill_id") if distinct else F.count("skill_id")).alias("n"))
    days = frame.join(own, "posting_id", "left").groupBy("date_added").agg(
        F.count("posting_id").alias("postings"), F.sum(F.coalesce("n", F.lit(0))).alias("skills"))
    out = days.select("*", _granularities("date_added", freqs).alias("_g"))
    return out.groupBy(F.col("_g.granularity").alias("granularity"), F.col("_g.period_start").alias("period_start")).agg(
        F.sum("postings").cast("bigint").alias("total_postings"), F.sum("postings").cast("bigint").alias("total_role_mentions"),
        F.sum("skills").cast("bigint").alias("total_skill_mentions"))


def window_starts(frame: DataFrame, windows: dict[str, int], date_col: str = "date_added") -> dict:
    """E1 from the posting dates alone: per frequency the first of the last
    ``n`` distinct periods, None where that is the whole history (n <= 0, or
    not more than n periods). Only the distinct days are collected, which the
    time span bounds, not the number of postings."""
    days = sorted(r[0] for r in frame.select(F.col(date_col).cast("date")).distinct().collect() if r[0] is not None)
    out = {}
    for freq, n in windows.items():
        starts = sorted({first_day(d, freq) for d in days})
        out[freq] = starts[-int(n)] if 0 < n < len(starts) else None
    return out


def last_periods(df: DataFrame, n: int, period_col: str = "period_start") -> DataFrame:
    """E1 (+G3, C5): rows of the last ``n`` distinct periods present; n <= 0 or
    fewer periods than n keeps all. The kept period list is bounded by n, so
    it is broadcast into a semi-join (no un-partitioned window)."""
    if n <= 0:
        return df
    keep = df.select(period_col).distinct().orderBy(F.desc(period_col)).limit(int(n))
    return df.join(F.broadcast(keep), period_col, "left_semi")


def last_periods_by(df: DataFrame, n_by_group: dict, group_col: str = "granularity",
                    period_col: str = "period_start") -> DataFrame:
    """E1 for a frame holding several granularities: per group, the rows of
    its last ``n`` distinct periods (n <= 0 keeps the group whole). The
    ranking runs over the distinct-period calendar, which is bounded by the
    time span (not by the data); the kept list is bounded by sum(n) and is
    broadcast into one semi-join."""
    from pyspark.sql import Window

    cal = df.select(group_col, period_col).distinct()
    rank = F.row_number().over(Window.partitionBy(group_col).orderBy(F.desc(period_col)))
    limit = F.coalesce(*[F.when(F.col(group_col) == g, F.lit(int(n) if n > 0 else 2**31 - 1)) for g, n in n_by_group.items()])
    keep = cal.where(F.col(group_col).isin(*n_by_group)).withColumn("_r", rank).where(F.col("_r") <= limit)
    return df.join(F.broadcast(keep.select(group_col, period_col)), [group_col, period_col], "left_semi")


def weekly_window(months: int) -> int:
    """Weekly training window in periods, 5 x months capped at 200."""
    return min(int(months) * 5, 200)


def rank_top_keys(df: DataFrame, key_col: str, value_col: str, k: int) -> DataFrame:
    """Keys by summed value, descending, key ascending on ties (Q8), top k.
    Output: (key_col, value_col)."""
    summed = df.groupBy(key_col).agg(F.sum(value_col).alias(value_col))
    return summed.orderBy(F.desc(value_col), F.asc(key_col)).limit(max(int(k), 0))


def top_keys_recent(df: DataFrame, key_col: str, value_col: str = "posting_count", months: int = 6, k: int = 15) -> DataFrame:
    """Top k keys by summed value over the last ``months`` periods."""
    return rank_top_keys(last_periods(df, months), key_col, value_col, k)


def manifest(frame: DataFrame, date_col: str = "date_added") -> DataFrame:
    """A3: one row: number of postings and the date range (NULL when empty)."""
    return frame.agg(
        F.count(F.lit(1)).alias("n_postings"),
        F.min(date_col).alias("date_min"),
        F.max(date_col).alias("date_max"),
    )
