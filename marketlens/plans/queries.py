"""Bound queries, batch 1: descriptive analysis and period series.

Each query reads whole tables through ``bindings``; the SQL next to it is the
DuckDB oracle over the same parquet views."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import analysis, periods
from marketlens.plans import bindings as b
from marketlens.plans import sqlparts as S
from marketlens.plans.registry import query

TOP_N = 10


def frame(spark, d):
    return periods.posting_frame(b.postings(spark, d))


# ---------------------------------------------------------------- analysis
@query("top_companies", S.with_(*S.BASE) + f"""
SELECT c.c_name AS label, CAST(count(*) AS BIGINT) AS count
FROM postings p JOIN customer c ON c.c_custkey = p.company_id
WHERE c.c_name IS NOT NULL AND trim(c.c_name) <> ''
GROUP BY 1 ORDER BY count DESC, label ASC LIMIT {TOP_N}""")
def q_top_companies(spark, d):
    return analysis.top_labels(b.company_counts(spark, d), "company_name", TOP_N, weight_col="n")


@query("top_roles", S.with_(*S.BASE) + f"""
SELECT role_title_en AS label, CAST(count(*) AS BIGINT) AS count FROM postings
WHERE role_title_en IS NOT NULL AND trim(role_title_en) <> ''
GROUP BY 1 ORDER BY count DESC, label ASC LIMIT {TOP_N}""")
def q_top_roles(spark, d):
    return analysis.top_labels(b.postings(spark, d), "role_title_en", TOP_N)


@query("salary_summary", S.with_(*S.BASE) + """
SELECT round_even(min(salary_min), 0) AS min_salary_min, count(salary_min) AS min_salary_min_count,
       round_even(avg(salary_min), 0) AS avg_salary_min, count(salary_min) AS avg_salary_min_count,
       round_even(avg(salary_max), 0) AS avg_salary_max, count(salary_max) AS avg_salary_max_count,
       round_even(max(salary_max), 0) AS max_salary_max, count(salary_max) AS max_salary_max_count
FROM postings""")
def q_salary_summary(spark, d):
    return analysis.salary_summary(b.postings(spark, d))


@query("top_skills", S.with_(*S.BASE) + f"""
SELECT coalesce(nullif(trim(s.display_name_en), ''), nullif(trim(s.display_name), '')) AS label,
       CAST(count(*) AS BIGINT) AS count
FROM skills s JOIN links l ON l.skill_id = s.id
WHERE coalesce(nullif(trim(s.display_name_en), ''), nullif(trim(s.display_name), '')) IS NOT NULL
GROUP BY 1 ORDER BY count DESC, label ASC LIMIT {TOP_N}""")
def q_top_skills(spark, d):
    return analysis.top_skills(b.links(spark, d), b.skills(spark, d), TOP_N)


# ---------------------------------------------------------------- periods
for _freq, _tag in (("M", "monthly"), ("W-MON", "weekly"), ("D", "daily")):
    def _roles(spark, d, _f=_freq):
        return periods.role_series(frame(spark, d), _f)

    def _skills(spark, d, _f=_freq):
        return periods.skill_series(b.links(spark, d), frame(spark, d), b.skills(spark, d), _f, parts=b.link_parts(spark, d))

    query(f"roles_{_tag}", S.with_(*S.BASE, S.role_series(_freq)) + "SELECT * FROM roles")(_roles)
    query(f"skills_{_tag}", S.with_(*S.BASE, S.skill_series(_freq)) + "SELECT * FROM skill_series")(_skills)


@query("totals_monthly", S.with_(*S.BASE, S.role_series("M"), S.skill_series("M")) + f"""
, posts AS (SELECT {S.period("date_added", "M")} AS period_start, count(posting_id) AS total_postings FROM frame GROUP BY 1)
, rs AS (SELECT period_start, sum(posting_count) AS s FROM roles GROUP BY 1)
, ss AS (SELECT period_start, sum(posting_count) AS s FROM skill_series GROUP BY 1)
SELECT p.period_start, CAST(p.total_postings AS BIGINT) AS total_postings,
       CAST(coalesce(rs.s, 0) AS BIGINT) AS total_role_mentions,
       CAST(coalesce(ss.s, 0) AS BIGINT) AS total_skill_mentions
FROM posts p LEFT JOIN rs USING (period_start) LEFT JOIN ss USING (period_start)""")
def q_totals_monthly(spark, d):
    f = frame(spark, d)
    roles = periods.role_series(f, "M")
    sk = periods.skill_series(b.links(spark, d), f, b.skills(spark, d), "M", parts=b.link_parts(spark, d))
    return periods.period_totals(f, roles, sk, "M")


_ROLLUP_SQL = " UNION ALL ".join(
    f"SELECT '{fq}' AS granularity, {S.period('date_added', fq)} AS period_start, role_title_en, posting_id, salary_min, salary_max, avg_salary FROM frame"
    for fq in ("D", "W-MON", "M")
)


@query("roles_rollup", S.with_(*S.BASE) + f"""
SELECT granularity, period_start, role_title_en, count(posting_id) AS posting_count,
       {S.rnd('avg(salary_min)', 2)} AS avg_salary_min, {S.rnd('avg(salary_max)', 2)} AS avg_salary_max,
       {S.rnd('avg(avg_salary)', 2)} AS avg_salary
FROM ({_ROLLUP_SQL}) GROUP BY 1, 2, 3""")
def q_roles_rollup(spark, d):
    return periods.role_rollup(frame(spark, d))


_SKILL_ROLLUP_SQL = " UNION ALL ".join(
    f"SELECT '{fq}' AS granularity, {S.period('f.date_added', fq)} AS period_start, {S.SKILL_LABEL_SERIES} AS display_name_en "
    "FROM links l JOIN frame f ON l.posting_id = f.posting_id JOIN skills s ON s.id = l.skill_id"
    for fq in ("D", "W-MON", "M")
)


@query("skills_rollup", S.with_(*S.BASE) + f"""
SELECT granularity, period_start, display_name_en, CAST(count(*) AS BIGINT) AS posting_count
FROM ({_SKILL_ROLLUP_SQL}) GROUP BY 1, 2, 3""")
def q_skills_rollup(spark, d):
    return periods.skill_rollup(b.links(spark, d), frame(spark, d), b.skills(spark, d), parts=b.link_parts(spark, d))


@query("roles_last_24_months", S.with_(*S.BASE, S.role_series("M")) + """
, keep AS (SELECT DISTINCT period_start FROM roles ORDER BY period_start DESC LIMIT 24)
SELECT * FROM roles WHERE period_start IN (SELECT period_start FROM keep)""")
def q_roles_last(spark, d):
    return periods.last_periods(periods.role_series(frame(spark, d), "M"), 24)


@query("weekly_roles_window", S.with_(*S.BASE, S.role_series("W-MON")) + """
, keep AS (SELECT DISTINCT period_start FROM roles ORDER BY period_start DESC LIMIT 120)
SELECT * FROM roles WHERE period_start IN (SELECT period_start FROM keep)""")
def q_weekly_window(spark, d):
    return periods.last_periods(periods.role_series(frame(spark, d), "W-MON"), periods.weekly_window(24))


@query("top_roles_recent", S.with_(*S.BASE, S.role_series("M")) + """
, keep AS (SELECT DISTINCT period_start FROM roles ORDER BY period_start DESC LIMIT 6)
SELECT role_title_en, CAST(sum(posting_count) AS BIGINT) AS posting_count FROM roles
WHERE period_start IN (SELECT period_start FROM keep)
GROUP BY 1 ORDER BY posting_count DESC, role_title_en ASC LIMIT 15""")
def q_top_roles_recent(spark, d):
    return periods.top_keys_recent(periods.role_series(frame(spark, d), "M"), "role_title_en")


@query("top_skills_recent", S.with_(*S.BASE, S.skill_series("M")) + """
, keep AS (SELECT DISTINCT period_start FROM skill_series ORDER BY period_start DESC LIMIT 6)
SELECT display_name_en, CAST(sum(posting_count) AS BIGINT) AS posting_count FROM skill_series
WHERE period_start IN (SELECT period_start FROM keep)
GROUP BY 1 ORDER BY posting_count DESC, display_name_en ASC LIMIT 15""")
def q_top_skills_recent(spark, d):
    sk = periods.skill_series(b.links(spark, d), frame(spark, d), b.skills(spark, d), "M", parts=b.link_parts(spark, d))
    return periods.top_keys_recent(sk, "display_name_en")


@query("manifest", S.with_(*S.BASE) + """
SELECT count(*) AS n_postings, min(date_added) AS date_min, max(date_added) AS date_max FROM frame""")
def q_manifest(spark, d):
    return periods.manifest(frame(spark, d))
