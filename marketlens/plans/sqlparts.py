"""DuckDB SQL fragments for the oracle side: the same bindings and column
expressions as ``bindings`` and ``functions``, written once and reused."""

from __future__ import annotations

from marketlens.functions.text import PY_WS

# Python's strip set as a DuckDB expression (chr() of each code point).
PY_WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WS) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {PY_WS_SQL})"


def period(expr: str, freq: str) -> str:
    d = f"CAST({expr} AS DATE)"
    if freq == "D":
        return d
    if freq == "M":
        return f"CAST(date_trunc('month', {d}) AS DATE)"
    if freq == "W-MON":
        return f"CAST(date_trunc('week', {d} - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE)"
    raise ValueError(freq)


def rnd(expr: str, digits: int = 0) -> str:
    """Half-even rounding with numpy semantics (see functions.numeric)."""
    if digits == 0:
        return f"(round_even(CAST({expr} AS DOUBLE), 0) + 0.0)"
    scale = float(10 ** digits)
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale} + 0.0)"


def finite(expr: str) -> str:
    return f"(CASE WHEN isfinite(CAST({expr} AS DOUBLE)) THEN CAST({expr} AS DOUBLE) END)"


POSTINGS = """postings AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS date_added,
         o_orderpriority AS role_title, o_orderpriority AS role_title_en,
         CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 10.0 END AS salary_min,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 8.0 END AS salary_max,
         CASE o_orderstatus WHEN 'F' THEN 'onsite' WHEN 'O' THEN 'remote' WHEN 'P' THEN 'hybrid' ELSE 'unknown' END AS work_type
  FROM orders)"""

FRAME = f"""frame AS (
  SELECT id AS posting_id, date_added,
         coalesce(nullif({strip("coalesce(nullif(role_title_en, ''), role_title, '')")}, ''), 'unknown') AS role_title_en,
         {finite("salary_min")} AS salary_min, {finite("salary_max")} AS salary_max,
         coalesce(({finite("salary_min")} + {finite("salary_max")}) / 2.0, {finite("salary_min")}, {finite("salary_max")}) AS avg_salary
  FROM postings)"""

SKILLS = """skills AS (
  SELECT p_partkey AS id, lower(p_name) AS name, p_brand AS display_name, p_name AS display_name_en FROM part)"""

LINKS = """links AS (SELECT DISTINCT l_orderkey AS posting_id, l_partkey AS skill_id FROM lineitem)"""

SKILL_LABEL_SERIES = f"coalesce(nullif({strip('coalesce(display_name_en, display_name, name)')}, ''), 'unknown')"


def role_series(freq: str, name: str = "roles") -> str:
    return f"""{name} AS (
  SELECT {period("date_added", freq)} AS period_start, role_title_en,
         count(posting_id) AS posting_count,
         {rnd('avg(salary_min)', 2)} AS avg_salary_min,
         {rnd('avg(salary_max)', 2)} AS avg_salary_max,
         {rnd('avg(avg_salary)', 2)} AS avg_salary
  FROM frame GROUP BY 1, 2)"""


def skill_series(freq: str, name: str = "skill_series") -> str:
    return f"""{name} AS (
  SELECT {period("f.date_added", freq)} AS period_start, {SKILL_LABEL_SERIES} AS display_name_en,
         CAST(count(*) AS BIGINT) AS posting_count
  FROM links l JOIN frame f ON l.posting_id = f.posting_id JOIN skills s ON s.id = l.skill_id
  GROUP BY 1, 2)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (POSTINGS, FRAME, SKILLS, LINKS)


def series_stats(src: str, keys: list[str], value: str = "value", period_col: str = "period_start",
                 windows=(3, 6, 12), ma_digits: int | None = None) -> str:
    """SQL twin of ``operators.series.series_stats`` (a full SELECT)."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}"
    ma = []
    for w in windows:
        e = f"CASE WHEN count(*) >= {w} THEN avg(CASE WHEN _rd <= {w} THEN _v END) END"
        ma.append(f"{rnd(e, ma_digits) if ma_digits is not None else e} AS ma_{w}")
    return f"""SELECT {k}, latest, n_periods, {', '.join('ma_%d' % w for w in windows)},
  CASE WHEN n_periods > 1 AND _prev IS NOT NULL AND latest IS NOT NULL AND _prev <> 0
       THEN {rnd('100.0 * (latest - _prev) / _prev', 2)} END AS growth_rate_pct,
  CASE WHEN _m >= 2 THEN {rnd('_slope', 4)} END AS slope,
  CASE WHEN _m >= 2 THEN {rnd('_icpt', 4)} END AS intercept,
  CASE WHEN _m < 2 THEN 'unknown' WHEN _slope > 0.05 THEN 'up' WHEN _slope < -0.05 THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN _m >= 2 THEN {rnd('_r2', 4)} END AS r2
FROM (
  SELECT {k}, count(*) AS n_periods, max(CASE WHEN _rd = 1 THEN _v END) AS latest,
         max(CASE WHEN _rd = 2 THEN _v END) AS _prev, count(_v) AS _m,
         regr_slope(_v, _x) AS _slope, regr_intercept(_v, _x) AS _icpt, regr_r2(_v, _x) AS _r2,
         {', '.join(ma)}
  FROM (
    SELECT {k}, {period_col} AS _p, {finite(value)} AS _v,
           row_number() OVER ({part} ORDER BY {period_col} DESC) AS _rd,
           CASE WHEN {finite(value)} IS NOT NULL THEN CAST(count({finite(value)}) OVER ({part} ORDER BY {period_col} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS DOUBLE) END AS _x
    FROM {src}) z
  GROUP BY {k}) g"""


def last_periods(src: str, n: int, name: str) -> str:
    """CTE: rows of ``src`` in its last ``n`` distinct periods."""
    return f"""{name} AS (SELECT * FROM {src} WHERE period_start IN
  (SELECT period_start FROM (SELECT DISTINCT period_start FROM {src}) ORDER BY period_start DESC LIMIT {n}))"""


def top_keys(src: str, key: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT {key} FROM {src} GROUP BY {key}
  ORDER BY sum(posting_count) DESC, {key} ASC LIMIT {k})"""
