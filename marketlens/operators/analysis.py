"""Descriptive analysis (D1-D4, D19): top labels by count and the salary
summary, each as one grouped aggregate with partial (map-side) aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import finite_or_null
from marketlens.functions.labels import row_limit, skill_label_analysis
from marketlens.functions.text import non_blank


def top_labels(df: DataFrame, label_col: str, n=None, *, weight_col: str | None = None) -> DataFrame:
    """Count rows per raw (case-sensitive, untrimmed) label, excluding
    NULL and blank labels; order by count desc then label asc; keep the top n.

    ``weight_col`` lets a caller pass rows that are already partial counts
    (pre-aggregated before a join), so the count is their sum.
    Output: (label STRING, count BIGINT)."""
    limit = row_limit(n)
    measure = F.count(F.lit(1)) if weight_col is None else F.sum(weight_col)
    return (
        df.where(non_blank(label_col))
        .groupBy(F.col(label_col).alias("label"))
        .agg(measure.cast("bigint").alias("count"))
        .orderBy(F.desc("count"), F.asc("label"))
        .limit(limit)
    )


def top_skills(links: DataFrame, skills: DataFrame, n=None, *, skill_id_col: str = "skill_id",
               id_col: str = "id", en_col: str = "display_name_en", display_col: str = "display_name",
               weight_col: str | None = None) -> DataFrame:
    """D3 (+C1, B9): link count per skill label (trimmed English label, else
    trimmed display label; NULL labels dropped), top n.

    Links are counted per skill id first, so the join to the skill dimension
    carries one row per skill, not one per link."""
    limit = row_limit(n)
    measure = F.count(F.lit(1)) if weight_col is None else F.sum(weight_col)
    per_skill = links.groupBy(F.col(skill_id_col).alias("_sid")).agg(measure.alias("_n"))
    labelled = per_skill.join(
        skills.select(F.col(id_col).alias("_sid"), skill_label_analysis(en_col, display_col).alias("label")), "_sid"
    )
    return (
        labelled.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.sum("_n").cast("bigint").alias("count"))
        .orderBy(F.desc("count"), F.asc("label"))
        .limit(limit)
    )


def salary_summary(df: DataFrame, min_col: str = "salary_min", max_col: str = "salary_max") -> DataFrame:
    """D4 (+B20, B22): one-pass global aggregate; each metric ignores its own
    NULLs, and NaN and infinities count as NULL; values rounded half-even to
    whole units; one row."""
    lo, hi = finite_or_null(min_col), finite_or_null(max_col)
    return df.agg(
        F.bround(F.min(lo), 0).alias("min_salary_min"),
        F.count(lo).alias("min_salary_min_count"),
        F.bround(F.avg(lo), 0).alias("avg_salary_min"),
        F.count(lo).alias("avg_salary_min_count"),
        F.bround(F.avg(hi), 0).alias("avg_salary_max"),
        F.count(hi).alias("avg_salary_max_count"),
        F.bround(F.max(hi), 0).alias("max_salary_max"),
        F.count(hi).alias("max_salary_max_count"),
    )


ANALYSES = ("top_companies", "top_roles", "salary_summary", "top_skills")


def run_analysis(postings: DataFrame, links: DataFrame, skills: DataFrame, selected, n=None, *,
                 company_col: str = "company_name", role_col: str = "role_title_en") -> dict[str, DataFrame]:
    """Any subset of D1-D4 over one posting projection."""
    chosen = [s for s in ANALYSES if s in set(selected or ())]
    out: dict[str, DataFrame] = {}
    for name in chosen:
        if name == "top_companies":
            out[name] = top_labels(postings, company_col, n)
        elif name == "top_roles":
            out[name] = top_labels(postings, role_col, n)
        elif name == "salary_summary":
            out[name] = salary_summary(postings)
        elif name == "top_skills":
            out[name] = top_skills(links, skills, n)
    return out
