"""Reviewed corrections (A10, B16, H4): typed correction feed, validation
with the extraction rules, replacement of the editable posting columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.text import optional_stripped, py_strip
from marketlens.operators.extraction import NUMBER_TEXT, WORK_TYPES, validate_payloads

EDITABLE = ("company_name", "role_title", "role_title_en", "salary_min", "salary_max", "work_type",
            "has_nondiscrimination_disclaimer", "location", "country", "city")


def parse_feed(feed: DataFrame, id_col: str = "posting_id", extra=()) -> DataFrame:
    """A10: text fields -> typed. Blank -> NULL; salaries must parse as
    numbers (else a reject reason); the English skill list is split on line
    breaks with blank entries dropped (B16 makes it both lists); work type
    must be a known value. ``extra`` columns (a sequence number) are kept."""
    def num(c):
        s = optional_stripped(c)
        v = F.when(s.rlike(NUMBER_TEXT), s.try_cast("double"))  # a Java double would also take "12d"
        return v, F.when(s.isNotNull() & v.isNull(), F.lit(f"{c} must be a number"))

    lo, r_lo = num("salary_min")
    hi, r_hi = num("salary_max")
    work = F.lower(optional_stripped("work_type"))
    r_work = F.when(work.isNotNull() & ~work.isin(*WORK_TYPES), F.lit("unknown work type"))
    skills = F.filter(F.transform(F.split(F.coalesce(F.col("skills_en"), F.lit("")), "\\R"), lambda x: py_strip(x)),
                      lambda x: x != "")
    return feed.select(
        F.col(id_col), *extra,
        optional_stripped("company_name").alias("company_name"),
        F.coalesce(py_strip("role_title"), F.lit("")).alias("role_title"),
        optional_stripped("role_title_en").alias("role_title_en"),
        lo.alias("salary_min"), hi.alias("salary_max"),
        F.coalesce(work, F.lit("unknown")).alias("work_type"),
        F.coalesce(F.col("has_nondiscrimination_disclaimer").cast("boolean"), F.lit(False)).alias("has_nondiscrimination_disclaimer"),
        optional_stripped("location").alias("location"), optional_stripped("country").alias("country"),
        optional_stripped("city").alias("city"),
        skills.alias("skills"), skills.alias("skills_en"),
        F.coalesce(r_lo, r_hi, r_work).alias("feed_reason"),
    )


def apply_corrections(postings: DataFrame, feed: DataFrame, id_col: str = "id", seq_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H4: validate parsed corrections with the extraction rules (the stored
    currency is kept), reject unknown ids, replace the editable columns of
    accepted rows outright (a NULL correction clears the value). Of several
    corrections of one posting the last by ``seq_col`` counts (without it, the
    greatest row), so a posting stays one row.

    Returns (postings after the update, accepted corrections with their skill
    lists for the link rebuild, rejects (posting_id, reason))."""
    last = F.struct(*([F.col(seq_col)] if seq_col else []), F.to_json(F.struct(*feed.columns)))
    feed = feed.groupBy("posting_id").agg(F.max_by(F.struct(*feed.columns), last).alias("_f")).select("_f.*")
    stored = postings.select(F.col(id_col).alias("posting_id"), "salary_currency", F.lit(True).alias("_known"))
    known = feed.join(stored, "posting_id", "left")
    # the stored currency is kept: it goes through the same checks unchanged
    payload = F.to_json(F.struct(*[F.col(c) for c in EDITABLE], "skills", "skills_en", "salary_currency"))
    checked = validate_payloads(known.select("posting_id", payload.alias("payload")), "payload", "posting_id")
    checked = checked.join(known.select("posting_id", "feed_reason", "_known"), "posting_id")
    reason = F.coalesce(F.when(F.col("_known").isNull(), F.lit("unknown posting id")), F.col("feed_reason"), F.col("reason"))
    checked = checked.withColumn("reason", reason)
    rejects = checked.where(F.col("reason").isNotNull()).select("posting_id", "reason")
    ok = checked.where(F.col("reason").isNull()).select("posting_id", *EDITABLE, "skills", "skills_en")
    upd = ok.select(F.col("posting_id").alias(id_col), *[F.col(c).alias(f"_new_{c}") for c in EDITABLE])
    merged = postings.join(upd, id_col, "left")
    hit = F.col("_new_role_title").isNotNull()
    out = merged.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in EDITABLE else F.col(c)
                          for c in postings.columns])
    return out, ok, rejects
