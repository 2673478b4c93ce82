"""File sources (A1, A4, A5, A12, A13) and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.text import py_strip
from marketlens.operators import periods
from marketlens.operators.glossary import parse_lines

# The CSV series files of the file source and their schemas.
SERIES_FILES = {
    "monthly_roles": ("monthly_roles.csv", "period_start string, role_title_en string, posting_count long, "
                      "avg_salary_min double, avg_salary_max double, avg_salary double"),
    "weekly_roles": ("weekly_roles.csv", "period_start string, role_title_en string, posting_count long, "
                     "avg_salary_min double, avg_salary_max double, avg_salary double"),
    "monthly_skills": ("monthly_skills.csv", "period_start string, display_name_en string, posting_count long"),
    "weekly_skills": ("weekly_skills.csv", "period_start string, display_name_en string, posting_count long"),
    "monthly_totals": ("monthly_totals.csv", "period_start string, total_postings long, total_role_mentions long, "
                       "total_skill_mentions long"),
}
FILE_KINDS = ("fake", "file", "fake_file")
TABLE_KINDS = ("database", "db")
SOURCE_TABLES = "tables"

ATTEMPT_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("extract_id", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("token_usage", T.StructType([T.StructField("prompt_tokens", T.IntegerType()),
                                               T.StructField("completion_tokens", T.IntegerType()),
                                               T.StructField("total_tokens", T.IntegerType())])),
    T.StructField("fallback_used", T.BooleanType()), T.StructField("validation_result", T.StringType()),
    T.StructField("error_category", T.StringType()), T.StructField("attempt_index", T.IntegerType()),
    T.StructField("posting_chars", T.IntegerType()), T.StructField("content_hash_prefix", T.StringType()),
])


def read_series_csv(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A1: one pre-aggregated series CSV with a declared schema (no
    inference); ``period_start`` normalised to a date. A missing file fails."""
    fname, schema = SERIES_FILES[name]
    df = spark.read.schema(schema).option("header", True).csv(os.path.join(directory, fname))
    return df.withColumn("period_start", F.to_date(F.substring("period_start", 1, 10)))


def write_posting_tables(path: str, *, postings: DataFrame, links: DataFrame, skills: DataFrame) -> None:
    """The posting model as tables: postings in folders by month (``month``),
    so that a date range reads only its months; links and skills beside them."""
    monthly = postings.withColumn("month", F.trunc("date_added", "MM"))
    monthly.write.mode("overwrite").partitionBy("month").parquet(os.path.join(path, "postings"))
    links.write.mode("overwrite").parquet(os.path.join(path, "links"))
    skills.write.mode("overwrite").parquet(os.path.join(path, "skills"))


def posting_frame_between(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Postings of ``since`` <= date < ``until`` (either may be None) with the
    derived columns; whole months outside are pruned as folders."""
    p = spark.read.parquet(os.path.join(path, "postings"))
    if since is not None:
        p = p.where((F.col("month") >= F.trunc(F.lit(since), "MM")) & (F.col("date_added") >= F.lit(since)))
    if until is not None:
        p = p.where((F.col("month") < F.lit(until)) & (F.col("date_added") < F.lit(until)))
    return periods.posting_frame(p)


def series_from_tables(spark: SparkSession, path: str, since=None, until=None) -> dict[str, DataFrame]:
    """The five series of a run built from postings, links and skills: one
    scan of the postings and one link join for both granularities."""
    frame = posting_frame_between(spark, path, since, until)
    links, skills = (spark.read.parquet(os.path.join(path, n)) for n in ("links", "skills"))
    freqs = {"monthly": "M", "weekly": "W-MON"}
    roles = periods.role_rollup(frame, tuple(freqs.values()))
    by_skill = periods.skill_rollup(links, frame, skills, tuple(freqs.values()), distinct=True)
    totals = periods.totals_rollup(frame, links, ("M",), distinct=True)
    out = {f"{g}_{n}": df.where(F.col("granularity") == f).drop("granularity") for g, f in freqs.items() for n, df in (("roles", roles), ("skills", by_skill))}
    return {**out, "monthly_totals": totals.drop("granularity")}


def load_series(spark: SparkSession, kind: str | None, path: str, since=None, until=None) -> dict[str, DataFrame]:
    """Series frames by source kind: file kinds read the CSV directory,
    table kinds read ready series tables under ``path``, and ``tables`` builds
    them from the posting tables there, for a date range if one is given."""
    k = (kind or "fake").strip().lower()
    if k in FILE_KINDS:
        return {n: read_series_csv(spark, path, n) for n in SERIES_FILES}
    if k == SOURCE_TABLES:
        return series_from_tables(spark, path, since, until)
    if k in TABLE_KINDS:
        return {n: spark.read.parquet(os.path.join(path, n)) for n in SERIES_FILES}
    raise ValueError(f"Unknown data source {k!r}. Use 'fake', 'database' or 'tables'.")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A4: glossary TSV -> (key, original, english, seq). Lines are in the order
    of their file's path and of their place in it (``seq`` is a struct of file,
    start of the split and row), so of several files the last one by name wins."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("seq"))
    return parse_lines(lines, "value", "seq")


def read_posting_files(spark: SparkSession, directory: str) -> DataFrame:
    """A5: posting files admitted as texts: only ``.txt``, valid UTF-8, no NUL
    byte, not empty after strip; other files get a reject reason."""
    raw = spark.read.format("binaryFile").load(directory)
    s = F.col("content").cast("string")
    name = F.lower(F.col("path"))
    reason = (
        F.when(~name.endswith(".txt"), F.lit("only .txt files are accepted"))
        .when(~F.is_valid_utf8(s), F.lit("file is not valid UTF-8"))
        .when(F.instr(s, "\u0000") > 0, F.lit("file contains NUL bytes"))
        .when(py_strip(s) == "", F.lit("file is empty"))
    )
    return raw.select("path", F.when(reason.isNull(), py_strip(s)).alias("text"), reason.alias("reject_reason"))


def read_attempt_log(spark: SparkSession, path: str) -> DataFrame:
    """The NDJSON attempt log with its declared schema."""
    return spark.read.schema(ATTEMPT_LOG_SCHEMA).json(path).withColumn(
        "timestamp", F.try_to_timestamp(F.col("timestamp")))


def read_checked_attempt_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The attempt log, and its damaged lines apart: (records, quarantine).

    A line is damaged if it is no JSON object or a value has another type than
    the schema says. Quarantine rows carry the line, its file, its number (from
    1) and the byte offset at which it starts, found by reading the damaged
    files, and only those, a second time as whole files."""
    schema = T.StructType([*ATTEMPT_LOG_SCHEMA.fields, T.StructField("_damaged", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    parsed = lines.select("file", "value", F.from_json("value", schema, options).alias("r"))
    bad = F.col("r").isNull() | F.col("r._damaged").isNotNull()
    records = parsed.where(~bad).select(*[f"r.{f.name}" for f in ATTEMPT_LOG_SCHEMA.fields]).withColumn("timestamp", F.try_to_timestamp(F.col("timestamp")))
    damaged = parsed.where(bad).select("file", "value")
    whole = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("content").cast("string").alias("text"))
    placed = whole.join(damaged.select("file").distinct(), "file", "left_semi").select("file", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    start = F.coalesce(F.sum(F.octet_length("value") + 1).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("line_offset", start).where(F.trim("value") != "").withColumn("r", F.from_json("value", schema, options)).where(bad)
    return records, placed.select("file", (F.col("pos") + 1).alias("line_number"), "line_offset", F.col("value").alias("line"))


def write_attempt_log(records: DataFrame, path: str) -> None:
    """Append attempt records as JSON lines."""
    records.write.mode("append").json(path)


def write_period_series(frames: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """Period aggregates per name; CSV with a header (or parquet)."""
    for name, df in frames.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(os.path.join(path, SERIES_FILES.get(name, (name,))[0]))
        else:
            w.parquet(os.path.join(path, name))
