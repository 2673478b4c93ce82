"""Forecast run store and result reports.

Runs and results are tables; results are partitioned by ``run_id`` on disk
so that a run read (A7, F2) prunes to one partition."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.dates import iso_date_prefix
from marketlens.functions.numeric import finite_or_null, round_half_even, scrub_struct

# Preview limits and the report's empty marker.
RECENT_RUNS_LIMIT = 10
RESULTS_LIMIT = 500
EMPTY_MARK = "—"


def normalize_results(results: DataFrame, run_id: int) -> DataFrame:
    """Result rows as stored: period parsed from its first 10 characters,
    NaN/Inf values -> NULL (B20, and B21 inside the metrics), missing horizon
    -> 0."""
    cols = results.columns
    metrics = (scrub_struct(F.col("metrics"), results.schema["metrics"].dataType)
               if "metrics" in cols else F.lit(None).cast("string"))
    return results.select(
        F.lit(int(run_id)).cast("long").alias("run_id"),
        "model_name", "target_type", "target_key",
        F.coalesce(F.col("horizon_months"), F.lit(0)).cast("int").alias("horizon_months"),
        iso_date_prefix("period_start").alias("period_start"),
        finite_or_null("predicted_value").alias("predicted_value"),
        metrics.alias("metrics"),
    )


RUN_SCHEMA = ("id long, created_at timestamp_ntz, data_source string, training_window_months int, horizons array<int>, "
              "models_requested array<string>, status string, meta string, notes string")


def _write_run_part(df: DataFrame, path: str, run_id: int) -> None:
    """Replace one run's folder: a retry overwrites what the first try left,
    also with fewer or no rows; other runs are not touched."""
    df.drop("run_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={int(run_id)}")


def run_row(spark: SparkSession, *, run_id: int, created_at, data_source: str, window: int, horizons, models, status: str,
            notes: str | None = None, meta: dict | None = None) -> DataFrame:
    return spark.createDataFrame(
        [(int(run_id), created_at, data_source, int(window), [int(h) for h in horizons], list(models), status,
          None if meta is None else json.dumps(meta, default=str), notes)], RUN_SCHEMA)


def save_run(results: DataFrame, runs_path: str, results_path: str, *, run_id: int, created_at, data_source: str,
             window: int, horizons, models, status: str, notes: str | None = None, meta: dict | None = None) -> None:
    """One run row (``meta`` as JSON) and its result rows, each in the run's
    own folder. The run row is written last, so a run that is listed is whole;
    saving a run again changes nothing."""
    _write_run_part(normalize_results(results, run_id), results_path, run_id)
    _write_run_part(run_row(results.sparkSession, run_id=run_id, created_at=created_at, data_source=data_source, window=window, horizons=horizons,
                            models=models, status=status, notes=notes, meta=meta), runs_path, run_id)


def save_outcome(outcome, base_path: str, *, run_id: int, created_at, notes: str | None = None) -> dict[str, str]:
    """I11 to the end: results, errors and holdout metrics of a run as tables
    under ``base_path`` and its summary as the run row's ``meta`` (counts,
    shortlists, parameters, seconds per model). The summary row and the two
    shortlists (top-k rows) are what reaches the driver. Returns the paths."""
    paths = {n: f"{base_path.rstrip('/')}/{n}" for n in ("runs", "results", "errors", "metrics")}
    _write_run_part(normalize_results(outcome.results, run_id), paths["results"], run_id)
    _write_run_part(outcome.errors, paths["errors"], run_id)
    _write_run_part(outcome.metrics, paths["metrics"], run_id)
    spark = outcome.results.sparkSession
    stored = lambda n: spark.read.parquet(f"{paths[n]}/run_id={int(run_id)}")
    summary = outcome.summarise(stored("results"), stored("errors")).first().asDict(recursive=True)
    meta = {**summary, "roles": [r[0] for r in outcome.role_keys.collect()], "skills": [r[0] for r in outcome.skill_keys.collect()],
            "top_k": outcome.top_k, "model_timings_seconds": outcome.seconds}
    _write_run_part(run_row(spark, run_id=run_id, created_at=created_at, data_source=summary["data_source"], window=summary["training_window_months"],
                            horizons=summary["horizons"], models=summary["models"], status=summary["status"], notes=notes, meta=meta), paths["runs"], run_id)
    return paths


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    """A7."""
    return runs.where(F.col("id") == int(run_id))


def recent_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """newest runs first; the first ``limit`` of them if given."""
    return _first(runs.orderBy(F.desc("created_at"), F.desc("id")), limit)


def result_order() -> list[Column]:
    return [F.asc("model_name"), F.asc("target_type"), F.desc_nulls_last("predicted_value"),
            F.asc("horizon_months"), F.asc("target_key")]


def list_results(results: DataFrame, run_id: int, limit: int | None = None) -> DataFrame:
    """a run's rows by model, type, value desc (NULLs last, Q18),
    horizon, key; the first ``limit`` rows if given."""
    return _first(results.where(F.col("run_id") == int(run_id)).orderBy(*result_order()), limit)


def latest_run_results(runs: DataFrame, results: DataFrame, limit: int | None = None) -> DataFrame:
    """preview of the newest run (semi-join to a one-row frame)."""
    newest = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(1).select(F.col("id").alias("run_id"))
    rows = results.join(F.broadcast(newest), "run_id", "left_semi").orderBy(*result_order())
    return _first(rows, limit)


def delete_run(runs: DataFrame, results: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """H7: a run and its results go together."""
    return runs.where(F.col("id") != int(run_id)), results.where(F.col("run_id") != int(run_id))


def write_ranges(df: DataFrame, path: str, id_col: str = "id", width: int = 1 << 20) -> None:
    """Store a table in folders of ``width`` consecutive ids (``id_range``)."""
    ranged = df.withColumn("id_range", F.floor(F.col(id_col) / width).cast("long"))
    ranged.write.mode("overwrite").partitionBy("id_range").parquet(path)


def rewrite_ranges(spark: SparkSession, path: str, touched: DataFrame, change, *, staging: str, id_col: str = "id", width: int = 1 << 20) -> None:
    """H4 / H6 / H7 on a table of ``write_ranges``: ``change`` (frame -> frame)
    is applied to the folders that hold an id of ``touched`` (column
    ``id_col``), and only those are read and written. The new rows are staged in
    full first, so nothing is read from a folder that is being replaced, and a
    lost executor or a retry finds either the old or the new rows of a range.
    Ranges that lose all rows are left empty."""
    table = spark.read.parquet(path)
    ranges = touched.select(F.floor(F.col(id_col) / width).cast("long").alias("id_range")).where("id_range is not null").distinct()
    # as many numbers as folders are rewritten; folders are what bounds them
    hit = sorted({r[0] for r in ranges.join(table.select("id_range").distinct(), "id_range", "left_semi").collect()})
    if not hit:
        return
    old = table.where(F.col("id_range").isin(hit)).drop("id_range")
    change(old).withColumn("id_range", F.floor(F.col(id_col) / width).cast("long")).write.mode("overwrite").parquet(staging)
    new = spark.read.parquet(staging)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_range").parquet(path)
    left = {r[0] for r in new.select("id_range").distinct().collect()}
    for gone in (r for r in hit if r not in left):
        new.limit(0).drop("id_range").write.mode("overwrite").parquet(f"{path.rstrip('/')}/id_range={gone}")


def format_value(target_type, value) -> Column:
    """NULL -> em dash; salary targets -> whole number; values within
    1e-6 of an integer -> that integer; else two decimals."""
    t = F.col(target_type) if isinstance(target_type, str) else target_type
    v = F.col(value) if isinstance(value, str) else value
    whole = F.bround(v, 0).cast("long").cast("string")
    return (
        F.when(v.isNull(), F.lit(EMPTY_MARK))
        .when(F.contains(F.coalesce(t, F.lit("")), F.lit("salary")), whole)
        .when(F.abs(v - F.bround(v, 0)) < 1e-6, whole)
        .otherwise(F.format_string("%.2f", round_half_even(v, 2)))
    )


def period_text(col) -> Column:
    """ISO date (10 characters) or em dash."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.substring(c.cast("string"), 1, 10), F.lit(EMPTY_MARK))


def report_table(results: DataFrame, data_source: str | None = None) -> DataFrame:
    """A9 + F3: report rows grouped by run and model, ordered inside the model by
    value desc (NULL last), horizon, type, key; formatted cells; the report
    kind from the data source (database / db -> database, else fake)."""
    kind = (data_source or "fake").strip().lower()
    kind = "database" if kind in ("database", "db") else "fake"
    w = Window.partitionBy(*[c for c in ("run_id",) if c in results.columns], "model_name").orderBy(F.desc_nulls_last("predicted_value"), F.asc("horizon_months"),
                                                 F.asc("target_type"), F.asc("target_key"))
    return results.select(
        F.lit(kind).alias("report"),
        F.coalesce(F.col("model_name"), F.lit("unknown")).alias("model_name"),
        F.row_number().over(w).alias("row_in_model"),
        F.coalesce(F.col("target_type"), F.lit(EMPTY_MARK)).alias("type"),
        F.coalesce(F.col("target_key"), F.lit(EMPTY_MARK)).alias("target"),
        F.coalesce(F.col("horizon_months").cast("string"), F.lit(EMPTY_MARK)).alias("horizon"),
        period_text("period_start").alias("period"),
        format_value("target_type", "predicted_value").alias("value"),
    )


def report_header(runs: DataFrame) -> DataFrame:
    """The facts above a run's report, one row per run, as text: run id,
    status, source, window, horizons and models (an em dash where missing)."""
    text = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(EMPTY_MARK))
    meta = lambda name: F.get_json_object("meta", f"$.{name}")
    return runs.select(
        F.col("id").alias("run_id"), text(F.col("status")).alias("status"), text(F.col("data_source")).alias("data_source"),
        text(F.col("training_window_months").cast("string")).alias("window"), text(F.array_join(F.transform("horizons", lambda h: h.cast("string")), ", ")).alias("horizons"),
        text(F.array_join("models_requested", ", ")).alias("models"), text(meta("n_results")).alias("n_results"), text(meta("error_count")).alias("error_count"),
        F.map_keys(F.from_json(meta("model_timings_seconds"), "map<string,double>")).alias("timed_models"))
