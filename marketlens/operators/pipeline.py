"""End-to-end ingest batch (J5) with a pluggable extractor (L3), posting
views with label fallbacks (A14) and user per-series models (L2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.labels import saved_title_en
from marketlens.operators import extraction, ingest, skills

ATTEMPT_SCHEMA = "posting_id long, attempt int, tier string, succeeded boolean, error_category string, payload string, model string, message string"


def extractor_from_pandas(fn: Callable[[pd.DataFrame], pd.DataFrame]):
    """L3: wrap a user extractor ``fn(texts: DataFrame[posting_id, text]) ->
    DataFrame[ATTEMPT_SCHEMA columns]`` as a ``mapInPandas`` stage. The
    extractor sees Arrow batches of new texts only, never the whole table."""

    def stage(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield fn(b)

        return texts.mapInPandas(run, ATTEMPT_SCHEMA)

    return stage


@dataclass
class IngestResult:
    outcomes: DataFrame   # per text: created / duplicate_in_batch / existing / rejected / extraction_failed / invalid
    postings: DataFrame   # new posting rows
    skills: DataFrame     # skill dimension after the upsert
    links: DataFrame      # link table after the rebuild


def ingest_texts(batch: DataFrame, *, store_postings: DataFrame, store_skills: DataFrame, store_links: DataFrame,
                 extract: Callable[[DataFrame], DataFrame], glossary: DataFrame, run_date, id_col: str = "doc_id",
                 text_col: str = "text") -> IngestResult:
    """Admit (B18) -> dedupe in batch and against the store
    -> extract the new texts only (L3, J2) -> validate (J1) -> labels and
    fingerprint (J4) -> skill upsert and links (H2, H3)."""
    outcomes = ingest.ingest_batch(batch, store_postings, id_col=id_col, text_col=text_col).persist()
    new = batch.join(outcomes.where(F.col("status") == ingest.CREATED).select(id_col, "content_hash"), id_col)
    attempts = extract(new.select(F.col(id_col).alias("posting_id"), F.col(text_col).alias("text")))
    chosen = extraction.first_usable_attempt(attempts)
    valid = extraction.validate_payloads(chosen.where(F.col("payload").isNotNull()).select(
        F.col("posting_id").alias("payload_id"), "payload")).persist()
    accepted = extraction.resolve_labels(valid.where("accepted"), glossary)
    rows = accepted.join(new.select(F.col(id_col).alias("payload_id"), "content_hash", F.col(text_col).alias("raw_text")), "payload_id")
    postings = rows.select(
        F.col("payload_id").alias("id"), "company_name", "role_title",
        saved_title_en("role_title_en", "role_title").alias("role_title_en"),
        "responsibilities", "requirements", "application_deadline", "salary_min", "salary_max", "salary_currency",
        "location", "country", "city", "work_type", "has_nondiscrimination_disclaimer",
        F.lit(run_date).cast("date").alias("date_added"), "raw_text", "content_hash", "skills", "skills_en",
    )
    mentions = skills.skill_mentions(postings)
    sk = skills.upsert_skills(store_skills, mentions)
    links = skills.rebuild_links(store_links, postings, sk)
    status = (
        F.when(F.col("status") != ingest.CREATED, F.col("status"))
        .when(F.col("_payload_missing"), F.lit("extraction_failed"))
        .when(~F.col("accepted"), F.lit("invalid"))
        .otherwise(F.col("status"))
    )
    detail = chosen.select(F.col("posting_id").alias(id_col), F.col("payload").isNull().alias("_payload_missing"), F.col("detail"))
    verdict = valid.select(F.col("payload_id").alias(id_col), "accepted", F.col("reason").alias("validation_reason"))
    out = outcomes.join(detail, id_col, "left").join(verdict, id_col, "left").select(
        id_col, "content_hash", status.alias("status"), "posting_ref", "reject_reason", "detail", "validation_reason")
    return IngestResult(out, postings, sk, links)


def posting_view(postings: DataFrame, links: DataFrame, skills_df: DataFrame) -> DataFrame:
    """Postings with the title fallback (B30) and their skill labels
    (English label, else display label, else name), collected per posting."""
    labels = links.join(skills_df.select(F.col("id").alias("skill_id"),
                                         F.coalesce(F.nullif("display_name_en", F.lit("")), F.nullif("display_name", F.lit("")), "name").alias("label")),
                        "skill_id")
    per = labels.groupBy("posting_id").agg(F.array_sort(F.collect_set("label")).alias("skill_labels"))
    return postings.join(per, postings["id"] == per["posting_id"], "left").select(
        *[F.col(c) for c in postings.columns if c != "role_title_en"],
        saved_title_en("role_title_en", "role_title").alias("role_title_en"),
        F.coalesce("skill_labels", F.array().cast("array<string>")).alias("skill_labels"))


def posting_lists(postings: DataFrame, links: DataFrame, skills_df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Postings with two parallel lists of their skills, ``skills`` (display
    label, else name) and ``skills_en`` (English label, else those), in link
    order: by ``order_col`` of the links, then skill id. A posting's list is
    bounded by its own links; the dimension meets the links before they are
    collected, so no list is exploded again."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    dim = skills_df.select(F.col("id").alias("skill_id"), F.coalesce(filled("display_name"), F.col("name")).alias("s"),
                           F.coalesce(filled("display_name_en"), filled("display_name"), F.col("name")).alias("e"))
    place = F.col(order_col) if order_col else F.lit(0)
    own = links.groupBy("posting_id", "skill_id").agg(F.min(place).alias("o")).join(dim, "skill_id")
    per = own.groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("o", "skill_id", "s", "e"))).alias("l"))
    none = F.array().cast("array<string>")
    joined = postings.join(per, postings["id"] == per["posting_id"], "left")
    return joined.select(*[F.col(c) for c in postings.columns if c not in ("role_title_en", "skills", "skills_en")],
                         saved_title_en("role_title_en", "role_title").alias("role_title_en"),
                         F.coalesce(F.transform("l", lambda x: x["s"]), none).alias("skills"), F.coalesce(F.transform("l", lambda x: x["e"]), none).alias("skills_en"))


def posting_by_id(view: DataFrame, posting_id: int) -> DataFrame:
    return view.where(F.col("id") == int(posting_id))


def per_series_model(name: str, fn: Callable[[pd.DataFrame, int], pd.DataFrame], min_history: int = 0):
    """L2: wrap a user's per-series Python model ``fn(series_pdf, horizon) ->
    pdf[horizon_months, predicted_value]`` as a forecaster. Each series is one
    ``applyInPandas`` group; a series holds at most the window's months.
    Series of fewer than ``min_history`` months give an error row."""
    from marketlens.operators.forecast import ModelOutput, _gate  # local import: avoid a cycle

    def model(series: DataFrame, horizon: int) -> ModelOutput:
        ok, errs = _gate(series, name, min_history)

        def apply(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            out = fn(pdf, horizon)
            last = pd.Timestamp(pdf["month"].max())
            out = out.assign(target_type=pdf["target_type"].iloc[0], target_key=pdf["target_key"].iloc[0],
                             period_start=[(last + pd.DateOffset(months=int(k))).date() for k in out["horizon_months"]])
            return out[["target_type", "target_key", "horizon_months", "period_start", "predicted_value"]]

        pts = ok.groupBy("target_type", "target_key").applyInPandas(
            apply, "target_type string, target_key string, horizon_months int, period_start date, predicted_value double")
        pts = pts.select(F.lit(name).alias("model_name"), "*")
        metrics = series.sparkSession.createDataFrame([], "model_name string, target_type string, target_key string, mae double, rmse double")
        return ModelOutput(pts, metrics, errs.withColumn("model_name", F.lit(name)))

    return model
