import datetime as dt
import hashlib
import json
import os

import pandas as pd
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import forecast, pipeline


def _extractor(pdf: pd.DataFrame) -> pd.DataFrame:
    """Test extractor: a payload table keyed by text; the first model fails."""
    rows = []
    for pid, text in zip(pdf["posting_id"], pdf["text"]):
        rows.append((pid, 0, "primary", False, "api_error", None, "m1", "HTTP 500"))
        payload = {"role_title": text.strip().split()[0], "skills": ["Python", "Datenbank"], "skills_en": ["Python", "Database"]}
        if "bad" in text:
            payload = {"role_title": ""}
        rows.append((pid, 1, "primary", True, None, json.dumps(payload), "m2", None))
    return pd.DataFrame(rows, columns=["posting_id", "attempt", "tier", "succeeded", "error_category", "payload", "model", "message"])


def test_ingest_texts_end_to_end(spark):
    batch = spark.createDataFrame([(1, "Entwickler in Berlin"), (2, " Entwickler in Berlin "), (3, "Stored text"), (4, "bad text")],
                                  "doc_id long, text string")
    store = spark.createDataFrame([(9, hashlib.sha256(b"Stored text").hexdigest())], "id long, content_hash string")
    sk = spark.createDataFrame([(7, "database", "Datenbank", "Database")], "id long, name string, display_name string, display_name_en string")
    links = spark.createDataFrame([(9, 7)], "posting_id long, skill_id long")
    g = spark.createDataFrame([("entwickler", "Developer")], "key string, english string")
    res = pipeline.ingest_texts(batch, store_postings=store, store_skills=sk, store_links=links,
                                extract=pipeline.extractor_from_pandas(_extractor), glossary=g, run_date=dt.date(2024, 3, 1))
    out = {r.doc_id: r for r in res.outcomes.collect()}
    assert out[1].status == "created" and out[2].status == "duplicate_in_batch" and out[3].status == "existing"
    assert out[4].status == "invalid" and "role_title" in out[4].validation_reason
    p = res.postings.collect()
    assert len(p) == 1 and p[0].role_title_en == "Developer" and p[0].date_added == dt.date(2024, 3, 1)
    names = {r.name: r.id for r in res.skills.collect()}
    assert names["database"] == 7 and "python" in names
    assert sorted(r.skill_id for r in res.links.where("posting_id = 1").collect()) == sorted([7, names["python"]])
    view = pipeline.posting_view(res.postings.drop("skills", "skills_en"), res.links, res.skills)
    assert pipeline.posting_by_id(view, 1).collect()[0].skill_labels == ["Database", "Python"]


def test_user_per_series_model(spark):
    rows = [("role", "a", dt.date(2023, 1, 1) + pd.DateOffset(months=i), float(i), i, 12, 12) for i in range(12)]
    s = spark.createDataFrame([(a, b, c.date() if hasattr(c, "date") else c, d, e, f, g) for a, b, c, d, e, f, g in rows],
                              "target_type string, target_key string, month date, value double, t int, n int, known long")

    def naive(pdf, h):
        return pd.DataFrame({"horizon_months": list(range(1, h + 1)), "predicted_value": [float(pdf["value"].iloc[-1])] * h})

    out = pipeline.per_series_model("naive", naive)(s, 3).points.collect()
    assert [(r.horizon_months, r.predicted_value, r.period_start) for r in sorted(out, key=lambda r: r.horizon_months)] == [
        (1, 11.0, dt.date(2024, 1, 1)), (2, 11.0, dt.date(2024, 2, 1)), (3, 11.0, dt.date(2024, 3, 1))]


def test_schema_contract(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "x", 3)], "period_start date, display_name_en string, posting_count long")
    schema.assert_schema(df, schema.CONTRACTS["skills"])
    try:
        schema.assert_schema(df.drop("posting_count"), schema.CONTRACTS["skills"])
        raise AssertionError
    except ValueError as e:
        assert "posting_count" in str(e)
    c = schema.conform(df.drop("posting_count"), schema.CONTRACTS["skills"]).collect()[0]
    assert c.posting_count is None
    assert schema.empty(spark, "roles").count() == 0


def test_registered_user_model_runs_in_a_run(spark):
    from marketlens.operators import run

    def last_value(pdf, h):
        return pd.DataFrame({"horizon_months": list(range(1, h + 1)), "predicted_value": [float(pdf["value"].iloc[-1])] * h})

    forecast.register_forecaster("naive_last", pipeline.per_series_model("naive_last", last_value))
    months = [(pd.Timestamp("2023-01-01") + pd.DateOffset(months=i)).date() for i in range(12)]
    mr = spark.createDataFrame([(m, "A", float(i), 100.0 + i) for i, m in enumerate(months)],
                               "period_start date, role_title_en string, posting_count double, avg_salary double")
    ms = spark.createDataFrame([(m, "py", 2.0) for m in months], "period_start date, display_name_en string, posting_count double")
    out = run.run_forecast(monthly_roles=mr, weekly_roles=mr, monthly_skills=ms, weekly_skills=ms,
                           training_window_months=12, horizons=[3], models=["naive_last"], top_k=5)
    got = {(r.target_type, r.target_key): r.predicted_value for r in out.results.collect()}
    assert got == {("role", "A"): 11.0, ("salary_role", "A"): 111.0, ("skill", "py"): 2.0}
