"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from marketlens.plans import queries, queries_forecast, queries_ingest, queries_series, queries_store  # noqa: F401
from marketlens.plans.registry import ORACLE, QUERIES


def all_queries():
    return QUERIES


def all_oracle():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}


def flagship(spark, sf_dir):
    return QUERIES["baseline_report"](spark, sf_dir)
