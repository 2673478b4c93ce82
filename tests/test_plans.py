"""Plan properties the scale design relies on, read from ``explain()``."""

import contextlib
import io
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _plan(df, mode=None):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode) if mode else df.explain()
    return buf.getvalue()


def test_scans_read_only_needed_columns(spark):
    import __spark_entry__ as E

    plan = _plan(E.queries()["skills_monthly"](spark, SF), "formatted")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_company_counts_aggregate_before_the_join(spark):
    import __spark_entry__ as E

    lines = _plan(E.queries()["top_companies"](spark, SF)).splitlines()
    join = next(i for i, l in enumerate(lines) if "Join" in l)
    below = "\n".join(lines[join:])
    assert "partial_count" in below and "o_custkey" in below  # orders reduced per customer key under the join


def test_models_add_no_shuffle_after_the_series_partitioning(spark):
    from marketlens.operators import forecast
    from marketlens.plans.queries_forecast import targets

    t = targets(spark, SF)
    t.count()
    for model in forecast.MODEL_KEYS:
        lines = _plan(forecast.forecaster(model)(t, 12).points).splitlines()
        start = next(i for i, l in enumerate(lines) if "InMemoryRelation" in l)
        end = next(i for i, l in enumerate(lines) if i > start and "InMemoryTableScan" in l and "known" in l)
        section = lines[start:end]
        assert any("ObjectHashAggregate" in l or "SortAggregate" in l for l in section)
        assert not any("Exchange" in l for l in section), model


def test_links_left_after_deletion_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    import __spark_entry__ as E
    from marketlens.plans import bindings

    few = {tuple(r) for r in E.queries()["delete_postings"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(bindings, "TASK_ROWS", rows // 40)
    parts = bindings.link_parts(spark, SF)
    assert parts >= 40
    dealt = E.queries()["delete_postings"](spark, SF)
    assert {tuple(r) for r in dealt.collect()} == few
    for name in ("delete_postings", "skills_monthly", "totals_monthly", "top_skills_recent"):
        assert f", {parts}), REPARTITION_BY_NUM" in _plan(E.queries()[name](spark, SF)), name


def test_series_of_a_run_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    from marketlens.plans import bindings
    from marketlens.plans.queries_series import windowed

    few = {tuple(r) for r in windowed(spark, SF)["monthly_skills"].collect()}
    spark.catalog.clearCache()
    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    parts = bindings.link_parts(spark, SF)
    dealt = windowed(spark, SF)["monthly_skills"]
    assert {tuple(r) for r in dealt.collect()} == few
    assert _plan(dealt).count(f", {parts}), REPARTITION_BY_NUM") >= 2  # by posting, then by day and skill
    spark.catalog.clearCache()


def test_payload_fields_are_taken_in_one_walk(spark):
    import re

    from marketlens.operators import extraction

    p = spark.createDataFrame([(1, '{"role_title": "E"}')], "payload_id long, payload string")
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        codegen = _plan(extraction.validate_payloads(p), "codegen")
        plan = _plan(extraction.validate_payloads(p))
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    assert not [f for f in extraction.ALL_FIELDS if f"$.{f}" in plan]  # no walk per field
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", codegen)]
    assert sizes and max(sizes) < 8000  # longer methods are never compiled by the JVM


def test_filters_do_not_strip_again(spark):
    """A filter on a stripped field must not carry the strip below."""
    from marketlens.operators import glossary, skills

    one = spark.range(1).selectExpr("id as seq", "concat('a', id) as original", "concat(' b', id) as english", "concat('a', id, '\t', 'b') as value")
    lists = spark.range(1).selectExpr("id", "array(concat('a', id)) as skills", "array(concat('b', id)) as skills_en", "'t' as role_title", "'u' as role_title_en")
    none = one.limit(0).selectExpr("original as key", "original", "english")
    frames = {"parse_lines": glossary.parse_lines(one), "candidate_pairs": glossary.candidate_pairs(lists), "merge": glossary.merge(none, one)[0],
              "skill_mentions": skills.skill_mentions(lists)}
    for name, df in frames.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ")
        for part in plan.split("Filter ")[1:]:
            condition = part.split(" +- ")[0]
            assert "trim(" not in condition, (name, condition)


def test_payloads_are_built_in_tasks_of_bounded_rows(spark, monkeypatch):
    from marketlens.plans import bindings

    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    parts = bindings.link_parts(spark, SF)
    assert parts and f", {parts}), REPARTITION_BY_NUM" in _plan(bindings.payloads(spark, SF))
