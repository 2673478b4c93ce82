import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import analysis, periods


def test_top_companies_excludes_blank(spark):
    rows = [("Acme",), ("Acme",), ("Beta",), (None,), ("",), ("  ",), ("   ",)]
    df = spark.createDataFrame(rows, "company_name string")
    got = [tuple(r) for r in analysis.top_labels(df, "company_name", 10).collect()]
    assert got == [("Acme", 2), ("Beta", 1)]


def test_top_roles_limit(spark):
    df = spark.createDataFrame([(x,) for x in "ABCABA"], "role_title_en string")
    got = [tuple(r) for r in analysis.top_labels(df, "role_title_en", 2).collect()]
    assert got == [("A", 3), ("B", 2)]


def test_salary_summary_null_handling(spark):
    df = spark.createDataFrame([(1000.0, 2000.0), (3000.0, None), (None, 4000.0), (None, None)], "salary_min double, salary_max double")
    r = analysis.salary_summary(df).collect()[0]
    assert (r.min_salary_min, r.avg_salary_min, r.avg_salary_min_count) == (1000.0, 2000.0, 2)
    assert (r.avg_salary_max, r.avg_salary_max_count, r.max_salary_max) == (3000.0, 2, 4000.0)


def test_top_skills(spark):
    skills = spark.createDataFrame([(1, "python", "Python", "Python"), (2, "sql", "SQL", None)],
                                   "id long, name string, display_name string, display_name_en string")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (1, 2)], "posting_id long, skill_id long")
    got = [tuple(r) for r in analysis.top_skills(links, skills, 10).collect()]
    assert got == [("Python", 3), ("SQL", 1)]


def _postings(spark):
    return spark.createDataFrame(
        [(1, dt.date(2024, 1, 10), "Data Engineer", "Data Engineer", 1000.0, 2000.0),
         (2, dt.date(2024, 1, 20), "Data Engineer", "Data Engineer", None, 3000.0),
         (3, dt.date(2024, 2, 5), "ML Engineer", "ML Engineer", None, None)],
        "id long, date_added date, role_title string, role_title_en string, salary_min double, salary_max double")


def test_monthly_role_and_skill_series(spark):
    f = periods.posting_frame(_postings(spark))
    roles = {(r.period_start, r.role_title_en): r for r in periods.role_series(f, "M").collect()}
    de = roles[(dt.date(2024, 1, 1), "Data Engineer")]
    assert de.posting_count == 2 and de.avg_salary == 2250.0 and de.avg_salary_min == 1000.0
    skills = spark.createDataFrame([(1, "python", "Python", "Python")], "id long, name string, display_name string, display_name_en string")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "posting_id long, skill_id long")
    sk = periods.skill_series(links, f, skills, "M").collect()
    assert sum(r.posting_count for r in sk) == 3
    tot = {r.period_start: r for r in periods.period_totals(f, periods.role_series(f, "M"), periods.skill_series(links, f, skills, "M")).collect()}
    assert tot[dt.date(2024, 1, 1)].total_postings == 2 and tot[dt.date(2024, 1, 1)].total_skill_mentions == 2
    m = periods.manifest(f).collect()[0]
    assert m.n_postings == 3 and m.date_min == dt.date(2024, 1, 10)


def test_empty_source(spark):
    empty = spark.createDataFrame([], "id long, date_added date, role_title string, role_title_en string, salary_min double, salary_max double")
    f = periods.posting_frame(empty)
    assert periods.role_series(f).count() == 0
    assert periods.top_keys_recent(periods.role_series(f), "role_title_en").count() == 0
    m = periods.manifest(f).collect()[0]
    assert m.n_postings == 0 and m.date_min is None


def test_rank_top_keys(spark):
    df = spark.createDataFrame(list(zip("ABACBA", [1.0, 1.0, 1.0, 5.0, 1.0, 1.0])), "k string, v double")
    assert [r.k for r in periods.rank_top_keys(df, "k", "v", 2).collect()] == ["C", "A"]


def test_last_periods(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1), "a") for m in (1, 2, 3, 3, 4)], "period_start date, k string")
    got = sorted(r.period_start.month for r in periods.last_periods(df, 2).collect())
    assert got == [3, 3, 4]
    assert periods.last_periods(df, 0).count() == 5 and periods.last_periods(df, 10).count() == 5
    assert periods.weekly_window(24) == 120 and periods.weekly_window(60) == 200


def test_rollup_matches_single_granularity(spark):
    f = periods.posting_frame(_postings(spark))
    roll = periods.role_rollup(f).where(F.col("granularity") == "W-MON").drop("granularity")
    single = periods.role_series(f, "W-MON")
    assert sorted(map(tuple, roll.collect())) == sorted(map(tuple, single.select(*roll.columns).collect()))


def test_run_analysis_subset(spark):
    postings = spark.createDataFrame([("Acme", "A", 1.0, 2.0), ("Beta", "A", None, 4.0)],
                                     "company_name string, role_title_en string, salary_min double, salary_max double")
    skills = spark.createDataFrame([(1, "python", "Python", "Python")], "id long, name string, display_name string, display_name_en string")
    links = spark.createDataFrame([(1, 1)], "posting_id long, skill_id long")
    out = analysis.run_analysis(postings, links, skills, ["top_roles", "salary_summary", "nope"], 5)
    assert set(out) == {"top_roles", "salary_summary"}
    assert [tuple(r) for r in out["top_roles"].collect()] == [("A", 2)]


def test_skill_rollup_matches_single_granularity(spark):
    f = periods.posting_frame(_postings(spark))
    skills = spark.createDataFrame([(1, "python", "Python", "Python"), (2, "sql", None, " ")],
                                   "id long, name string, display_name string, display_name_en string")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (3, 1)], "posting_id long, skill_id long")
    for g in ("D", "W-MON", "M"):
        roll = periods.skill_rollup(links, f, skills).where(F.col("granularity") == g).drop("granularity")
        single = periods.skill_series(links, f, skills, g)
        assert sorted(map(tuple, roll.collect())) == sorted(map(tuple, single.select(*roll.columns).collect()))
    labels = {r.display_name_en for r in periods.skill_series(links, f, skills, "M").collect()}
    assert labels == {"Python", "unknown"}  # B10: blank English label -> 'unknown' (no fallback past a non-NULL blank)


def test_skill_counts_are_dealt_into_the_tasks_asked_for(spark):
    f = periods.posting_frame(_postings(spark))
    skills = spark.createDataFrame([(1, "python", "Python", "Python"), (2, "sql", None, " "), (2, "sql", "SQL", "SQL")],
                                   "id long, name string, display_name string, display_name_en string")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (3, 1), (3, 1), (None, 1), (1, None)], "posting_id long, skill_id long")
    for distinct in (False, True):
        plain = periods.skill_rollup(links, f, skills, distinct=distinct)
        dealt = periods.skill_rollup(links, f, skills, distinct=distinct, parts=5)
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, periods.skill_series(links, f, skills, parts=5).collect())) == sorted(map(tuple, periods.skill_series(links, f, skills).collect()))
    assert periods.skill_day_counts(links, f, parts=5).rdd.getNumPartitions() == 5


def test_tasks_for_links_grow_with_their_rows(spark, tmpdir_path, monkeypatch):
    from marketlens.plans import bindings

    li = spark.range(100).selectExpr("id div 4 as l_orderkey", "id % 7 as l_partkey")
    li.union(li).write.parquet(f"{tmpdir_path}/lineitem.parquet")
    assert bindings.link_parts(spark, tmpdir_path) is None  # few rows: Spark's own choice
    monkeypatch.setattr(bindings, "TASK_ROWS", 20)
    assert bindings.link_parts(spark, tmpdir_path) == 10
    for links, n in ((bindings.links(spark, tmpdir_path), 100), (bindings.link_rows(spark, tmpdir_path), 200)):
        assert links.rdd.getNumPartitions() == 10 and links.count() == n
