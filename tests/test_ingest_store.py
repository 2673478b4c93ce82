import datetime as dt
import hashlib
import os

from pyspark.sql import functions as F

from marketlens.operators import glossary, ingest, review, skills, store
from marketlens.sources import files


def test_ingest_statuses(spark):
    batch = spark.createDataFrame([(1, "  hello world  "), (2, "hello world"), (3, "new text"), (4, "   "), (5, "x" * 51)],
                                  "doc_id long, text string")
    stored = spark.createDataFrame([(100, hashlib.sha256(b"new text").hexdigest())], "id long, content_hash string")
    got = {r.doc_id: r for r in ingest.ingest_batch(batch, stored, id_col="doc_id", max_chars=50).collect()}
    assert (got[1].status, got[1].posting_ref) == ("created", 1)
    assert (got[2].status, got[2].posting_ref) == ("duplicate_in_batch", 1)
    assert (got[3].status, got[3].posting_ref) == ("existing", 100)
    assert got[4].status == "rejected" and got[4].reject_reason == "text:empty"
    assert got[5].status == "rejected" and got[5].reject_reason.startswith("text:length>50")
    ok = ingest.ingest_batch(spark.createDataFrame([(1, "x" * 40)], "doc_id long, text string"), None, id_col="doc_id", max_chars=40)
    assert ok.collect()[0].status == "created"


def test_first_per_hash_is_deterministic(spark):
    df = spark.createDataFrame([(3, "h"), (1, "h"), (2, "g")], "doc_id long, content_hash string")
    got = {r.content_hash: (r.first_doc_id, r.copies) for r in ingest.first_per_hash(df, "doc_id").collect()}
    assert got == {"h": (1, 2), "g": (2, 1)}


def test_glossary_parse_and_merge(spark):
    lines = spark.createDataFrame(
        [(0, "# header"), (1, ""), (2, "Entwickler\tDeveloper"), (3, "no tab here"), (4, "Python\tpython"),
         (5, "Entwickler\tSoftware Developer"), (6, "a\tb\tc"), (7, "x" * 201 + "\ty")], "seq long, value string")
    g = {r.key: r for r in glossary.parse_lines(lines).collect()}
    assert set(g) == {"entwickler"}  # "a\tb\tc": the English side holds a tab, the row is unusable
    assert g["entwickler"].english == "Software Developer"
    pairs = spark.createDataFrame([(10, "Python", "Python"), (11, "CI/CD", "ci/cd"), (12, "Datenbank", "Database"),
                                   (13, "entwickler", "software developer"), (14, "Tab\tbad", "x")],
                                  "seq long, original string, english string")
    merged, actions = glossary.merge(g_frame(spark), pairs)
    m = {r.key: r for r in merged.collect()}
    acts = {r.key: r.action for r in actions.collect()}
    assert acts.get("datenbank") == "insert" and "entwickler" not in acts  # case-only change is no change
    assert m["entwickler"].english == "Software Developer" and m["entwickler"].original == "Entwickler"
    assert acts.get("tab\tbad") == "reject"
    assert actions.where(F.col("action").isin("insert", "update")).count() == 1


def g_frame(spark):
    return spark.createDataFrame([("entwickler", "Entwickler", "Software Developer", 5)], "key string, original string, english string, seq long")


def test_candidate_pairs(spark):
    p = spark.createDataFrame([(1, "Entwickler", "Developer", ["Datenbank", "Python"], ["Database", "python"])],
                              "id long, role_title string, role_title_en string, skills array<string>, skills_en array<string>")
    got = [(r.pos, r.original, r.english) for r in glossary.candidate_pairs(p).orderBy("pos").collect()]
    assert got == [(0, "Entwickler", "Developer"), (1, "Datenbank", "Database")]


def test_skill_upsert_first_label_kept(spark):
    store_df = spark.createDataFrame([(7, "sql", "SQL", None)], "id long, name string, display_name string, display_name_en string")
    p = spark.createDataFrame([(1, ["  Python ", "Datenbank"], ["", "SQL"]), (2, ["Python3"], ["python"])],
                              "id long, skills array<string>, skills_en array<string>")
    m = skills.skill_mentions(p)
    out = {r.name: r for r in skills.upsert_skills(store_df, m).collect()}
    assert out["python"].display_name == "Python" and out["python"].display_name_en == "Python"
    assert out["sql"].id == 7 and out["sql"].display_name == "SQL" and out["sql"].display_name_en == "SQL"
    links = spark.createDataFrame([(1, 7), (9, 7)], "posting_id long, skill_id long")
    sk = skills.upsert_skills(store_df, m)
    rebuilt = skills.rebuild_links(links, p, sk).collect()
    assert (9, 7) in [tuple(r) for r in rebuilt]
    assert len([r for r in rebuilt if r.posting_id == 1]) == 2


def test_result_order_and_scrub(spark):
    rows = spark.createDataFrame([("rf", "skill", "s", 1, 8.0), ("rf", "role", "a", 1, 12.5), ("rf", "role", "b", 1, 20.0),
                                  ("arima", "role", "c", 1, 5.0), ("rf", "role", "n", 1, float("nan"))],
                                 "model_name string, target_type string, target_key string, horizon_months int, predicted_value double")
    rows = rows.withColumn("period_start", F.lit("2024-05-01T00:00:00")).withColumn("metrics", F.struct(F.lit(float("inf")).alias("mae")))
    norm = store.normalize_results(rows, 5)
    got = [(r.model_name, r.target_key) for r in store.list_results(norm, 5).collect()]
    assert got == [("arima", "c"), ("rf", "b"), ("rf", "a"), ("rf", "n"), ("rf", "s")]
    r = norm.where("target_key = 'n'").collect()[0]
    assert r.predicted_value is None and r.metrics.mae is None and r.period_start == dt.date(2024, 5, 1)
    rep = store.report_table(norm, "db").where("model_name = 'rf'").orderBy("row_in_model").collect()
    assert [x.target for x in rep] == ["b", "a", "s", "n"] and rep[0].report == "database"


def test_run_store_roundtrip(spark, tmpdir_path):
    res = spark.createDataFrame([("arima", "role", "a", 3, "2024-01-01", 1.5)],
                                "model_name string, target_type string, target_key string, horizon_months int, period_start string, predicted_value double")
    runs_p, res_p = os.path.join(tmpdir_path, "runs"), os.path.join(tmpdir_path, "results")
    for rid, ts in ((1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 2, 1))):
        store.save_run(res, runs_p, res_p, run_id=rid, created_at=ts, data_source="database", window=24,
                       horizons=[3], models=["arima"], status="completed")
    runs, results = spark.read.parquet(runs_p), spark.read.parquet(res_p)
    assert [r.id for r in store.recent_runs(runs).collect()] == [2, 1]
    assert store.get_run(runs, 1).count() == 1
    assert {r.run_id for r in store.latest_run_results(runs, results).collect()} == {2}
    r2, s2 = store.delete_run(runs, results, 2)
    assert r2.count() == 1 and s2.where("run_id = 2").count() == 0


def test_review_corrections(spark):
    postings = spark.createDataFrame([(1, "Acme", "Dev", "Developer", 10.0, 20.0, "EUR", "onsite", False, None, None, None)],
                                     "id long, company_name string, role_title string, role_title_en string, salary_min double, "
                                     "salary_max double, salary_currency string, work_type string, has_nondiscrimination_disclaimer boolean, "
                                     "location string, country string, city string")
    feed = spark.createDataFrame([(1, " ", "Dev2", "", "5", "", "remote", True, "Berlin", "", "", "Python\n\n SQL \r\n"),
                                  (2, "x", "T", None, None, None, None, False, None, None, None, ""),
                                  (1, "x", "T", None, "abc", None, None, False, None, None, None, "")],
                                 "posting_id long, company_name string, role_title string, role_title_en string, salary_min string, "
                                 "salary_max string, work_type string, has_nondiscrimination_disclaimer boolean, location string, "
                                 "country string, city string, skills_en string")
    parsed = review.parse_feed(feed)
    out, ok, rej = review.apply_corrections(postings, parsed.limit(2))
    r = out.collect()[0]
    assert (r.company_name, r.role_title, r.role_title_en, r.salary_min, r.salary_max, r.work_type) == (None, "Dev2", "Dev2", 5.0, None, "remote")
    assert r.salary_currency == "EUR" and r.location == "Berlin"
    assert ok.collect()[0].skills == ["Python", "SQL"]
    assert [x.reason for x in rej.collect()] == ["unknown posting id"]
    assert parsed.where(F.col("feed_reason").isNotNull()).count() == 1


def test_file_sources(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "posts")
    os.makedirs(d)
    open(os.path.join(d, "a.txt"), "w").write("  Job A  ")
    open(os.path.join(d, "b.md"), "w").write("Job B")
    open(os.path.join(d, "c.txt"), "wb").write(b"\xff\xfe bad")
    open(os.path.join(d, "d.txt"), "w").write("   ")
    got = {os.path.basename(r.path): r for r in files.read_posting_files(spark, d).collect()}
    assert got["a.txt"].text == "Job A" and got["a.txt"].reject_reason is None
    assert got["b.md"].reject_reason and got["c.txt"].reject_reason and got["d.txt"].reject_reason == "file is empty"
    gpath = os.path.join(tmpdir_path, "g.tsv")
    open(gpath, "w").write("# c\nEntwickler\tDeveloper\nPython\tPython\nEntwickler\tEngineer\n")
    g = files.read_glossary(spark, gpath).collect()
    assert [(r.key, r.english) for r in g] == [("entwickler", "Engineer")]
    sdir = os.path.join(tmpdir_path, "series")
    os.makedirs(sdir)
    open(os.path.join(sdir, "monthly_roles.csv"), "w").write(
        "period_start,role_title_en,posting_count,avg_salary_min,avg_salary_max,avg_salary\n2024-01-01 00:00:00,A,3,1.0,2.0,1.5\n")
    df = files.read_series_csv(spark, sdir, "monthly_roles").collect()[0]
    assert df.period_start == dt.date(2024, 1, 1) and df.posting_count == 3
    try:
        files.load_series(spark, "nope", sdir)
        raise AssertionError
    except ValueError:
        pass
    log = os.path.join(tmpdir_path, "log")
    rec = spark.createDataFrame([("2024-01-01T00:00:00.000+00:00", "x", "openrouter", "m", "success", 12)],
                                "timestamp string, extract_id string, provider string, model string, status string, response_time_ms int")
    files.write_attempt_log(rec, log)
    back = files.read_attempt_log(spark, log).collect()[0]
    assert back.provider == "openrouter" and back.response_time_ms == 12 and back.token_usage is None


def _replay(existing, pairs):
    """Sequential replay of the merge rules (the brute-force reference)."""
    rows = {k: [o, e] for k, o, e in existing}
    for _, o, e in sorted(pairs):
        k = o.strip().lower()
        if o.strip().lower() == e.strip().lower():
            continue
        if k in rows:
            if rows[k][1].strip().lower() != e.strip().lower():
                rows[k][1] = e
        else:
            rows[k] = [o, e]
    return {k: tuple(v) for k, v in rows.items()}


def test_merge_matches_sequential_replay(spark):
    import random

    rnd = random.Random(7)
    words = ["Alpha", "alpha", "ALPHA", "Beta", "beta", "Gamma", "gamma", "Delta"]
    keys = ["Eins", "eins", "Zwei", "Drei"]
    for trial in range(4):
        existing = [("eins", "Eins", "One")] if trial % 2 else []
        pairs = [(i, rnd.choice(keys), rnd.choice(words)) for i in range(rnd.randint(3, 12))]
        ex = spark.createDataFrame(existing, "key string, original string, english string") if existing else \
            spark.createDataFrame([], "key string, original string, english string")
        ex = ex.withColumn("seq", F.lit(-1).cast("long"))
        pr = spark.createDataFrame(pairs, "seq long, original string, english string")
        merged, _ = glossary.merge(ex, pr)
        got = {r.key: (r.original, r.english) for r in merged.collect()}
        assert got == _replay(existing, pairs), (existing, pairs)


def test_series_sink_roundtrip_and_dimension_ops(spark, tmpdir_path):
    roles = spark.createDataFrame([(dt.date(2024, 1, 1), "A", 3, 1.0, 2.0, 1.5)],
                                  "period_start date, role_title_en string, posting_count long, avg_salary_min double, avg_salary_max double, avg_salary double")
    out = os.path.join(tmpdir_path, "fake")
    files.write_period_series({"monthly_roles": roles}, out)
    back = files.read_series_csv(spark, out, "monthly_roles")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in roles.collect()]
    sk = spark.createDataFrame([(1, "python", "Python", "Python"), (2, "sql", "SQL", "SQL")], "id long, name string, display_name string, display_name_en string")
    names = spark.createDataFrame([(" Python ",), ("rust",), ("",)], "name string")
    assert [r.id for r in skills.existing_for_names(sk, names).collect()] == [1]
    postings = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "posting_id long, skill_id long")
    p2, l2 = skills.delete_postings(postings, links, spark.createDataFrame([(2,)], "id long"))
    assert [r.id for r in p2.collect()] == [1] and [tuple(r) for r in l2.collect()] == [(1, 1)]
    s2, l3 = skills.delete_skills(sk, links, spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in s2.collect()] == [2] and [tuple(r) for r in l3.collect()] == [(2, 2)]
