"""Damaged logs, range rewrites, saved runs, late rows and the ranged merge."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import extraction, glossary, periods, store
from marketlens.plans import queries_ingest
from marketlens.sources import files
from marketlens.streaming import ingest


def test_damaged_lines_with_file_and_offset(spark, tmp_path):
    good = lambda i: json.dumps({"extract_id": str(i), "provider": "é", "attempt_index": i, "token_usage": {"prompt_tokens": 5}})
    for name, lines in (("a.json", [good(1), "{oops", "", good(2), '{"attempt_index": "x"}']), ("b.json", [good(3)]), ("c.json", ["[1]", good(4)])):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    records, damaged = files.read_checked_attempt_log(spark, str(tmp_path))
    assert sorted(r.extract_id for r in records.collect()) == ["1", "2", "3", "4"]
    assert records.agg(F.sum("token_usage.prompt_tokens")).first()[0] == 20
    for r in damaged.collect():
        body = (tmp_path / r.file.split("/")[-1]).read_bytes()
        assert body[r.line_offset:].split(b"\n")[0].decode() == r.line and body[:r.line_offset].count(b"\n") == r.line_number - 1
    assert {r.line for r in damaged.collect()} == {"[1]", "{oops", '{"attempt_index": "x"}'}


def test_saving_a_run_again_replaces_it(spark, tmp_path):
    runs, results = str(tmp_path / "runs"), str(tmp_path / "results")
    rows = lambda n: spark.createDataFrame([("arima", "role", f"r{i}", 3, "2024-01-01", float(i)) for i in range(n)], "model_name string, target_type string, target_key string, horizon_months int, period_start string, predicted_value double")
    save = lambda df, i: store.save_run(df, runs, results, run_id=i, created_at=dt.datetime(2024, 1, i), data_source="db", window=12, horizons=[3], models=["arima"], status="completed", meta={"top_k": 5})
    for df, i in ((rows(5), 1), (rows(4), 2), (rows(2), 1), (rows(2), 1)):
        save(df, i)
    back = {r.run_id: r.n for r in spark.read.parquet(results).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert back == {1: 2, 2: 4} and spark.read.parquet(runs).count() == 2
    save(rows(2).limit(0), 2)
    assert spark.read.parquet(results).where("run_id = 2").count() == 0
    head = store.report_header(spark.read.parquet(runs)).orderBy("run_id").first()
    assert (head.status, head.horizons, head.models, head.n_results) == ("completed", "3", "arima", "—")


def test_ranges_are_rewritten_where_touched(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", F.lit("old").alias("v"))
    store.write_ranges(df, path, width=10)
    before = {f: (tmp_path / "t" / f).stat().st_mtime_ns for f in ("id_range=0", "id_range=5")}
    touched = spark.createDataFrame([(51,), (57,), (999,), (None,)], "id long")
    change = lambda old: old.join(touched.withColumn("new", F.lit("new")), "id", "left").select("id", F.coalesce("new", "v").alias("v"))
    for k in range(2):
        store.rewrite_ranges(spark, path, touched, change, staging=str(tmp_path / f"s{k}"), width=10)
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 100 and {i for i, v in got.items() if v == "new"} == {51, 57}
    assert (tmp_path / "t" / "id_range=0").stat().st_mtime_ns == before["id_range=0"]
    gone = spark.range(20, 30)
    store.rewrite_ranges(spark, path, gone, lambda old: old.join(gone, "id", "left_anti"), staging=str(tmp_path / "s9"), width=10)
    assert spark.read.parquet(path).count() == 90
    store.rewrite_ranges(spark, path, touched.limit(0), change, staging=str(tmp_path / "none"), width=10)


def merged_by_force(existing, pairs):
    table, actions = {k: [o, e, -1] for k, o, e in existing}, []
    for seq, o, e in sorted(pairs):
        k = o.lower()
        if k not in table:
            table[k] = [o, e, seq]
            actions.append((k, seq, "insert"))
        elif table[k][1].lower() != e.lower():
            table[k][1] = e
            actions.append((k, seq, "update"))
        table[k][2] = max(table[k][2], seq)
    return {k: tuple(v) for k, v in table.items()}, sorted(actions)


def test_merge_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(glossary, "RANGE", 4)
    r = random.Random(3)
    existing = [("hot", "Hot", "one"), ("kept", "Kept", "same")]
    pairs = [(i, r.choice(["Hot", "HOT", "hot", "rare", "Rare"]), r.choice(["one", "ONE", "two", "Two", "three"])) for i in r.sample(range(400), 150)]
    ex = spark.createDataFrame(existing, "key string, original string, english string")
    merged, actions = glossary.merge(ex, spark.createDataFrame(pairs, "seq long, original string, english string"))
    want, wanted = merged_by_force(existing, pairs)
    assert {x.key: (x.original, x.english, x.seq) for x in merged.collect()} == want
    assert sorted((x.key, x.seq, x.action) for x in actions.collect()) == wanted
    empty = glossary.merge(ex, spark.createDataFrame([], "seq long, original string, english string"))
    assert empty[0].count() == 2 and empty[1].count() == 0


def test_merge_has_two_exchanges(spark):
    pairs = spark.range(50).select(F.col("id").alias("seq"), F.lit("a").alias("original"), F.lit("b").alias("english"))
    merged, _ = glossary.merge(spark.createDataFrame([("x", "X", "y")], "key string, original string, english string"), pairs)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_late_rows_know_their_watermark(spark, tmp_path):
    write = ingest.split_late(str(tmp_path), event_time="ts", seconds=10)
    at = lambda *s: spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, x),) for x in s], "ts timestamp")
    batches = [at(40, 50), at(1, 55), at(39, 41, 5), at(44, 46)]
    for i, b in enumerate(batches):
        write(b, i)
    write(batches[2], 2)  # a retry changes nothing
    late = spark.read.parquet(str(tmp_path / "late"))
    assert sorted((r.batch, r.ts.second, r.watermark.second) for r in late.collect()) == [(2, 5, 40), (2, 39, 40), (3, 44, 45)]


def test_window_starts_are_the_last_periods(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=17 * i) for i in range(60)]
    df = spark.createDataFrame([(d,) for d in days] * 2 + [(None,)], "date_added date")
    got = periods.window_starts(df, {"M": 5, "W-MON": 7, "D": 0})
    months = sorted({d.replace(day=1) for d in days})
    assert got["M"] == months[-5] and got["D"] is None
    weeks = df.where("date_added is not null").select(periods.period_start("date_added", "W-MON").alias("p")).distinct()
    assert got["W-MON"] == sorted(r.p for r in weeks.collect())[-7]
    assert periods.window_starts(df, {"M": 999})["M"] is None and periods.window_starts(df.limit(0), {"M": 3})["M"] is None


def test_every_reason_is_reached(spark):
    wanted = [r for r, _ in queries_ingest._REASONS]
    rows = spark.createDataFrame([(i, t.replace("?", "Engineer")) for i, (_, t) in enumerate(queries_ingest._REASONS)], "payload_id long, payload string")
    got = [r.reason for r in extraction.validate_payloads(rows).orderBy("payload_id").select("reason").collect()]
    assert got == wanted and len(set(wanted)) == len(wanted) > 45


def test_verdict_plan_is_small(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries_ingest, "checkpoint_dir", lambda s: str(tmp_path))
    frame = queries_ingest.accepted_payloads(spark, "/root/testdata/sf0.001")
    assert len(frame._jdf.queryExecution().optimizedPlan().toString()) < 5_000
    v = extraction.validate_payloads(queries_ingest.b.payloads(spark, "/root/testdata/sf0.001"))
    assert "Filter accepted" not in v._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("since, until", [(dt.date(2024, 2, 10), None), (None, dt.date(2024, 2, 10)), (dt.date(2024, 1, 5), dt.date(2024, 3, 1))])
def test_series_of_a_date_range(spark, tmp_path, since, until):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    p = spark.createDataFrame([(i, d, "Role", "Role", 1.0, 2.0) for i, d in enumerate(days)], "id long, date_added date, role_title string, role_title_en string, salary_min double, salary_max double")
    links = spark.createDataFrame([(i, 1) for i in range(90)] * 2, "posting_id long, skill_id long")
    skills = spark.createDataFrame([(1, "s", "S", "S")], "id long, name string, display_name string, display_name_en string")
    files.write_posting_tables(str(tmp_path), postings=p, links=links, skills=skills)
    found = files.load_series(spark, "tables", str(tmp_path), since=since, until=until)
    want = sum((since is None or d >= since) and (until is None or d < until) for d in days)
    total = lambda n, c="posting_count": found[n].agg(F.sum(c)).first()[0]
    assert total("monthly_roles") == total("weekly_roles") == total("monthly_skills") == total("weekly_skills") == want
    assert total("monthly_totals", "total_skill_mentions") == want


def test_glossary_files_in_order_of_their_names(spark, tmp_path):
    for name, lines in (("b.tsv", "Haus\thome\nAuto\tcar\n"), ("a.tsv", "haus\thouse\nHAUS\tbuilding\n" * 50), ("c.tsv", "auto\tvehicle\nauto\tauto\n")):
        (tmp_path / name).write_text(lines, encoding="utf-8")
    got = {r.key: (r.original, r.english) for r in files.read_glossary(spark, str(tmp_path)).collect()}
    assert got == {"haus": ("Haus", "home"), "auto": ("auto", "vehicle")}
