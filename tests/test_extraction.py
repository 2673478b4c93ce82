import json

from pyspark.sql import functions as F

from marketlens.operators import extraction


def _validate(spark, payloads):
    df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "payload_id long, payload string")
    return {r.payload_id: r for r in extraction.validate_payloads(df).collect()}


def test_schema_cases(spark):
    r = _validate(spark, [
        {"role_title": "Engineer", "skills": [], "skills_en": []},
        {"": {}},
        {"skills": []},
        {"role_title": "   "},
        {"role_title": "E", "salary_min": 100, "salary_max": 50},
        {"role_title": "E", "salary_min": -1},
        {"role_title": "E", "skills": ["Python", "", "  ", "SQL"]},
        {"role_title": "E", "skills": ["a", "b"], "skills_en": ["x"]},
        {"role_title": "E", "salary_currency": "euro"},
        {"role_title": "E", "salary_currency": " eur "},
        {"role_title": "E", "salary_min": 10},
        {"role_title": 5},
        {"role_title": "E", "salary_min": "12"},
        {"role_title": "E", "work_type": None},
        {"role_title": "E", "skills": ["a", None]},
        "not json",
        [1, 2],
    ])
    assert r[0].accepted and r[0].work_type == "unknown" and r[0].has_nondiscrimination_disclaimer is False
    assert not r[1].accepted and r[1].reason.startswith("schema")
    assert not r[2].accepted and r[2].reason.startswith("schema")
    assert r[3].reason == "domain:role_title:empty"
    assert r[4].reason == "domain:salary_min:above_salary_max"
    assert r[5].reason.startswith("schema: salary_min")
    assert r[6].accepted and r[6].skills == ["Python", "SQL"] and r[6].skills_en == ["Python", "SQL"]
    assert r[7].reason == "domain:skills_en:length_differs"
    assert not r[8].accepted and "not_a_code" in r[8].reason
    assert r[9].accepted and r[9].salary_currency == "EUR"
    assert r[10].accepted and r[10].salary_min == 10.0 and r[10].salary_max is None
    assert not r[11].accepted  # a number is not a string
    assert r[12].accepted and r[12].salary_min == 12.0  # a numeric string is a number
    assert not r[13].accepted and not r[14].accepted
    assert r[15].reason == "schema: payload is not JSON" and r[16].reason == "schema: payload is not a JSON object"
    assert r[0].role_title_en == "Engineer"


def test_glossary_wins_over_extracted_label(spark):
    valid = spark.createDataFrame([(1, "Entwickler", "Developer", ["Datenbank"], ["Database"])],
                                  "payload_id long, role_title string, role_title_en string, skills array<string>, skills_en array<string>")
    g = spark.createDataFrame([("entwickler", "Software Developer")], "key string, english string")
    r = extraction.resolve_labels(valid, g).collect()[0]
    assert r.role_title_en == "Software Developer" and r.skills_en == ["Database"]


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "posting_id long, attempt int, tier string, succeeded boolean, error_category string, payload string, model string, message string")


def test_attempt_chain(spark):
    rows = [
        (1, 0, "primary", True, None, "p1", "m1", None), (1, 1, "primary", True, None, "p1b", "m2", None),
        (2, 0, "primary", False, "api_error", None, "m1", "boom"), (2, 1, "primary", True, None, "p2", "m2", None),
        (3, 0, "primary", False, "rate_limit", None, "m1", "429"), (3, 1, "primary", True, None, "x", "m2", None),
        (3, 2, "fallback", True, None, "p3", "local", None),
        (4, 0, "primary", False, "validation_failure", None, "m1", "schema"), (4, 1, "primary", True, None, "p4", "m2", None),
        (5, 0, "primary", False, "api_error", None, "m1", "e1"), (5, 1, "primary", False, "timeout", None, "m2", "t"),
        (5, 2, "primary", True, None, "x", "m3", None),
        # a fallback that stands before a primary success is not used
        (6, 0, "primary", False, "api_error", None, "m1", "e"), (6, 1, "fallback", True, None, "f", "local", None), (6, 2, "primary", True, None, "p6", "m2", None),
        (7, 0, "primary", False, "timeout", None, "m1", "t"), (7, 1, "fallback", False, "connection", None, "local", "down"),
    ]
    got = {r.posting_id: r for r in extraction.first_usable_attempt(_attempts(spark, rows)).collect()}
    assert got[1].payload == "p1" and got[1].tried == 1
    assert got[2].payload == "p2" and got[2].tried == 2
    assert got[3].payload == "p3" and got[3].tried == 1
    assert got[4].payload == "p4"
    assert got[5].payload is None and got[5].tried == 2
    assert got[5].detail == "m1: e1; m2: t; m3: skipped after timeout"
    assert (got[6].payload, got[6].used_attempt, got[6].tried) == ("p6", 2, 2)
    assert got[7].payload is None and got[7].detail == "m1: t; local: down"
    # the chain's controls
    run = lambda **k: {r.posting_id: r for r in extraction.first_usable_attempt(_attempts(spark, rows), **k).collect()}
    assert run(fallback_enabled=False)[3].payload is None and run(fallback_enabled=False)[7].detail == "m1: t"
    assert run(stop_on=())[3].payload == "x" and run(stop_on=("timeout",))[5].payload is None
    assert run(fatal=("rate_limit",))[3].payload is None


def test_payload_field_verdicts(spark):
    base = {"role_title": "E"}
    cases = [({"skills": [None]}, False), ({"skills": []}, True), ({"salary_min": "12d"}, False), ({"salary_min": " 12.5 "}, True),
             ({"application_deadline": "2024-01-01T00:00:00"}, True), ({"application_deadline": "2024-01-01T10:00:00"}, False)]
    df = spark.createDataFrame([(i, json.dumps(base | c)) for i, (c, _) in enumerate(cases)], "payload_id long, payload string")
    got = {r.payload_id: r.accepted for r in extraction.validate_payloads(df).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)}


def test_fallback_flag_and_exact_latencies(spark):
    df = spark.createDataFrame([(None, 1, "p", "m", i > 0, i * 10.0, None if i else "timeout", i, "primary", "h", 3, i) for i in range(4)],
                               "ts timestamp, posting_id long, provider string, model string, succeeded boolean, latency_ms double, error_category string, attempt int, tier string, content_hash string, posting_chars int, chain_index int")
    rec = extraction.attempt_records(df)
    assert sorted(r.fallback_used for r in rec.collect()) == [False, True, True, True]
    h = extraction.log_health(rec).first()
    assert (h.attempts, h.successes, h.fallback_share, h.latency_p50) == (4, 3, 0.75, 15.0)


def test_envelope_and_tokens(spark):
    bodies = [
        json.dumps({"choices": [{"message": {"content": '```json\n{"role_title": "E"}\n```'}}], "usage": {"prompt_tokens": 10, "completion_tokens": 5}}),
        json.dumps({"choices": [{"message": {"content": "   "}}]}),
        json.dumps({"choices": []}),
        json.dumps({"choices": [{"message": {"content": "[1]"}}]}),
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    rows = df.select("i", "body").transform(extraction.parse_envelope).select(
        "reason", "payload", extraction.token_usage("body").alias("u")).collect()
    assert rows[0].reason is None and json.loads(rows[0].payload) == {"role_title": "E"}
    assert rows[0].u.prompt_tokens == 10 and rows[0].u.total_tokens is None
    assert rows[1].reason.startswith("empty") and rows[2].reason == "unexpected response shape"
    assert rows[3].reason == "JSON content is not an object"
    local = spark.createDataFrame([('{"message": {"content": "{\\"role_title\\": \\"E\\"}"}}',), ('{"choices": []}',)], "body string")
    got = extraction.parse_envelope(local, shape="local").collect()
    assert json.loads(got[0].payload) == {"role_title": "E"} and got[1].reason == "unexpected response shape"
    o = spark.createDataFrame([('{"prompt_eval_count": 7, "eval_count": 8}',)], "body string")
    u = o.select(extraction.token_usage("body", shape="local").alias("u")).collect()[0].u
    assert (u.prompt_tokens, u.completion_tokens, u.total_tokens) == (7, 8, 15)


def test_error_category_order(spark):
    df = spark.createDataFrame([("HTTP 429 too many", None), ("Read timed out", None), ("schema parse failed", "value"),
                                ("LLM output failed schema validation", "value"), ("weird", None), ("x", "timeout")],
                               "m string, k string")
    got = [r.c for r in df.select(extraction.error_category("m", "k").alias("c")).collect()]
    assert got == ["rate_limit", "timeout", "parse_error", "validation_failure", "other", "timeout"]
    codes = spark.createDataFrame([(401,), (404,), (429,), (503,), (418,)], "c int")
    assert [r.s for r in codes.select(extraction.http_status_class("c").alias("s")).collect()] == [
        "auth", "not_found", "rate_limit", "unavailable", "other"]


def test_kinds_of_a_field(spark):
    """Absent, null, and a value of another kind are told apart in every field."""
    r = _validate(spark, [
        {"role_title": "E", "city": None, "skills": None},
        {"role_title": "E", "city": None, "salary_max": True, "other": {"city": 3}},
        {"role_title": "E", "city": {"a": 1}},
        {"role_title": "E", "salary_min": " 12.5 ", "has_nondiscrimination_disclaimer": "YES"},
        {"role_title": "E", "salary_min": "12d"},
        {"role_title": "E", "has_nondiscrimination_disclaimer": 1},
        {"role_title": "E", "has_nondiscrimination_disclaimer": None},
        {"role_title": "E", "skills": [], "skills_en": [1]},
        "null", '"E"', '{"role_title": "E", "role_title": "F"}', "",
    ])
    assert r[0].reason == "schema: skills must be a list of strings"
    assert r[1].accepted and r[1].city is None and r[1].salary_max == 1.0
    assert r[2].reason == "schema: city must be a string"
    assert r[3].accepted and r[3].salary_min == 12.5 and r[3].has_nondiscrimination_disclaimer
    assert r[4].reason == "schema: salary_min must be a number"
    assert r[5].accepted and r[5].has_nondiscrimination_disclaimer
    assert r[6].reason == "schema: has_nondiscrimination_disclaimer must be a boolean"
    assert r[7].reason == "schema: skills_en must be a list of strings"
    assert r[8].reason == r[9].reason == "schema: payload is not a JSON object"
    assert r[10].reason == r[11].reason == "schema: payload is not JSON"
