import datetime as dt
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketlens.functions import dates, labels, numeric, text
from marketlens.operators.store import format_value


def test_py_ws_matches_python_strip():
    assert len(text.PY_WS) == 29
    s = "".join(chr(c) for c in range(0x3001))
    assert set(ch for ch in s if not ch.strip()) == set(text.PY_WS)


def test_strip_and_fingerprint(spark):
    raw = ["  hello world  ", "hello world", "\x1c　hello world ", "   "]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    rows = df.select(text.py_strip("t").alias("s"), text.fingerprint("t").alias("h")).collect()
    assert [r.s for r in rows] == [r.strip() for r in raw]
    assert rows[0].h == rows[1].h == rows[2].h == hashlib.sha256(b"hello world").hexdigest()
    assert len(rows[0].h) == 64


def test_non_blank_uses_space_trim(spark):
    df = spark.createDataFrame([("a",), ("",), ("   ",), (None,), ("\t",)], "c string")
    got = [r.c for r in df.where(text.non_blank("c")).collect()]
    assert got == ["a", "\t"]  # SQL trim removes spaces only


def test_week_starts_tuesday_like_pandas(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(82)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.p for r in df.select(dates.period_start("d", "W-MON").alias("p")).collect()]
    want = [p.date() for p in pd.to_datetime(pd.Series(days)).dt.to_period("W-MON").dt.start_time]
    assert got == want
    months = [r.p for r in df.select(dates.period_start("d", "M").alias("p")).collect()]
    assert months[40] == dt.date(2024, 2, 1)


def test_round_half_even_matches_numpy(spark):
    vals = [2.675, 9099.825, 0.125, 2.5, -0.00001, 1.005, 23663.275]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.r for r in df.select(numeric.round_half_even("v", 2).alias("r")).collect()]
    assert got == [float(np.round(v, 2)) + 0.0 for v in vals]
    z = df.select(numeric.round_half_even("v", 0).alias("r")).collect()
    assert [r.r for r in z][3] == 2.0


def test_role_label_quirk_q6(spark):
    df = spark.createDataFrame([("Data Eng", "X"), ("", "Orig"), ("   ", "Orig"), (None, None), (None, " T ")],
                               "en string, title string")
    got = [r.l for r in df.select(labels.role_label("en", "title").alias("l")).collect()]
    assert got == ["Data Eng", "Orig", "unknown", "unknown", "T"]


def test_salary_midpoint_and_scrub(spark):
    df = spark.createDataFrame([(1000.0, 2000.0), (3000.0, None), (None, 4000.0), (None, None), (float("nan"), 5.0)],
                               "lo double, hi double")
    got = [r.m for r in df.select(numeric.salary_midpoint(numeric.finite_or_null("lo"), numeric.finite_or_null("hi")).alias("m")).collect()]
    assert got == [1500.0, 3000.0, 4000.0, None, 5.0]


def test_clamp_top_n():
    assert [labels.clamp_top_n(v) for v in (None, 0, 3, 100, "x")] == [10, 1, 3, 50, 10]
    assert [labels.row_limit(v) for v in (None, 3, 1000)] == [10, 3, 1000]


def test_report_value_format(spark):
    df = spark.createDataFrame([("role", 2.0), ("salary_role", 4123.7), ("role", 9.0), ("skill", 8.123456), ("role", None)],
                               "t string, v double")
    got = [r.f for r in df.select(format_value("t", "v").alias("f")).collect()]
    assert got == ["2", "4124", "9", "8.12", "—"]


def test_fenced_block_strip(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 1}',), ("```\n{}",)], "t string")
    got = [r.s for r in df.select(text.strip_markdown_fences("t").alias("s")).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', "{}"]


def test_currency_rule(spark):
    df = spark.createDataFrame([(" eur ",), ("euro",), (None,), ("  ",)], "c string")
    rows = df.select(text.currency_code("c").alias("v"), text.currency_reason("c").alias("r")).collect()
    assert [r.v for r in rows] == ["EUR", "EURO", None, None]
    assert [r.r is None for r in rows] == [True, False, True, True]
