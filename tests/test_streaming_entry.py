import os
import re
import tempfile
import uuid

import pytest

from marketlens.streaming import ingest as st

SF = "/root/testdata/sf0.001"


def test_stream_ingest_keeps_each_hash_once(spark):
    src = tempfile.mkdtemp(prefix="ml-src-")
    spark.createDataFrame([(1, "a text"), (2, " a text "), (3, "b text")], "doc_id long, text string").write.parquet(os.path.join(src, "b1"))
    store_path = tempfile.mkdtemp(prefix="ml-store-")
    ck = os.path.join(spark.conf.get("spark.checkpoint.dir"), "k1-test-" + uuid.uuid4().hex[:8])
    q = st.start_ingest(spark, os.path.join(src, "b1"), store_path, ck)
    q.awaitTermination()
    rows = spark.read.parquet(store_path).collect()
    assert len(rows) == 2 and len({r.content_hash for r in rows}) == 2
    assert {r.text.strip() for r in rows} == {"a text", "b text"}
    # later files: only what is not stored yet
    spark.createDataFrame([(9, "b text"), (10, "c text")], "doc_id long, text string").write.mode("append").parquet(os.path.join(src, "b1"))
    q = st.start_ingest(spark, os.path.join(src, "b1"), store_path, ck)
    q.awaitTermination()
    assert sorted(r.text.strip() for r in spark.read.parquet(store_path).collect()) == ["a text", "b text", "c text"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry_and_all_queries_run(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    for name, fn in qs.items():
        if re.match(r"op\d+_|pipeline$", name):
            continue  # training-data queries have tests of their own
        out = fn(spark, SF)
        assert out.columns, name
        out.limit(1).collect()


def test_stream_period_counts_week_and_month(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    src = tempfile.mkdtemp(prefix="ml-ev-")
    rows = [(dt.datetime(2024, 1, d, 12), "view", 1.0) for d in (1, 2, 8, 9, 31)] + [(dt.datetime(2024, 2, 1, 1), "view", 2.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(os.path.join(src, "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(os.path.join(src, "e"))
    for freq, want in (("W-MON", {dt.date(2023, 12, 26): 1, dt.date(2024, 1, 2): 2, dt.date(2024, 1, 9): 1, dt.date(2024, 1, 30): 2}),
                       ("M", {dt.date(2024, 1, 1): 5, dt.date(2024, 2, 1): 1})):
        ck = os.path.join(spark.conf.get("spark.checkpoint.dir"), "k2" + freq.replace("-", "") + uuid.uuid4().hex[:6])
        out = st.drain(st.period_counts_stream(stream, freq=freq), ck + "_out", ck, mode="complete")
        assert {r.period_start: r.n for r in out.collect()} == want
