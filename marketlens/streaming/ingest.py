"""Structured Streaming forms of ingest (K1) and period counts (K2).

K1: new texts arrive as files; each content hash is kept once. Given an
event time, the stream drops copies within a watermark (state that expires);
every micro-batch is reduced to one row per hash and anti-joined with the
stored postings before it is appended with its text. The append is
idempotent per batch id, so a retried micro-batch after an executor loss
does not duplicate rows.

K2: tumbling period counts with late data, by day windows (watermarked)
and by the Tuesday-week / month period starts as group keys."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.dates import period_start
from marketlens.functions.text import fingerprint, text_size_reason


def text_stream(spark: SparkSession, directory: str, fmt: str = "parquet", schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(directory)


def dedup_stream(stream: DataFrame, *, event_time: str | None = None, watermark: str = "1 day") -> DataFrame:
    """K1: admitted texts with their fingerprint. With an event-time column,
    copies within the watermark are dropped by state that expires with it;
    without one the stream keeps no state, and the sink (``append_new``) drops
    copies within a batch and those that are stored."""
    s = stream.where(text_size_reason("text").isNull()).withColumn("content_hash", fingerprint("text"))
    if event_time is not None:
        return s.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["content_hash"])
    return s


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The store (its columns and ``batch``), or None where there is none yet;
    other failures are raised."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    fields = [f for f in schema.fields if f.name != "batch"]
    return spark.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType())])).parquet(path)


def append_new(store_path: str, hash_col: str | None = "content_hash"):
    """foreachBatch sink: anti-join the micro-batch with the store by hash,
    then write all its columns as the store's ``batch=<id>`` folder. A retried
    batch overwrites its own folder (idempotent) and is anti-joined only
    against the other batches. Without ``hash_col`` every row is written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if hash_col is not None:
            rows = rows.groupBy(hash_col).agg(F.min(F.struct(*[c for c in batch.columns if c != hash_col])).alias("_r")).select(hash_col, "_r.*").select(*batch.columns)
            stored = _stored(batch.sparkSession, store_path, batch.schema)
            if stored is not None:
                rows = rows.join(stored.where(F.col("batch") != batch_id).select(hash_col), hash_col, "left_anti")
        rows.write.mode("overwrite").parquet(os.path.join(store_path, f"batch={batch_id}"))

    return write


def start_ingest(spark: SparkSession, source_dir: str, store_path: str, checkpoint: str, *, fmt: str = "parquet",
                 available_now: bool = True):
    """K1 end to end: file stream -> hash dedup -> foreachBatch anti-join +
    append. ``checkpoint`` must be a shared folder (a cluster path)."""
    q = (dedup_stream(text_stream(spark, source_dir, fmt))
         .writeStream.foreachBatch(append_new(store_path))
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def distinct_events(stream: DataFrame, keys: list[str], *, event_time: str, watermark: str) -> DataFrame:
    """K1 for late data: each key once. Copies that come within the watermark
    are dropped by state that expires with it; rows behind the watermark are
    dropped (``split_late`` keeps them in a side table)."""
    s = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return s.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)


def split_late(path: str, *, event_time: str, seconds: int):
    """foreachBatch sink: the side table of rows that come too late. Lateness is
    judged as the engine's stateful operators do: by the watermark that the
    batch before this one ran with, so by the latest event time of the batches
    before that, less ``seconds``, in whole milliseconds. Rows at or behind it
    go to ``late/batch=<id>``, with the watermark that they missed.
    The batches' latest times are kept under ``marks``, so a retried batch sees
    the same watermark and overwrites its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.agg(F.max(F.unix_millis(F.col(event_time).cast("timestamp"))).alias("latest"))
        own.write.mode("overwrite").parquet(os.path.join(path, "marks", f"batch={batch_id}"))
        marks = _stored(spark, os.path.join(path, "marks"), T.StructType([T.StructField("latest", T.LongType())]))
        before = marks.where(F.col("batch") < batch_id - 1).agg(F.max("latest").alias("before"))  # one row
        mark = F.timestamp_millis(F.col("before") - 1000 * seconds)
        late = batch.join(F.broadcast(before)).withColumn("watermark", mark).drop("before")
        late.where(F.col(event_time).cast("timestamp") <= F.col("watermark")).write.mode("overwrite").parquet(os.path.join(path, "late", f"batch={batch_id}"))

    return write


def late_rows(stream: DataFrame, path: str, checkpoint: str, *, event_time: str, seconds: int) -> DataFrame:
    """Run a stream to the end of its input and return its rows that came too
    late, with the ``watermark`` that they missed."""
    q = stream.writeStream.foreachBatch(split_late(path, event_time=event_time, seconds=seconds)).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("watermark", T.TimestampType())])
    out = _stored(stream.sparkSession, os.path.join(path, "late"), schema)
    return stream.sparkSession.createDataFrame([], schema) if out is None else out.drop("batch")


def period_counts_stream(stream: DataFrame, *, ts_col: str = "ts", key_col: str = "event_type",
                         watermark: str = "2 days", freq: str = "D") -> DataFrame:
    """K2: counts per (period, key) with late data accepted up to the
    watermark. Day periods are a tumbling ``window`` (append mode emits a day
    once the watermark passes it). Week (W-MON, Tuesday start) and month
    periods group on the period start (B11) of the watermarked event time;
    they run in update or complete mode, with state bounded by periods x keys."""
    # watermarks need TIMESTAMP (a TIMESTAMP_NTZ column is read in the session zone)
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")]
    if freq == "D":
        g = s.groupBy(F.window(ts_col, "1 day").alias("w"), key_col).agg(*aggs)
        return g.select(F.to_date(F.col("w.start")).alias("period_start"), key_col, "n", "value_sum")
    return s.groupBy(period_start(F.col(ts_col), freq).alias("period_start"), key_col).agg(*aggs)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", hash_col: str | None = None) -> DataFrame:
    """Run a streaming frame to the end of its input and return what it wrote
    to Parquet folders under ``path`` (shared storage). In complete mode the
    last batch has the whole result."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, "batch=0"))

    write = append_new(path, hash_col) if mode == "append" else replace
    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    out = _stored(df.sparkSession, path, df.schema)
    return df.sparkSession.createDataFrame([], df.schema) if out is None else out.select(*df.columns)
