"""The registered queries of the training-data operators: each applies its
operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontaminate, filter_audit, fingerprint, importance, language_id, line_dedup, ngram_join, quality_cnn, recompression, sentencepiece_codec, suffix_dedup, toxicity, warc
from marketlens.llm.common import in_training_fold, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and whether they decode to it again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs).select("doc_id", "n_tokens", "tokens", "round_trip")


def training_labels(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Labels that may be learnt from (never those of the held-out fold)."""
    return table(spark, sf_dir, "labels").filter(in_training_fold("doc_id")).select("doc_id", F.col(which).alias("label"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_cnn.fit(docs, training_labels(spark, sf_dir, "quality"))
    scored = quality_cnn.score(docs, net)
    return scored.select("doc_id", (~in_training_fold("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, training_labels(spark, sf_dir, "toxic"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (~in_training_fold("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keep IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keep IS DISTINCT FROM page_id THEN keep END AS refers_to
FROM k
"""


@query("op6_warc", WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back by the salvage reader."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path, with_payload=False).filter("kind = 'record'")
    number = lambda c: F.substring(c, len(warc.URN) + 1, 20).try_cast("bigint")
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


@query("op4_fingerprint")
def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_decontaminate", decontaminate.oracle())
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items they leak."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from each document, by all pairs of similar lines."""
    return line_dedup.removed_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact=True)


@query("op2_ngram_join", ngram_join.oracle())
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_recompression", recompression.oracle())
def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_suffix_array")
def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_filter_audit", filter_audit.oracle())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters A to E in all 120 orders, per language."""
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


@query("op12_importance", importance.oracle())
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for their likeness to the benchmark texts."""
    found = importance.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.fit(docs.filter(fold != 1).select("doc_id", "text", "lang"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
