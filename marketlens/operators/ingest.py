"""Posting ingest as table jobs: admission (B18, A5), fingerprint dedup (G4),
new-only anti-join against the store (C7), insert-if-unseen with a created
flag (H1) and the batch pipeline (J5).

A batch of texts is processed in arrival order semantics: the first copy of
a fingerprint is created, later copies (and texts already in the store)
resolve to the stored posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.text import fingerprint, py_strip, text_size_reason

# Per-text ingest outcomes.
CREATED = "created"
DUPLICATE_IN_BATCH = "duplicate_in_batch"
EXISTING = "existing"
REJECTED = "rejected"
SALTS = 8


def admit_texts(df: DataFrame, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """Stripped text, its fingerprint (B19) and a reject reason (empty, or
    over the cap of a caller who sets one)."""
    return df.select(
        "*",
        py_strip(text_col).alias("posting_text"),
        text_size_reason(text_col, max_chars).alias("reject_reason"),
    ).withColumn("content_hash", F.when(F.col("reject_reason").isNull(), fingerprint(text_col)))


def first_per_hash(df: DataFrame, order_col: str, hash_col: str = "content_hash") -> DataFrame:
    """One row per fingerprint, the earliest by ``order_col`` (a
    deterministic choice, unlike ``dropDuplicates``), with the copy count.

    ``min_by`` over a grouped aggregate: partial aggregation runs before the
    shuffle, so a fingerprint with millions of copies is reduced map-side
    instead of being sorted in one window partition."""
    return df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(
        F.min(order_col).alias("first_" + order_col),
        F.count(F.lit(1)).alias("copies"),
    )


def new_only(batch: DataFrame, store: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Rows of ``batch`` whose fingerprint is not in the store."""
    return batch.join(store.select(hash_col).where(F.col(hash_col).isNotNull()), hash_col, "left_anti")


def ingest_batch(batch: DataFrame, store: DataFrame | None, *, id_col: str, text_col: str = "text",
                 store_id_col: str = "id", max_chars: int | None = None) -> DataFrame:
    """H1 + J5: outcome per incoming text.

    Output: (id_col, content_hash, status, posting_ref, reject_reason) where
    status is created / duplicate_in_batch / existing / rejected and
    posting_ref the id of the posting the text resolves to (the stored id, or
    the first batch id for created and in-batch duplicates)."""
    # Only ids and fingerprints cross the shuffles, never the texts. What each
    # fingerprint resolves to is settled on one row per fingerprint; the texts
    # are joined once, spread over SALTS so that the copies of one text do not
    # meet in one task. Rejected texts have no fingerprint and go around the join.
    admitted = admit_texts(batch.select(id_col, text_col), text_col, max_chars).select(id_col, "content_hash", "reject_reason")
    known = first_per_hash(admitted, id_col).select("content_hash", F.col("first_" + id_col).alias("_first"))
    if store is not None:
        # one stored posting per fingerprint (the store keeps it unique; min is a guard)
        stored = store.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(store_id_col).alias("_stored"))
        known = known.join(stored, "content_hash", "left")
    else:
        known = known.withColumn("_stored", F.lit(None).cast("long"))
    known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    kept = admitted.where("content_hash is not null").withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    status = (
        F.when(F.col("_stored").isNotNull(), F.lit(EXISTING))
        .when(F.col(id_col) == F.col("_first"), F.lit(CREATED))
        .otherwise(F.lit(DUPLICATE_IN_BATCH))
    )
    out = kept.join(known, ["content_hash", "_salt"], "left").select(
        id_col, "content_hash", status.alias("status"), F.coalesce("_stored", "_first").alias("posting_ref"), "reject_reason")
    rejected = admitted.where("content_hash is null").select(
        id_col, "content_hash", F.lit(REJECTED).alias("status"), F.lit(None).cast(out.schema["posting_ref"].dataType).alias("posting_ref"), "reject_reason")
    return out.unionByName(rejected)


def created_rows(outcomes: DataFrame, batch: DataFrame, id_col: str) -> DataFrame:
    """Rows to append to the store: the texts whose status is created."""
    return batch.join(outcomes.where(F.col("status") == CREATED).select(id_col, "content_hash"), id_col)
