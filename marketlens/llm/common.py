"""Shared helpers: shared-folder tables, label folds and numpy views of text
batches (bytes, words, hashes)."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task (one longer text is one chunk).
CHUNK_BYTES = 1 << 20


# --- shared folder ---------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Only a local session without that setting gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        path = tempfile.mkdtemp(prefix="marketlens-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start
    from the table, so lost executors cost no recomputation of its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``stored`` wrote. To be called once all
    that is made of it is stored itself; the frame is of no use any more."""
    sc = df.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(f)) for f in df.inputFiles()]
    for folder in {str(p.getParent()): p.getParent() for p in paths}.values():
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of frames that nothing refers to any
    more (the cleaner acts when the driver collects garbage, by itself only
    every half hour). To be called after ``stored`` of a large frame."""
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def row_keys(df: DataFrame, id_col: str, text_col: str, key_col: str = "row_key") -> tuple[DataFrame, bool]:
    """``df`` with a key of each row (``key_col``, long; pass a ``fresh`` name to
    keep all columns of a caller) in the order of ids, nulls first, and whether
    that is the id itself. If ids repeat or are null, rows are numbered by id and
    hash of the text, and stored so that all uses see the same numbers; rows
    equal in both are told apart by their number."""
    own = F.col(id_col).cast("long")
    if not df.groupBy(own.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").limit(1).count():
        return df.withColumn(key_col, own), True
    ordered = df.orderBy(own, F.sha2(F.col(text_col).cast("string"), 256))
    return stored(ordered.withColumn(key_col, F.monotonically_increasing_id()), "row-keys"), False


def in_training_fold(doc_id: Column | str) -> Column:
    """Labels may be learnt from rows whose crc32(doc_id as text) mod 5 != 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 != 0, F.lit(False))


# --- batches of texts ------------------------------------------------------

def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another and their n + 1 offsets;
    null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches, text_col: str = "text", limit: int = CHUNK_BYTES):
    """Slices of the record batches with about ``limit`` bytes of text each."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        start = 0
        while start < n:
            end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow strings from concatenated UTF-8 bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (counts[i] of them), for all i."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


# --- hashes ----------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "direct"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n + n // 4, 1 << 16)
        p = np.full(size, _INV if inverse else _BASE, np.uint64)
        p[0] = 1
        have = _powers[key] = np.multiply.accumulate(p)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice; equal slices have equal hashes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def word_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and, for each text,
    the number of the first of its words (n + 1 values)."""
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(n, inverse=True))


class ValueCache:
    """Numbers by hash that a task has computed; starts anew beyond ``most``."""

    def __init__(self, most: int = 1 << 21):
        self.most = most
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def find(self, hashes: np.ndarray, compute) -> np.ndarray:
        """Values of sorted distinct hashes; ``compute(i)`` gives the new ones'."""
        if len(self.hashes) + len(hashes) > self.most:
            self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)
        i = np.searchsorted(self.hashes, hashes)
        known = i < len(self.hashes)
        known[known] = self.hashes[i[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            self.values = np.insert(self.values, i[new], compute(new))
            self.hashes = np.insert(self.hashes, i[new], hashes[new])
            i = np.searchsorted(self.hashes, hashes)
        return self.values[i]
