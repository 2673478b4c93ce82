"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed bottom-up. At each level runs of one symbol become
one symbol, deterministic coin tossing (the lowest bit in which a symbol
differs from the one before, repeated until labels are below 6) labels the
rest, and a phrase starts at every local maximum of the labels. A phrase's
name is a hash of its symbols, and the names are the next level's symbols.
Labels depend on a few neighbours only, so equal substrings get the same
phrases inside, wherever they stand. The third level's phrases have about 27
bytes; a text's fingerprint is the 64 smallest of their 32-bit names (hex).
Likeness is the share 2J / (1 + J) that two texts have in common, J being the
bottom-64 estimate of the Jaccard similarity of their phrase sets.

``compare_edits`` fingerprints each document and an edited text of it (its
last third replaced by the start of the next document).

Defined results: null and empty texts have the empty fingerprint, like each
other 1 and anything else 0; equal texts have equal fingerprints; null ids sort
lowest; rows that repeat an id stand in the order of their texts' hashes; a
single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, mix, powers, ragged, text_bytes

LEVELS, SIZE = 3, 64
_NONE = np.uint64(0xA5A5A5A5A5A5A5A5)


def _toss(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Label of each symbol against the one before it (different by then)."""
    one = x.dtype.type(1)
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[edge] = x[edge] ^ one  # the first symbol of a text
    v = x ^ before
    place = np.bitwise_count((v & (~v + one)) - one)
    return (place << 1) | ((x >> place.astype(x.dtype)) & one).astype(np.uint8)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrase names of all texts and, for each text, the number
    of its first phrase (as ``first`` has it for symbols; n + 1 values)."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint64), first
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    keep = edge[:n].copy()
    keep[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(keep)
    run = np.diff(np.append(at, n))
    name = symbols[at].astype(np.uint64)
    long = run > 1
    name[long] = mix(name[long] + run[long].astype(np.uint64) * _NONE)
    first = np.searchsorted(at, first)
    begin = np.unique(first[:-1][first[:-1] < first[1:]])
    if symbols.dtype == np.uint8:  # short symbols for the coin tossing
        x = symbols[at].astype(np.uint16) | (np.minimum(run - 1, 255) << 8).astype(np.uint16)
        rounds = 4
    else:
        x, rounds = name, 4
    for _ in range(rounds):
        x = _toss(x, begin)
    top = np.ones(len(x), bool)
    top[1:] = x[1:] > x[:-1]
    top[:-1] &= x[:-1] > x[1:]
    last = np.append(begin[1:], len(x)) - 1
    top[last[last > 0]] = False
    top[begin] = True
    after = begin[begin + 1 < len(x)] + 1
    top[np.setdiff1d(after, begin)] = False
    start = np.flatnonzero(top)
    sums = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(mix(name) * powers(len(name)), out=sums[1:])
    end = np.append(start[1:], len(name))
    out = mix((sums[end] - sums[start]) * powers(len(name), inverse=True)[start] + (end - start).astype(np.uint64))
    return out, np.searchsorted(start, first)


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted smallest distinct 32-bit phrase names of each text."""
    symbols, first = data, offsets
    for _ in range(LEVELS):
        symbols, first = parse(symbols, first)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
    key = np.unique(text << np.uint64(32) | symbols >> np.uint64(32))
    cut = np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(32))
    names = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [names[a:min(a + SIZE, b)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    # of the 64 smallest names of the union, those that both have
    size = len(both) - int(same.sum())
    if size <= SIZE:
        j = int(same.sum()) / size
    else:
        fresh = np.ones(len(both), bool)
        fresh[1:] = ~same
        limit = both[np.flatnonzero(fresh)[SIZE - 1]]
        j = int((same & (both[1:] <= limit)).sum()) / SIZE
    return 2 * j / (1 + j)


def fingerprint(df: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text."""
    names = [c for c in df.columns if c != out_col]
    at = names.index(text_col)
    schema = df.select(*names).withColumn(out_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, text_col):
            found = [to_text(s) for s in sketches(*text_bytes(b.column(at)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*names, out_col])

    return df.select(*names).mapInArrow(run, schema)


def edited(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts 1, 2, ... of the batch: the text with its last third of code
    points replaced by the first as many of the text before it in the batch.
    Bytes, offsets and the texts' code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets)
    n = np.diff(first)
    lead = np.append(lead, len(data))
    cut = n[1:] // 3
    head = lead[first[2:] - cut]
    tail = lead[first[:-2] + np.minimum(cut, n[:-1])]
    sizes = np.stack([head - offsets[1:-1], tail - offsets[:-2]], 1).reshape(-1)
    starts = np.stack([offsets[1:-1], offsets[:-2]], 1).reshape(-1)
    return data[ragged(starts, sizes)], np.concatenate([[0], np.cumsum(sizes.reshape(-1, 2).sum(1))]), n[1:]


OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text (see above; the
    documents stand in descending order of ids, the first follows the last).

    Ids are cut into ranges; each range is sorted by itself and gets a copy of
    the document that follows its last, so no single task sees all documents."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.coalesce(F.col("id"), F.lit(-(1 << 63))).cast("double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.select("place").approxQuantile("place", [i / (4 * parts) for i in range(1, 4 * parts)], 0.0625 / parts)))
    ranged = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="range", handleInvalid="keep").transform(docs) if cuts else docs.withColumn("range", F.lit(0.0))
    # at most one row per range; the ids are the only thing that meets here
    ends = sorted((r["range"], r.top) for r in ranged.groupBy("range").agg(F.max(F.coalesce("id", F.lit(-(1 << 63)))).alias("top")).collect())
    if not ends:
        return spark.createDataFrame([], OUT).withColumnRenamed("id", id_col)
    moved = spark.createDataFrame([(top, ends[(i + 1) % len(ends)][0]) for i, (_, top) in enumerate(ends)], "top long, goes double")
    carried = docs.withColumn("top", F.coalesce("id", F.lit(-(1 << 63)))).join(F.broadcast(moved), "top").select("id", "text", F.col("goes").alias("range"), F.lit(0).alias("own"))
    rows = ranged.select("id", "text", "range", F.lit(1).alias("own")).union(carried).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartition(parts, "range").sortWithinPartitions("range", "own", F.col("id").asc_nulls_first(), "tie").select("id", "range", "own", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        last_text, last_sketch = "", np.zeros(0, np.uint32)
        for b in chunks(batches, "text"):
            own = b.column(2).to_numpy(zero_copy_only=False)
            texts = pa.concat_arrays([pa.array([last_text], pa.string()), b.column(3).cast(pa.string())])
            data, offsets = text_bytes(texts)
            mine = sketches(data[offsets[1]:], offsets[1:] - offsets[1])
            new, at, n = edited(data, offsets)
            theirs = sketches(new, at)
            raw, out, ids = new.tobytes(), [], b.column(0).to_pylist()
            before = [last_sketch, *mine[:-1]]
            for i in np.flatnonzero(own == 1).tolist():
                out.append((ids[i], int(n[i]), hashlib.sha256(raw[at[i]:at[i + 1]]).hexdigest(), to_text(mine[i]), to_text(theirs[i]), likeness(mine[i], theirs[i]), likeness(mine[i], before[i])))
            last_text, last_sketch = texts[-1].as_py(), mine[-1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2], strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, OUT).withColumnRenamed("id", id_col)
