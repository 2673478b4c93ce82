"""Target-distribution importance resampling over hashed n-gram features.

Features are all runs of one to ``orders`` consecutive words, joined by one
space; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``. The
CRC is linear over bits: the value of a span of n bytes is a constant of n
XORed with one contribution per byte, which depends on the byte and on how many
bytes follow it in the span. Those contributions are a table (bytes x distance
from the end), so the CRCs of all spans of a batch are two gathers and one
``bitwise_xor.reduceat`` over the spans. Spans longer than the table fold block
by block: the register so far is moved past a block by four byte tables.

The corpus and the target are counted by bucket; a bucket's gain is the log
ratio of its smoothed shares; a document's weight is the sum of its features'
gains. Gumbel noise from a hash of the id is added, and the largest scores are
drawn, which is sampling without replacement in proportion to exp(weight).
Ranks come from one range-partitioned sort: place within the partition plus
the rows of the partitions before.

Defined results: null and empty texts, or texts without words, have no
features and weight 0 and are never drawn (``least_words``); a null id has the
noise of the empty id and ranks before others on a tie; rows that repeat an id
share their noise and are ranked each; an empty corpus gives no rows; an empty
target leaves the smoothed shares of the corpus alone; columns other than those
named are never read. Texts of any length are worked on in pieces of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, lowered, ragged, stored, text_bytes

BUCKETS, ORDERS = 10_000, 3
#: Distances from the end that the table holds, and so the bytes of a block.
REACH = 128
#: Bytes gathered at once.
PIECE_BYTES = 1 << 16
TEXT_BYTES = 1 << 18


# --- CRC-32 from a position table ---------------------------------------------

def _byte_steps() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


class PositionTable:
    """CRC-32 (of zlib) of byte spans by XOR of positional contributions."""

    def __init__(self, reach: int = REACH):
        step = _byte_steps()
        past = lambda x: (x >> np.uint32(8)) ^ step[x & np.uint32(255)]  # noqa: E731  one zero byte later
        rows = [step]
        for _ in range(reach - 1):
            rows.append(past(rows[-1]))
        self.reach = reach
        self.table = np.stack(rows).ravel()  # [distance from the end * 256 + byte]
        start = [np.array([0xFFFFFFFF], np.uint32)]
        for _ in range(reach):
            start.append(past(start[-1]))
        self.start = np.concatenate(start)  # the initial register after n zero bytes
        moved = [np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)]
        for _ in range(reach):
            moved = [past(x) for x in moved]
        self.block = moved  # a register's four bytes moved past a whole block

    def xors(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XOR of the contributions of spans of 1 to ``reach`` bytes."""
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        run = np.arange(int(sizes.sum()))
        key = np.repeat((first + sizes - 1) << 8, sizes)  # 256 * (distance from the end) + byte
        key -= run << 8
        run += np.repeat(starts - first, sizes)
        key += data[run]
        return np.bitwise_xor.reduceat(self.table[key], first)

    def crc(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of each span data[start:end], none of them empty."""
        out = np.empty(len(starts), np.uint32)
        sizes = ends - starts
        total = np.cumsum(np.minimum(sizes, self.reach))
        lo = 0
        while lo < len(starts):  # about PIECE_BYTES gathered bytes at a time
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PIECE_BYTES, side="right")))
            out[lo:hi] = self._some(data, starts[lo:hi], sizes[lo:hi])
            lo = hi
        return out

    def _some(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        head = (sizes - 1) % self.reach + 1  # the first block is the odd one, so that all others are whole
        at = starts + head
        value = self.start[head] ^ self.xors(data, starts, at)
        left = (sizes - head) // self.reach
        live = np.flatnonzero(left)
        while len(live):
            v = value[live]
            v = self.block[0][v & 255] ^ self.block[1][(v >> 8) & 255] ^ self.block[2][(v >> 16) & 255] ^ self.block[3][v >> 24]
            value[live] = v ^ self.xors(data, at[live], at[live] + self.reach)
            at[live] += self.reach
            left[live] -= 1
            live = live[left[live] > 0]
        return value ^ np.uint32(0xFFFFFFFF)


_tables: list[PositionTable] = []


def position_table() -> PositionTable:
    if not _tables:
        _tables.append(PositionTable())
    return _tables[0]


# --- features -------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, each followed by one space; where each starts
    (one more at the end); the number of the first word of each text (n + 1)."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    joined = np.full(at[-1], 32, np.uint8)
    joined[ragged(at[:-1], sizes)] = data[inside]
    return joined, at, np.searchsorted(starts, offsets)


def feature_buckets(data: np.ndarray, offsets: np.ndarray, *, orders: int = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and pieces of (text number, bucket) of all features."""
    joined, at, first = words(lowered(data), offsets)
    count = np.diff(first)

    def pieces():
        text = np.repeat(np.arange(len(count)), count)
        for n in range(1, orders + 1):
            begin = np.flatnonzero(text[n - 1:] == text[:len(text) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)
            if len(begin):
                yield text[begin], (position_table().crc(joined, at[begin], at[begin + n] - 1) % np.uint32(buckets)).astype(np.int64)

    return count, pieces()


def feature_counts(docs: DataFrame, text_col: str = "text", *, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all whole texts by bucket. Each task adds up its
    own rows first."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for b in chunks(batches, "t", TEXT_BYTES):
            for _, found in feature_buckets(*text_bytes(b.column(0)), orders=orders, buckets=buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of every bucket, add-one
    smoothed. Two frames of at most ``buckets`` rows reach the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for frame, into in ((corpus, s), (target, t)):
        for bucket, n in frame.collect():
            into[bucket] = n
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratio = lambda x, y: (y + 1.0) * whole_s / ((x + 1.0) * whole_t)
    return np.array([math.floor(1000 * math.log(ratio(x, y))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """``id_col``, n_words, n_features and weight of each row. ``gain`` (one
    number per bucket) goes to the tasks with the function."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, "t", TEXT_BYTES):
            count, pieces = feature_buckets(*text_bytes(b.column(1)), orders=orders, buckets=len(gain))
            weight, features = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
            for text, found in pieces:
                edge = np.flatnonzero(np.diff(text, prepend=-1))
                weight[text[edge]] += np.add.reduceat(gain[found], edge)
                features += np.bincount(text, minlength=len(count))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count.astype(np.int64)), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


# --- the draw ---------------------------------------------------------------------

def noisy(weighed: DataFrame, *, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """With ``score``: weight plus Gumbel noise in thousandths, from the hash of
    seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(scored: DataFrame, *, id_col: str = "doc_id", least_words: int = 20, percent: int = 5) -> DataFrame:
    """With ``rank``: 1, 2, ... of the floor(percent N / 100) largest scores of
    the N rows of ``least_words`` words, smaller ids first on a tie; null for
    all others. Counts per partition alone reach the driver."""
    fit = F.col("n_words") >= least_words
    order = [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col(id_col).asc_nulls_first()]
    placed = stored(scored.orderBy(*order).withColumn("place_", F.monotonically_increasing_id()), "importance-order")
    part, place = F.shiftrightunsigned("place_", 33), F.col("place_").bitwiseAND((1 << 33) - 1)
    sizes = sorted((x.part, x.rows, x.fit) for x in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(fit.cast("long")).alias("fit")).collect())
    drawn = sum(x[2] for x in sizes) * percent // 100
    before, at = [], 0
    for p, rows, _ in sizes:
        before.append((p, at))
        at += rows
        if at >= drawn:
            break  # no row of a later partition is drawn
    offsets = placed.sparkSession.createDataFrame(before, "part_ long, before_ long")
    out = placed.join(F.broadcast(offsets), part == F.col("part_"), "left")
    rank = F.col("before_") + place + 1
    return out.withColumn("rank", F.when(rank <= drawn, rank)).drop("place_", "part_", "before_")


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """``id_col``, n_words, n_features, weight, score and rank of every row of
    ``docs``; ``target`` has the texts to resemble (column ``text_col``)."""
    gain = gains(feature_counts(docs, text_col), feature_counts(target, text_col))
    return ranked(noisy(weigh(docs, gain, id_col=id_col, text_col=text_col), id_col=id_col, seed=seed), id_col=id_col, least_words=least_words, percent=percent)


def oracle() -> str:
    """The query in SQL; the CRC of each distinct feature is the XOR of rows of
    the position table, which a recursion writes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = " UNION ALL ".join(
        f"SELECT kind, doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM texts WHERE len(w) >= {n}" for n in (1, 2, 3))
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    return f"""
WITH RECURSIVE texts AS (
  SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), features AS MATERIALIZED (SELECT kind, doc_id, f, count(*) AS n FROM ({runs}) GROUP BY ALL),
names AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, strlen(f) AS size FROM (SELECT DISTINCT f FROM features)),
bits AS (
  SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) t(b) UNION ALL SELECT b, k + 1, {bit} FROM bits WHERE k < 8
), base AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
moved AS (
  SELECT 0::BIGINT AS d, b, v FROM base
  UNION ALL SELECT d + 1, m.b, xor(m.v >> 8, base.v) FROM moved m JOIN base ON base.b = m.v & 255 WHERE d + 1 < (SELECT max(size) FROM names)
), position AS MATERIALIZED (SELECT d, printf('%02X', b) AS pair, v FROM moved),
start AS (
  SELECT 0::BIGINT AS d, 4294967295::BIGINT AS v
  UNION ALL SELECT d + 1, xor(s.v >> 8, base.v) FROM start s JOIN base ON base.b = s.v & 255 WHERE d < (SELECT max(size) FROM names)
), spread AS (
  SELECT f, size, substr(h, 2 * i - 1, 2) AS pair, size - i AS d FROM (SELECT f, h, size, unnest(range(1, size + 1)) AS i FROM names)
), hashed AS (
  SELECT f, xor(xor(bit_xor(position.v), any_value(start.v)), 4294967295) % {BUCKETS} AS bucket
  FROM spread JOIN position USING (pair, d) JOIN start ON start.d = spread.size GROUP BY f
), placed AS MATERIALIZED (SELECT kind, doc_id, bucket, n FROM features JOIN hashed USING (f)),
counted AS (
  SELECT bucket, sum(CASE WHEN kind = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN kind = 'b' THEN n ELSE 0 END)::DOUBLE AS t FROM placed GROUP BY bucket
), totals AS (SELECT sum(s) + {BUCKETS}::DOUBLE AS s, sum(t) + {BUCKETS}::DOUBLE AS t FROM counted),
gain AS (
  SELECT bucket, floor(1000 * ln((counted.t + 1::DOUBLE) * totals.s / ((counted.s + 1::DOUBLE) * totals.t)))::BIGINT AS g FROM counted, totals
), weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight FROM placed JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scored AS (
  SELECT t.doc_id, len(t.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('42:' || t.doc_id), 1, 8))::BIGINT AS h FROM texts t LEFT JOIN weights USING (doc_id) WHERE t.kind = 'd'
), final AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM final
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= (SELECT count(*) * 5 // 100 FROM final WHERE n_words >= 20) THEN place END AS rank FROM numbered
"""
