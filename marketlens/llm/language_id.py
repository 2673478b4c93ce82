"""Language identification: multinomial naive Bayes over hashed character
n-grams.

A text becomes the stream of its lower-case letters, with one space between,
before and after words. Every run of 1 to 4 characters of the stream is hashed
into one of ``BUCKETS`` columns. Training counts columns per language; the
smoothed log probabilities (languages x buckets) are broadcast with the
scoring function, which adds up the rows of a text's n-grams, as a sparse
matrix of occurrences times the dense one, for a batch of texts at once.

Training takes each row with the chance ``rows_per_language`` / rows of its
language, decided by a hash of its id and text, so about that many of each
language, or all if there are fewer (whole texts; the counts are grouped by
Spark, and only languages x buckets numbers reach the driver); the prior is the
share of all rows. Scoring reads every character of every text.

``score`` is the posterior of the predicted language, the evidence divided by
the number of n-gram orders, since the orders count the same letters. Log
probabilities are whole thousandths, so equal texts have equal scores anywhere.

Defined results: null texts and texts without a letter are ``und`` with score
0; so is everything if no language is learned. Rows of a null language or a
null id are not learnt from. Languages that tie are taken in alphabetic order.
A column of the output's name is replaced; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, text_bytes

BUCKET_BITS = 16
BUCKETS, ORDERS = 1 << BUCKET_BITS, 4
SPACE = 32
#: Characters hashed at once; longer texts are cut, with ORDERS - 1 in common.
PIECE = 1 << 16
UNKNOWN = "und"
SHARE = 1 << 32

_MULTIPLIER = np.uint32(0x9E3779B1)
_letters: list[np.ndarray] = []


def _folded(c: int) -> int:
    x = chr(c)
    return ord(x.lower()[0]) if x.isalpha() else SPACE


def folded(point: np.ndarray) -> np.ndarray:
    """Lower case of each letter's code point, space for all others."""
    if not _letters:
        _letters.append(np.array([_folded(c) for c in range(1 << 16)], np.uint32))
    out = _letters[0][point & 0xFFFF]
    rare = np.flatnonzero(point >> 16)
    if len(rare):
        some, which = np.unique(point[rare], return_inverse=True)
        out[rare] = np.array([_folded(int(c)) for c in some], np.uint32)[which]
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and their n + 1 offsets."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
    point = np.where(size == 1, first, first & (np.uint32(0x7F) >> size.astype(np.uint32)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        point[more] = (point[more] << np.uint32(6)) | (data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F)
    return np.minimum(point, 0x10FFFF), np.searchsorted(at, offsets)


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter streams of all texts one after another, and their offsets; a text
    without a letter has the empty stream."""
    point, off = code_points(data, offsets)
    n = len(off) - 1
    at = off + 2 * np.arange(n + 1)  # one more space before and after each text
    char = np.full(at[-1], SPACE, np.uint32)
    char[np.arange(len(point)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = folded(point)
    letter = char != SPACE
    count = np.concatenate([[0], np.cumsum(letter)])
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = np.diff(count[at]) > 0
    return char[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def columns(char: np.ndarray, orders: int = ORDERS) -> Iterator[np.ndarray]:
    """Hashed column of the n-gram that starts at each character, for n = 1 ...
    ``orders``: len(char) - n + 1 values each."""
    h = np.zeros(len(char), np.uint32)
    for n in range(1, orders + 1):
        if len(char) < n:
            return
        h = (h[:len(char) - n + 1] + char[n - 1:] + np.uint32(n)) * _MULTIPLIER
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)


def occurrences(char: np.ndarray, off: np.ndarray, orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (text number, column) of all n-grams within one text."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for lo in range(0, len(char), PIECE):
        some, of = char[lo:lo + PIECE + orders - 1], text[lo:lo + PIECE + orders - 1]
        for n, col in enumerate(columns(some, orders), 1):
            k = min(PIECE, len(col))  # those that start in this piece
            inside = of[:k] == of[n - 1:n - 1 + k]
            yield of[:k][inside], col[:k][inside]


class Model:
    """Languages in alphabetic order, and one row of whole thousandths of log
    probabilities per column."""

    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        share = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True) if len(languages) else counts
        self.log = np.maximum(np.round(1000 * np.log(share)), -32_000).astype(np.int32).T.copy()
        self.prior = np.round(1000 * np.log(rows / rows.sum())).astype(np.int64) if len(languages) else rows

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text (-1: no letter) and its posterior."""
        n = len(offsets) - 1
        if not self.languages or n == 0:
            return np.full(n, -1), np.zeros(n)
        char, off = streams(data, offsets)
        total = np.zeros((n, len(self.languages)), np.int64)
        for text, col in occurrences(char, off):
            edge = np.flatnonzero(np.diff(text, prepend=-1))
            if len(edge):
                # a piece has room in 32 bits: PIECE values of under 2^15
                total[text[edge]] += np.add.reduceat(self.log[col], edge, axis=0)
        z = (total / ORDERS + self.prior) / 1000
        best = z.argmax(1)
        score = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        none = np.diff(off) == 0
        return np.where(none, -1, best), np.where(none, 0.0, np.round(score, 9))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1500) -> Model:
    """Learn from the rows of ``docs`` (which the caller has cut to those that
    may be learnt from)."""
    rows = docs.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).filter("k is not null and l is not null")
    known = {x.l: x.n for x in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(known)
    # a row is learnt if its hash falls into its language's share: no ordering of a language's rows
    shares = docs.sparkSession.createDataFrame([(x, min(SHARE, SHARE * rows_per_language // known[x])) for x in names], "l string, share long")
    texts = rows.join(F.broadcast(shares), "l").filter(F.pmod(F.xxhash64("k", "t"), F.lit(SHARE)) < F.col("share")).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]):
        total: dict[str, np.ndarray] = {}
        for b in chunks(batches, "t"):
            char, off = streams(*text_bytes(b.column(1)))
            label = np.array(b.column(0).to_pylist(), object)
            for text, col in occurrences(char, off):
                for lang in set(label[np.unique(text)]):
                    mine = col[label[text] == lang]
                    total[lang] = total.get(lang, 0) + np.bincount(mine, minlength=BUCKETS)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["l", "col", "n"])

    counts = np.zeros((len(names), BUCKETS))
    at = {x: i for i, x in enumerate(names)}
    found = texts.mapInArrow(count, "l string, col int, n long").groupBy("l", "col").agg(F.sum("n").alias("n")).toArrow()
    for lang, col, n in zip(found["l"].to_pylist(), found["col"].to_pylist(), found["n"].to_pylist(), strict=True):
        counts[at[lang], col] = n
    return Model(names, counts, np.array([known[x] for x in names], float))


def predict(df: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the language of each whole text and its score."""
    names = [c for c in df.columns if c not in (lang_col, score_col)]
    kept = df.select(*names)
    at = names.index(text_col)
    schema = kept.withColumn(lang_col, F.lit("")).withColumn(score_col, F.lit(0.0)).schema
    languages = pa.array([*model.languages, UNKNOWN], pa.string())

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, text_col, PIECE * 4):
            best, score = model.predict(*text_bytes(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, languages.take(pa.array(best % len(languages))), pa.array(score)], names=[*names, lang_col, score_col])

    return kept.mapInArrow(run, schema)
