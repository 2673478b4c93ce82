"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that together cover the
whole document. Learned filters slide over a chunk, each keeps its largest
response (max-pool), a hidden layer turns the pooled responses into a chunk
score, and the mean of the chunk scores gives the document's probability.

Training takes a bounded sample of labelled rows (``sample_rows`` rows with
the smallest hashes of their id, ``sample_chunks`` chunks spread over each
text at most); scoring reads every byte of every text. Only the text enters a
score.

Defined results: null and empty texts are scored as one chunk of padding;
rows without a label, or with a null label, are not learnt from; with no
labelled rows every score is 0.5; equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, ragged, text_bytes

CHUNK, STEP = 256, 192   # chunks of 256 bytes start every 192 bytes
WIDTH, STRIDE = 8, 2     # filters read 8 bytes, every second byte
EMBED, FILTERS, HIDDEN = 4, 24, 16


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these sizes: each chunk's text and its start in it."""
    count = np.maximum(1, -(-(np.maximum(sizes, 1) - (CHUNK - STEP)) // STEP))
    text = np.repeat(np.arange(len(sizes)), count)
    return text, ragged(np.zeros(len(sizes), np.int64), count) * STEP


def chunk_matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of each chunk, padded with 0."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0)


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)), "filter": r.normal(0, 0.25, (WIDTH * EMBED, FILTERS)), "fbias": np.zeros(FILTERS),
            "hidden": r.normal(0, 0.3, (FILTERS, HIDDEN)), "hbias": np.zeros(HIDDEN), "out": r.normal(0, 0.3, HIDDEN), "obias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def windows(self, chunk: np.ndarray) -> np.ndarray:
        e = self.p["embed"][chunk]  # chunks x CHUNK x EMBED
        n = (CHUNK - WIDTH) // STRIDE + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(chunk), n, WIDTH * EMBED), (s[0], STRIDE * s[1], s[2]))

    def pooled(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.windows(chunk)
        r = (w.reshape(-1, WIDTH * EMBED) @ self.p["filter"]).reshape(*w.shape[:2], FILTERS)
        at = r.argmax(1)
        return np.take_along_axis(r, at[:, None], 1)[:, 0] + self.p["fbias"], at, w

    def scores(self, chunk: np.ndarray) -> np.ndarray:
        w = self.windows(chunk)
        r = (w.reshape(-1, WIDTH * EMBED) @ self.p["filter"]).reshape(*w.shape[:2], FILTERS).max(1) + self.p["fbias"]
        return np.maximum(np.tanh(r) @ self.p["hidden"] + self.p["hbias"], 0) @ self.p["out"] + self.p["obias"]

    def gradients(self, chunk: np.ndarray, doc: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over documents; doc: the document of each chunk."""
        p, n = self.p, len(label)
        m, at, w = self.pooled(chunk)
        a = np.tanh(m)
        h = np.maximum(a @ p["hidden"] + p["hbias"], 0)
        s = h @ p["out"] + p["obias"]
        per = np.bincount(doc, minlength=n)
        z = np.bincount(doc, s, n) / per
        d = ((1 / (1 + np.exp(-z)) - label) / n / per)[doc].astype(np.float32)
        g = {"out": h.T @ d, "obias": np.array([d.sum()])}
        dh = d[:, None] * p["out"] * (h > 0)
        g["hidden"], g["hbias"] = a.T @ dh, dh.sum(0)
        dm = (dh @ p["hidden"].T) * (1 - a * a)
        g["fbias"] = dm.sum(0)
        rows = np.arange(len(chunk))[:, None]
        picked = w[rows, at]  # chunks x FILTERS x WIDTH*EMBED: the windows that gave the maxima
        g["filter"] = np.einsum("cfk,cf->kf", picked, dm)
        back = (dm[:, :, None] * p["filter"].T).reshape(-1, EMBED)
        byte = chunk[rows[:, :, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)].reshape(-1)
        g["embed"] = np.stack([np.bincount(byte, back[:, k], 256) for k in range(EMBED)], 1)
        return g


def train(docs: list[np.ndarray], labels: np.ndarray, *, epochs: int = 8, batch: int = 48, rate: float = 0.004, seed: int = 7) -> Network:
    """Adam on the log loss of documents, each given by a matrix of chunks.
    Small samples get more epochs, so that there are 300 steps at least."""
    net, r = Network(seed), np.random.default_rng(seed)
    if not len(labels):
        net.p["out"][:], net.p["obias"][:] = 0, 0
        return net
    mean = np.clip(labels.mean(), 0.01, 0.99)
    net.p["obias"][:] = np.log(mean / (1 - mean))
    m1, m2, step = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    per_epoch = -(-len(labels) // batch)
    epochs = max(epochs, -(-300 // per_epoch))
    total = epochs * per_epoch
    for _ in range(epochs):
        order = r.permutation(len(labels))
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            doc = np.repeat(np.arange(len(some)), [len(docs[i]) for i in some])
            step += 1
            now = rate * min(1.0, step / 30) * (1 - 0.9 * step / total)
            for k, g in net.gradients(np.concatenate([docs[i] for i in some]), doc, labels[some]).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                net.p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_chunks(data: np.ndarray, offsets: np.ndarray, most: int) -> list[np.ndarray]:
    """Per text a matrix of at most ``most`` of its chunks, spread evenly over
    the whole text."""
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        start = chunk_starts(np.array([hi - lo]))[1]
        if len(start) > most:
            start = start[np.linspace(0, len(start) - 1, most).astype(int)]
        out.append(chunk_matrix(data, lo + start, np.full(len(start), hi)))
    return out


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray, rows: int = 512) -> np.ndarray:
    doc, start = chunk_starts(np.diff(offsets))
    score = np.empty(len(doc))
    for lo in range(0, len(doc), rows):
        d = doc[lo:lo + rows]
        score[lo:lo + rows] = net.scores(chunk_matrix(data, offsets[d] + start[lo:lo + rows], offsets[d + 1]))
    # a document's mean from its own chunks alone, so that equal texts score alike wherever they stand
    z = np.add.reduceat(np.round(score, 5), np.searchsorted(doc, np.arange(len(offsets) - 1))) / np.bincount(doc)
    return 1 / (1 + np.exp(-np.round(z, 4)))


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", sample_rows: int = 3000, sample_chunks: int = 24, epochs: int = 10) -> Network:
    """Train on the texts of the ``sample_rows`` rows of ``labels`` whose ids
    have the smallest hashes, with ``sample_chunks`` chunks of each at most.
    The sample is broadcast; what comes to the driver is at most sample_rows x
    sample_chunks x 256 bytes (times the copies of an id in ``docs``)."""
    sample = (
        labels.select(F.col(id_col).alias("k"), F.xxhash64(F.col(id_col)).alias("h"), F.col(label_col).cast("double").alias("y"))
        .filter("k is not null and y is not null").orderBy("h", "y").limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(sample), "k").select("h", "y", "t")

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, "t"):
            data, offsets = text_bytes(b.column(2))
            found = [m.astype(np.uint8).tobytes() for m in training_chunks(data, offsets, sample_chunks)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["h", "y", "m"])

    rows = sorted(texts.mapInArrow(cut, "h long, y double, m binary").collect(), key=lambda x: (x.h, x.y, x.m))
    return train([np.frombuffer(x.m, np.uint8).reshape(-1, CHUNK) for x in rows], np.array([x.y for x in rows]), epochs=epochs)


def score(df: DataFrame, net: Network, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 of each whole text."""
    names = [c for c in df.columns if c != score_col]
    at = names.index(text_col)
    schema = df.select(*names).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, text_col):
            data, offsets = text_bytes(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probabilities(net, data, offsets))], names=[*names, score_col])

    return df.select(*names).mapInArrow(run, schema)
