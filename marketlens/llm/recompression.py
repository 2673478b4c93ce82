"""Substring deduplication of token sequences by recompression.

Each round names the runs of a symbol, then the pairs (a, b) of a left and a
right symbol; sides come from a hash of the symbol, and names are hashes of what
they stand for, so all tasks give the same names without exchanging any. Equal
substrings get the same symbols inside; which neighbouring words a symbol's
making depended on is carried along as its context. A window of ``WINDOW`` words
is filed under the highest-level symbol whose context lies inside the window
(the least hash among several, the leftmost of equal ones), so equal windows
have equal symbols and meet in one place.

A batch drops the windows it has seen itself (they are removed already), then
one row per symbol occurrence carries 40-bit hashes of the windows filed under
it to where the symbol's occurrences are sorted; the windows that agree there in
symbol, offset and hash are equal, and all but the first are removed. So a
passage that every document holds costs one row per batch and symbol.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null, empty and
short texts keep all words; of equal windows the first stands in the document
of the smallest id (null lowest), then at the earliest place; rows that repeat
an id or have none are documents of their own, in the order of the SHA-256 of
their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, mix, powers, ragged, row_keys, slice_hashes, text_bytes, window_hashes, word_slices

WINDOW, ROUNDS = 20, 2
_FAR = 1 << 40
_LEFT, _RIGHT, _RUN = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def recompress(name: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, edge: np.ndarray, level: int):
    """One round: names, first words, contexts and text edges of the symbols."""
    # runs of one symbol; that a run ends is known from both neighbours
    head = edge.copy()
    head[1:] |= name[1:] != name[:-1]
    a = np.flatnonzero(head)
    size = np.diff(np.append(a, len(name)))
    last = a + size - 1
    run = np.where(size > 1, mix(name[a] + size.astype(np.uint64) * _RUN), name[a])
    first = edge[a]
    before = np.where(first, -_FAR, lo[a - 1])
    after = np.append(lo[:0], np.where(np.append(first[1:], True), _FAR, hi[np.append(a[1:], 0)]))
    name, start, edge = run, start[a], first
    lo, hi = np.minimum(lo[a], before), np.maximum(hi[last], after)
    # pairs of a left and a right symbol
    side = (mix(name + np.array([level + 1], np.uint64) * _LEFT) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(name), bool)  # with the next one
    joins[:-1] = ~side[:-1] & side[1:] & ~edge[1:]
    joined = np.zeros(len(name), bool)
    joined[1:] = joins[:-1]
    nxt = np.append(np.where(edge[1:], _FAR, hi[1:]), _FAR)
    prv = np.concatenate([[-_FAR], lo[:-1]])
    prv[edge] = -_FAR
    alone = ~joins & ~joined
    new_hi = np.where(joins, np.append(hi[1:], 0), np.where(alone & ~side, np.maximum(hi, nxt), hi))
    new_lo = np.where(alone & side, np.minimum(lo, prv), lo)
    new_lo = np.where(joins, np.minimum(lo, np.append(lo[1:], 0)), new_lo)
    new_hi = np.where(joins, np.maximum(hi, new_hi), new_hi)
    pair = name.copy()
    j = np.flatnonzero(joins)
    pair[j] = mix(name[j] * _LEFT + name[j + 1] * _RIGHT)
    keep = ~joined
    return pair[keep], start[keep], new_lo[keep], new_hi[keep], edge[keep]


def anchors(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the word hashes of texts (text t has the words first[t] to
    first[t + 1]): all places of windows, the key each is filed under, the
    place that the key's symbol is known from, and the window's hash."""
    n = len(word)
    sizes = np.maximum(np.diff(first) - WINDOW + 1, 0)
    place = ragged(first[:-1], sizes)
    if not len(place):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z.astype(np.uint64)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    at = np.arange(n)
    symbols = (word, at, at, at, edge[:n].copy())
    levels = [symbols]
    for level in range(ROUNDS):
        symbols = recompress(*symbols, level)
        levels.append(symbols)
    window = np.zeros(n, bool)
    window[place] = True
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word * powers(n), out=sums[1:])
    inverse = powers(n + 1, inverse=True)
    key, anchor = np.zeros(n, np.uint64), np.full(n, -1)
    for level in range(ROUNDS, -1, -1):
        if not window.any():
            break
        name, start, lo, hi, _ = levels[level]
        ok = (hi - lo < WINDOW) & (lo >= 0) & (hi < n)
        name, start, lo, hi = name[ok], start[ok], lo[ok], hi[ok]
        own = mix((sums[hi + 1] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * _RIGHT + mix(name + (start - lo).astype(np.uint64) * _RUN + np.uint64(level)))
        from_ = np.maximum(hi - WINDOW + 1, 0)
        count = lo - from_ + 1
        p = ragged(from_, count)
        owner = np.repeat(np.arange(len(lo)), count)
        live = window[p]
        p, owner = p[live], owner[live]
        best = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        np.minimum.at(best, p, own[owner])
        hit = np.flatnonzero(best[p] == own[owner])[::-1]  # the leftmost is written last
        key[p[hit]] = own[owner[hit]]
        anchor[p[hit]] = lo[owner[hit]]
        window[p[hit]] = False
    return place, key[place], anchor[place], window_hashes(word, WINDOW)[place]


_ROWS = "key long, id long, p long, off int, h binary"


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches that begin where ``breaks`` is True."""
    s = np.flatnonzero(breaks)
    return s, np.diff(np.append(s, len(breaks)))


def _occurrences(batches: Iterator[pa.RecordBatch]):
    for b in chunks(batches, "t", 2 << 20):
        b = b.take(pa.array(np.argsort(b.column(0).to_numpy(zero_copy_only=False), kind="stable")))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(b.column(1))
        s, e, first = word_slices(data, offsets)
        place, key, anchor, h = anchors(slice_hashes(data, s, e), first)
        if not len(place):
            continue
        text = np.searchsorted(first, place, side="right") - 1
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        lead = np.flatnonzero(np.append(True, ~same))
        lead = order[np.repeat(lead, np.diff(np.append(lead, len(h))))]  # the first of each one's equals
        again[order] = (ids[text[lead]] != ids[text[order]]) | (place[lead] - first[text[lead]] != place[order] - first[text[order]])
        cut = np.ones(len(h), bool)
        cut[1:] = (place[1:] != place[:-1] + 1) | (text[1:] != text[:-1]) | (again[1:] != again[:-1]) | (~again[1:] & ((anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])))
        at, size = _runs(cut)
        gone = again[at]
        five = np.ascontiguousarray((h >> np.uint64(24)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        sent = np.where(gone, 0, size)
        blob = np.concatenate([[0], np.cumsum(sent * 5)])
        hashes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(blob.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(five[~again]))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.where(gone, mix(key[at] ^ place[at].astype(np.uint64)), key[at]).view(np.int64)), pa.array(ids[text[at]]), pa.array(place[at] - first[text[at]]),
            pa.array(np.where(gone, size, place[at] - anchor[at]).astype(np.int32)), hashes], names=["key", "id", "p", "off", "h"])


def _later(rows: pa.Table | pa.RecordBatch):
    """Runs (id, start, length) of the windows that are not the first of their
    equals, among complete groups of keys."""
    key, ids, p, off = (rows.column(i).to_numpy() if isinstance(rows, pa.Table) else rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    data, offsets = text_bytes(rows.column(4))
    size = np.diff(offsets) // 5
    local = size == 0
    out = [(ids[local], p[local], off[local].astype(np.int64))]
    row = np.repeat(np.arange(len(size)), size)
    if len(row):
        step = ragged(np.zeros(len(size), np.int64), size)
        h = np.zeros((len(row), 8), np.uint8)
        h[:, :5] = data.reshape(-1, 5)
        h = h.view("<u8").reshape(-1)
        where = p[row] + step
        name = mix(key[row].view(np.uint64)) + mix(h + (off[row] + step + 4096).astype(np.uint64) * _RUN)
        order = np.lexsort((where, ids[row], name))
        same = (name[order][1:] == name[order][:-1])
        lead = np.flatnonzero(np.append(True, ~same))
        lead = order[np.repeat(lead, np.diff(np.append(lead, len(order))))]
        again = np.zeros(len(row), bool)
        again[order] = (ids[row[lead]] != ids[row[order]]) | (where[lead] != where[order])
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (again[1:] != again[:-1])
        at, length = _runs(cut)
        keep = again[at]
        out.append((ids[row[at[keep]]], where[at[keep]], length[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _sorted_groups(batches: Iterator[pa.RecordBatch]):
    """Tables of complete key groups from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(id, p, n): runs of n windows from word p on that start earlier, too.
    ``docs`` has the columns id (not null) and t."""

    def resolve(batches: Iterator[pa.RecordBatch]):
        for table in _sorted_groups(batches):
            ids, p, n = _later(table.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(p), pa.array(n, pa.int64())], names=["id", "p", "n"])

    rows = docs.select("id", "t").mapInArrow(_occurrences, _ROWS)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(resolve, "id long, p long, n long")


def deduplicated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept") -> DataFrame:
    """id, ``n_words``, ``n_removed``, ``kept_sha256`` and the kept text of
    every document."""
    keyed, _ = row_keys(df, id_col, text_col)
    docs = keyed.select(F.col("row_key").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("own"))
    gone = repeated_runs(docs).groupBy("id").agg(F.collect_list(F.struct("p", "n")).alias("runs"))  # at most the windows of one document
    both = docs.join(gone, "id", "left").select("own", "t", F.col("runs.p").alias("p"), F.col("runs.n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, "t"):
            data, offsets = text_bytes(b.column(1))
            s, e, first = word_slices(data, offsets)
            change = np.zeros(len(s) + 1, np.int64)
            for i in np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                p, n = b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy()
                np.add.at(change, np.minimum(first[i] + p, first[i + 1]), 1)
                np.add.at(change, np.minimum(first[i] + p + n + WINDOW - 1, first[i + 1]), -1)
            stays = np.cumsum(change)[:-1] == 0
            raw, texts = data.tobytes(), []
            starts, ends = s.tolist(), e.tolist()
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                texts.append(b" ".join([raw[starts[k]:ends[k]] for k in (np.flatnonzero(stays[lo:hi]) + lo).tolist()]))
            kept = np.add.reduceat(np.append(stays, False), np.append(first[:-1], len(s)))[:-1] if len(texts) else np.zeros(0)
            kept = np.where(np.diff(first) > 0, kept, 0)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(first), pa.int64()),
                pa.array((np.diff(first) - kept).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = both.mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("kept", kept_col)


def oracle(documents: str = "documents", window: int = WINDOW) -> str:
    """DuckDB SQL for the digest columns of ``deduplicated``."""
    return rf"""
WITH ws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {documents}),
wt AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM ws),
wn AS (SELECT doc_id, j, w, CASE WHEN j + {window - 1} <= n THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) END AS s FROM wt),
fl AS (SELECT doc_id, j, w, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, j) > 1 THEN 1 ELSE 0 END AS later FROM wn),
cv AS (SELECT doc_id, j, w, max(later) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM fl),
kp AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM cv GROUP BY doc_id)
SELECT ws.doc_id, CAST(len(ws.ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM ws LEFT JOIN kp USING (doc_id)
"""
