"""Removal of long byte strings that occur more than once, by suffix sorting.

Shards: a window of ``LENGTH`` bytes is filed under the least hash of its
32-byte substrings, so equal windows have the same key and meet in one shard.
Consecutive windows of one key are one segment of text. Keys that occur once
in all documents cannot hold equal windows (but in periodic text); a bitmap of fixed size leaves most
of their segments out (a crowded bitmap leaves out fewer, which costs work
only). Equal segments of a batch are one row with a list of places. In a shard
the segments' suffixes are sorted by external induced sorting
(``induced_sort``), a few megabytes of complete keys at a time, or one key's
segments with queues on disk; suffixes next to each other that share ``LENGTH``
bytes are repeated windows.

Defined results: null and empty texts have no bytes; matches never cross
documents; every occurrence is removed, the first included; overlapping and
adjoining windows make one removed run; strings are judged on the input; rows
without an id or that repeat one are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, mix, powers, ragged, row_keys, slice_hashes, text_bytes
from marketlens.llm.induced_sort import repeated
from marketlens.llm.recompression import _runs, _sorted_groups

LENGTH, GRAIN = 400, 32
BITS = 1 << 26
#: Bytes of segments that are sorted at once (more if one key has more).
SHARD_BYTES = 3 << 20


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of x[i:i + width] for every i that has
    so many values."""
    fill = np.full(-len(x) % width + width, x.dtype.type(0) if best is np.maximum else ~x.dtype.type(0))
    rows = np.concatenate([x, fill]).reshape(-1, width)
    behind = best.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    ahead = best.accumulate(rows, 1).reshape(-1)
    n = len(x) - width + 1
    return best(behind[:n], ahead[width - 1:width - 1 + n])


def windows(data: np.ndarray, offsets: np.ndarray, length: int, twice: bool = False):
    """Runs of windows with one key: key, text, first window, windows; if
    ``twice`` also the keys whose least substring occurs again in a run (as in
    periodic texts, where the windows of one run can equal each other)."""
    n = len(data)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    place = ragged(offsets[:-1], count)
    if not len(place):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z.astype(np.uint64)
    grain = min(GRAIN, length)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(np.arange(256, dtype=np.uint64))[data] * powers(n), out=sums[1:])
    h = mix((sums[grain:] - sums[:-grain]) * powers(n - grain + 1, inverse=True))
    width = length - grain + 1
    least = _slide(h, width, np.minimum)
    key = least[place]
    text = np.repeat(np.arange(len(count)), count)
    cut = np.ones(len(place), bool)
    cut[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at, size = _runs(cut)
    again = np.zeros(0, np.uint64)
    if twice:
        own = np.zeros(len(h) + width - 1, np.uint64)
        own[place + width - 1] = key  # windows by their last substring
        chosen = np.flatnonzero(h == _slide(own, width, np.maximum))
        near = (h[chosen][1:] == h[chosen][:-1]) & (np.diff(chosen) < n)
        again = h[chosen[1:][near]]
    return key[at], text[at], place[at] - offsets[text[at]], size, again


def _copies(key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Sorted by segment: the order, and where a new segment begins in it."""
    name = slice_hashes(data, start, end) ^ mix(key)
    order = np.argsort(name, kind="stable")
    new = np.append(True, name[order][1:] != name[order][:-1])
    return order, new


def repeated_keys(docs: DataFrame, length: int) -> np.ndarray:
    """Bitmap (bytes) of the keys of at least two runs of windows."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, "t"):
            key, _, _, _, again = windows(*text_bytes(b.column(1)), length, twice=True)
            key, n = np.unique(np.concatenate([key, again]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    often = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    slots = often.select(F.expr(f"pmod(key, {BITS}L) div 64").cast("int").alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(key, {BITS}L) % 64 as int))").alias("bit"))
    rows = slots.groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


_ROWS = "key long, seg binary, ids array<long>, at array<long>"


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))


def repeated_windows(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(id, p, n): runs of n windows from byte p on that also start elsewhere."""
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_keys(docs, length))

    def segments(batches: Iterator[pa.RecordBatch]):
        bits = bitmap.value
        for b in chunks(batches, "t"):
            data, offsets = text_bytes(b.column(1))
            key, text, p, n, _ = windows(data, offsets, length)
            slot = key % np.uint64(BITS)
            live = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            key, text, p, n = key[live], text[live], p[live], n[live]
            if not len(key):
                continue
            start = offsets[text] + p
            size = n + length - 1
            order, new = _copies(key, data, start, start + size)
            lead = order[new]
            cuts = np.append(np.flatnonzero(new), len(order))
            ids = b.column(0).to_numpy(zero_copy_only=False)[text[order]]
            for i in range(0, len(lead), 2000):
                some = lead[i:i + 2000]
                c = cuts[i:i + 2001]
                blob = np.concatenate([[0], np.cumsum(size[some])])
                seg = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(blob.astype(np.int64)), pa.py_buffer(data[ragged(start[some], size[some])])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), seg, _lists(ids[c[0]:c[-1]], c - c[0]), _lists(p[order][c[0]:c[-1]], c - c[0])], names=["key", "seg", "ids", "at"])

    def resolve(batches: Iterator[pa.RecordBatch]):
        for table in _shards(_sorted_groups(_thin(batches))):
            yield from _repeats(table.combine_chunks(), length)

    rows = docs.select("id", "t").mapInArrow(segments, _ROWS)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(resolve, "id long, p long, n long")


def _thin(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            yield b.slice(i, 1000)


def _shards(groups: Iterator[pa.Table]):
    """Tables of complete keys with about SHARD_BYTES of segments."""
    held, size = [], 0
    for t in groups:
        held.append(t)
        size += t.column(1).nbytes
        if size >= SHARD_BYTES:
            yield pa.concat_tables(held)
            held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def _repeats(table: pa.Table, length: int):
    if not table.num_rows:
        return
    key = table.column(0).to_numpy().view(np.uint64)
    data, offsets = text_bytes(table.column(1))
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(2), table.column(3))]
    places = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
    ids, at = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()
    order, new = _copies(key, data, offsets[:-1], offsets[1:])
    first = np.flatnonzero(new)
    copy_of = np.empty(len(order), np.int64)  # the segment that each row is a copy of
    copy_of[order] = np.cumsum(new) - 1
    lead = order[first]
    copies = np.bincount(copy_of, weights=np.diff(places), minlength=len(lead))
    # segments of keys that only one segment has are settled by their copies
    seg_key = key[lead]
    _, back, rivals = np.unique(seg_key, return_inverse=True, return_counts=True)
    # ... unless windows of one segment may equal each other
    alone = (rivals[back] == 1) & ((offsets[lead + 1] - offsets[lead] == length) | (copies > 1))
    size = offsets[lead + 1] - offsets[lead]
    sort = np.flatnonzero(~alone)
    hit = [np.zeros(0, bool)] * len(lead)
    if len(sort):
        body = data[ragged(offsets[lead[sort]], size[sort])].astype(np.uint16) + 1
        stops = np.cumsum(size[sort])
        text = np.insert(body, stops, 0)
        found = repeated(text, length)
        begin = stops - size[sort] + np.arange(len(sort))
        for i, b, n in zip(sort.tolist(), begin.tolist(), size[sort].tolist(), strict=True):
            hit[i] = found[b:b + n - length + 1]
    out_id, out_p, out_n = [], [], []
    for row in range(len(key)):
        s = int(copy_of[row])
        windows_ = int(size[s]) - length + 1
        if copies[s] > 1:
            begin, count = np.zeros(1, np.int64), np.array([windows_])
        elif len(hit[s]) and hit[s].any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[s], [False]]).astype(np.int8)))
            begin, count = edge[::2], edge[1::2] - edge[::2]
        else:
            continue
        lo, hi = places[row], places[row + 1]
        out_id.append(np.repeat(ids[lo:hi], len(begin)))
        out_p.append((at[lo:hi, None] + begin).reshape(-1))
        out_n.append(np.tile(count, hi - lo))
    if out_id:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_id, out_p, out_n)], names=["id", "p", "n"])


def deduplicated(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the
    kept bytes of every document."""
    keyed, _ = row_keys(df, id_col, text_col)
    docs = keyed.select(F.col("row_key").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("own"))
    gone = repeated_windows(docs, length=length).groupBy("id").agg(F.collect_list(F.struct("p", "n")).alias("runs"))  # at most the windows of one document
    both = docs.join(gone, "id", "left").select("own", "t", F.col("runs.p").alias("p"), F.col("runs.n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, "t"):
            data, offsets = text_bytes(b.column(1))
            change = np.zeros(len(data) + 1, np.int32)
            for i in np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                p, n = b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy()
                np.add.at(change, np.minimum(offsets[i] + p, offsets[i + 1]), 1)
                np.add.at(change, np.minimum(offsets[i] + p + n + length - 1, offsets[i + 1]), -1)
            gone_ = np.cumsum(change[:-1]) > 0
            starts = gone_.copy()
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            starts[1:] &= ~gone_[:-1] | edge[1:len(data)]
            upto, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone_, starts))
            kept = [data[lo:hi][~gone_[lo:hi]].tobytes() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(upto[offsets]), pa.int64()), pa.array(np.diff(runs[offsets]), pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
