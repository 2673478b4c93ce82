"""N-gram Jaccard join as T-occurrence search in the manner of DivideSkip.

A document's set holds the 64-bit hashes of its 5-word shingles. Two sets link
when 100 * intersection >= 75 * union, so they share at least
T = 3/7 (|x| + |y|) shingles. In one global order (rare shingles first) the
last T - 1 lists of a set are its long ones: they are left out of the inverted
lists, and a linked pair must meet in a short list. The short lists are merged
by Spark (shuffled by shingle); the documents they bring together are verified
by binary probes of the long part, here of the whole sorted set.

Skew: equal sets are one class before any list is built. Shingles that many
documents hold come last in the order, so they are in a short list only of
documents that hold hardly anything else. In each list every class is
paired with the list's smallest class only; what this leaves open (members of
a list in different groups by then) is paired with other heads of the list in
further rounds, and in the last round with each other. Pairs that parity bitmaps rule out are never verified. So
a large group of near copies costs pairs in proportion to its size, and no
link between different groups is lost. A class's partners are verified as a
stream, split among tasks when there are many.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; with
fewer than five words the whole sequence is the only shingle; null, empty and
blank texts have no shingles and link with nothing; rows that repeat an id are
documents of their own; null ids come out as they are, and a component is named
by its smallest id that is not null. Equality of shingles is that of their
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlens.llm.common import chunks, fresh, lowered, mix, row_keys, slice_hashes, stored, text_bytes, window_hashes, word_slices
from marketlens.llm.graph import components

WIDTH = 5
#: A shingle found so often among about BATCH_SHINGLES is reported as frequent ...
LOCAL_FREQUENT, BATCH_SHINGLES = 3, 800_000
#: ... and ranked behind the others if all reports together reach this. At most
#: FREQUENT_ROWS of them (the most frequent) are broadcast; the order decides
#: only the work, never the result.
FREQUENT, FREQUENT_ROWS = 32, 1 << 19
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 1 << 20
#: Rounds after the first; the last one leaves no pair open.
ROUNDS = 3
_HASH = np.uint64((1 << 60) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (60 bits) of each text, one after
    another, and their n + 1 offsets."""
    data = lowered(data)
    s, e, first = word_slices(data, offsets)
    word = slice_hashes(data, s, e)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), np.maximum(n - width + 1, 0))
    every = window_hashes(word, width)
    inside = np.repeat(first[1:], n)[:len(every)] - np.arange(len(every)) >= width
    h = every[inside]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        whole = np.array([window_hashes(word[first[i]:first[i + 1]], int(n[i]))[0] for i in few], np.uint64)
        h, text = np.concatenate([h, mix(whole ^ np.uint64(width))]), np.concatenate([text, few])
    h &= _HASH
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit name of each set; sets are equal if their names are."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def bitmaps(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """Parity bitmap of each set: bit b counts, modulo 2, the hashes that are b
    modulo the number of bits (a power of two, two to four per shingle). Bits
    in which two sets differ are at most as many as shingles in which they do."""
    n = np.diff(at)
    bits = 1 << np.maximum(np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 6)
    off = np.concatenate([[0], np.cumsum(bits)])
    place = (h & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(off[:-1], n)
    packed = np.packbits((np.bincount(place, minlength=off[-1]) & 1).astype(np.uint8))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((off // 8).astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())


def _may_link(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bitmaps of the classes do not rule out: a
    linked pair differs in a seventh of all its shingles at most."""
    side = lambda c: maps.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("m" + c))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False) + b.column(3).to_numpy(zero_copy_only=False)
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                if len(x) > len(y):
                    x, y = y, x
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
                keep[i] = 7 * int(np.bitwise_count(x ^ y).sum()) <= n[i]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


#: Longs of the largest bitmap that goes with a list's members.
FOLDED = 8


def _folds(maps: DataFrame) -> DataFrame:
    """(cls, folds): the bitmap of each class XORed down to ``FOLDED`` longs or as
    many as it has, and to half of those (none for one long). The parity of a
    folded cell is that of all its shingles, so two folds of one size differ in
    no more cells than the sets in shingles. Linked sets are so near in size
    that their bitmaps are as long, or one is twice the other."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                x = np.frombuffer(b.column(1)[k].as_buffer(), np.int64)
                top = np.bitwise_xor.reduce(x.reshape(-1, min(len(x), FOLDED)), 0)
                half = np.bitwise_xor.reduce(top.reshape(2, -1), 0) if len(top) > 1 else top[:0]
                out.append([top.tolist(), half.tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.list_(pa.int64())))], names=["cls", "folds"])

    return maps.select("cls", "bits").mapInArrow(run, "cls long, folds array<array<long>>")


def _folds_allow(x: str, y: str) -> str:
    """SQL: the folds of x and y do not rule out a link (``_may_link`` tests the
    whole bitmaps)."""
    differ = lambda i, j: f"aggregate(zip_with({x}f[{i}], {y}f[{j}], (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    size = lambda side, i: f"size({side}f[{i}])"
    cases = " ".join(f"when {size(x, i)} = {size(y, j)} then {differ(i, j)}" for i, j in ((0, 0), (1, 0), (0, 1)))
    return f"7 * case {cases} else 0 end <= {x}.n + {y}.n"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _sets(docs: DataFrame) -> DataFrame:
    """One row per document (kind 0: id, set size, class, bitmap) and per frequent
    shingle of a batch (kind 1: its hash and count)."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        u, c = u[c >= LOCAL_FREQUENT], c[c >= LOCAL_FREQUENT]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32), pa.int32()), pa.nulls(len(u), pa.int64()), pa.array(c, pa.int64()), _long(u), pa.nulls(len(u), pa.binary())], names=["kind", "id", "n", "cls", "bits"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []
        for b in chunks(batches, "t"):
            h, at = shingles(*text_bytes(b.column(1)))
            n, cls = np.diff(at), digests(h, at)
            zero = np.zeros(len(n), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(zero, pa.int32()), b.column(0), pa.array(n, pa.int64()), _long(cls), bitmaps(h, at)], names=["kind", "id", "n", "cls", "bits"])
            one = np.unique(cls, return_index=True)[1]  # equal sets of the batch count once
            mask = np.zeros(len(n), bool)
            mask[one] = True
            held.append(h[np.repeat(mask, n)])
            if sum(map(len, held)) > BATCH_SHINGLES:
                yield often(held)
                held = []
        if held:
            yield often(held)

    return docs.mapInArrow(run, "kind int, id long, n long, cls long, bits binary")


def _postings(docs: DataFrame, frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """(shingle, class, set size, place): the short lists' entries; place is
    the shingle's rank among those of the set, in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, ranks))

    def run(batches: Iterator[pa.RecordBatch]):
        often, rank = shared.value
        for b in chunks(batches, "t"):
            h, at = shingles(*text_bytes(b.column(0)))
            n, cls = np.diff(at), digests(h, at)
            mask = np.zeros(len(n), bool)
            mask[np.unique(cls, return_index=True)[1]] = True
            text = np.repeat(np.arange(len(n)), n)
            h, text = h[mask[text]], text[mask[text]]
            if not len(h):
                continue
            key = h
            if len(often):
                i = np.minimum(np.searchsorted(often, h), len(often) - 1)
                key = h | np.where(often[i] == h, rank[i], 0).astype(np.uint64) << np.uint64(60)
            order = np.lexsort((key, text))
            h, text = h[order], text[order]
            place = np.arange(len(h)) - np.searchsorted(text, text)
            size = n[text]
            keep = place < size - (3 * size + 3) // 4 + 1    # size - ceil(3/4 size) + 1
            yield pa.RecordBatch.from_arrays([_long(h[keep]), _long(cls[text[keep]]), pa.array(size[keep], pa.int32()), pa.array(place[keep], pa.int32())], names=["h", "cls", "n", "place"])

    return docs.select("t").mapInArrow(run, "h long, cls long, n int, place int")


def _within(x: str, y: str) -> str:
    """SQL: by sizes and the places of a shared shingle, x and y may link, and
    the shingle may be the first that they share (that of a linked pair stands
    among the first seventh of the smaller set)."""
    bound = f"least({x}.place, {y}.place) + least({x}.n - {x}.place, {y}.n - {y}.place)"
    smaller = f"if({x}.n <= {y}.n, 7 * ({x}.n - {x}.place) >= 6 * {x}.n, 7 * ({y}.n - {y}.place) >= 6 * {y}.n)"
    return f"4 * least({x}.n, {y}.n) >= 3 * greatest({x}.n, {y}.n) and 7 * ({bound}) >= 3 * ({x}.n + {y}.n) and {smaller}"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) that link. Each a's set is built once per
    stream of its partners."""
    pairs = stored(pairs, "ngram-pairs")
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("salts"))
    pairs = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "salt", "b")
    need = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    named = reps.join(need, "cls", "left_semi").select("id", "cls")
    texts = docs.join(_small(stored(named, "ngram-reps")), "id").select("cls", "t")
    leads = texts.join(_small(pairs.select(F.col("a").alias("cls"), "salt").distinct()), "cls").select(F.col("cls").alias("a"), "salt", F.lit(None).cast("long").alias("b"), "t")
    members = texts.join(_small(pairs.withColumnRenamed("b", "cls")), "cls").select("a", "salt", F.col("cls").alias("b"), "t")
    rows = leads.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict = {"a": None, "set": np.zeros(0, np.uint64)}
        for batch in chunks(batches, "t"):
            h, at = shingles(*text_bytes(batch.column(3)))
            out = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = h[at[i]:at[i + 1]]
                if b is None:
                    held = {"a": a, "set": own.copy()}
                    continue
                other = held["set"]
                x, y = (own, other) if len(own) <= len(other) else (other, own)
                if not len(x) or 4 * len(x) < 3 * len(y) or held["a"] != a:
                    continue
                p = np.minimum(np.searchsorted(y, x), len(y) - 1)  # binary probes
                both = int((y[p] == x).sum())
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _placed(keyed: DataFrame, plain: bool, id_col: str, text_col: str) -> DataFrame:
    """Row key (id), own id, set size, ``component_id`` and the row key of the
    first document of the component, of every document."""
    spark = keyed.sparkSession
    docs = keyed.select(F.col("row_key").alias("id"), F.col(text_col).cast("string").alias("t"))
    sets = stored(_sets(docs), "ngram-sets")
    often = sets.filter("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = often.orderBy(F.desc("n"), "cls").limit(FREQUENT_ROWS).toPandas()
    hashes = rows["cls"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(hashes)
    level = np.clip(np.log2(np.maximum(rows["n"].to_numpy(float), 1)).astype(int) - 4, 1, 15)[order].astype(np.uint64) if len(rows) else np.zeros(0, np.uint64)
    members = sets.filter("kind = 0").select("id", "n", "cls")
    reps = members.filter("n > 0").groupBy("cls").agg(F.min("id").alias("id"))
    token = W.partitionBy("h")
    lists = _postings(docs, hashes[order], level).withColumn("lead", F.min(F.struct("cls", "n", "place")).over(token)).withColumn("last", F.max("cls").over(token))
    lists = stored(lists.filter(F.col("lead.cls") < F.col("last")).select("h", F.struct("cls", "n", "place").alias("m"), "lead").distinct(), "ngram-lists")
    # first round: every class with the heads of its lists
    first = stored(lists.filter("m.cls <> lead.cls and " + _within("m", "lead")).select(F.col("lead.cls").alias("a"), F.col("m.cls").alias("b")).distinct(), "ngram-first")
    maps = sets.filter("kind = 0 and n > 0").select("cls", "n", "bits").dropDuplicates(["cls"])
    links = stored(_verified(_may_link(first, maps), docs, reps), "ngram-links")
    # further rounds: members of one list that are in different groups so far,
    # each with another head of the list; last, all pairs that are still open
    open_, tried, all_links = lists.select("h", "m", F.col("m.cls").alias("cls")), first, links
    for turn in range(1, ROUNDS + 1):
        groups = components(all_links).withColumnRenamed("node", "cls")
        open_ = open_.select("h", "m", "cls").join(groups, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        mixed = open_.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
        open_ = stored(open_.join(mixed, "h", "left_semi"), "ngram-open")
        if turn < ROUNDS:
            head = F.min(F.struct(F.xxhash64("cls", "h", F.lit(turn)).alias("o"), "m", "root")).over(token)
            more = open_.withColumn("lead", head).select("m", "root", F.col("lead.m").alias("l"), F.col("lead.root").alias("lroot"))
            more = more.filter("root <> lroot and " + _within("m", "l")).select(F.least("m.cls", "l.cls").alias("a"), F.greatest("m.cls", "l.cls").alias("b"))
        else:
            folds = stored(_folds(maps.join(open_.select("cls").distinct(), "cls", "left_semi")), "ngram-folds")
            rows = open_.join(folds, "cls").repartition("h")  # both sides of the join read this one exchange
            x, y = rows.select("h", F.col("m").alias("x"), F.col("root").alias("rx"), F.col("folds").alias("xf")), rows.select(F.col("h").alias("k"), F.col("m").alias("y"), F.col("root").alias("ry"), F.col("folds").alias("yf"))
            more = x.join(y, F.expr("h = k and x.cls < y.cls and rx <> ry and " + _within("x", "y") + " and " + _folds_allow("x", "y"))).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        more = stored(more.distinct().join(tried, ["a", "b"], "left_anti"), "ngram-more")
        tried = tried.union(more)
        all_links = all_links.union(stored(_verified(_may_link(more, maps), docs, reps), "ngram-links"))
    links = all_links
    groups = stored(components(links), "ngram-groups").withColumnRenamed("node", "cls")
    placed = members.join(groups, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    own = keyed.select(F.col("row_key").alias("id"), F.col(id_col).cast("long").alias("own"))
    placed = placed.withColumn("own", F.col("id")) if plain else placed.join(own, "id")
    named = placed.filter("n > 0").groupBy("root").agg(F.min("own").alias("component_id"), F.min(F.struct(F.col("own").isNull().alias("none"), "id")).alias("first"))
    out = placed.join(named, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("own")))
    return out.select("id", "own", "n", "component_id", F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("first"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` of every document."""
    found = _placed(*row_keys(df, id_col, text_col), id_col, text_col)
    return found.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group: that of the smallest id (null
    last; of rows that repeat it, that of the smallest hash of its text)."""
    key = fresh(df, "row_key")
    keyed, plain = row_keys(df, id_col, text_col, key)
    narrow = keyed.select(F.col(key).alias("row_key"), *{id_col: 0, text_col: 0})
    gone = _placed(narrow, plain, id_col, text_col).filter("id <> first").select(F.col("id").alias(key))
    return keyed.join(gone, key, "left_anti").select(*df.columns)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for ``near_duplicates``."""
    return rf"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM {documents}),
wt AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM ws),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, n, j, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS s
  FROM wt WINDOW p AS (PARTITION BY doc_id ORDER BY j)) WHERE s IS NOT NULL
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM ws WHERE len(ws) BETWEEN 1 AND 4),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
ln AS (SELECT a, b FROM pr JOIN sz sa ON sa.doc_id = a JOIN sz sb ON sb.doc_id = b WHERE 100 * c >= 75 * (sa.n + sb.n - c)),
ed AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
rc AS (SELECT a AS node, a AS via FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON ed.a = rc.via)
SELECT d.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM {documents} d LEFT JOIN sz USING (doc_id) LEFT JOIN (SELECT node, min(via) AS c FROM rc GROUP BY node) r ON r.node = d.doc_id
"""
