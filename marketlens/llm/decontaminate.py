"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations
alone.

Words are the runs of letters and digits of the lower-cased text. A document
leaks a benchmark item when ``WINDOW`` consecutive words of the item lie, in
line, over words of the document with at most ``MISMATCHES`` substitutions; an
item shorter than that must occur whole, and one of fewer than six words is
too short to tell.

Fixed masks ignore chosen word positions (``0``); any 12 words with two
substitutions leave one of the three masks unharmed somewhere, so joining the
hashes of masked words of both sides misses no such leak. All masks begin
with three words: a bitmap of the benchmark's hashed word triples (a literal of
fixed size) says at which positions of a document masks are hashed at all. The
overlap around each hit is then verified word by word.

Defined results: null and empty texts leak nothing; documents or items without
an id take no part; rows that repeat an id are judged one by one and any of
them counts; a leak found in several places is reported once, with the most
equal words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that count (1) or are ignored (0); all begin with 111.
MASKS = ("111011", "1110011", "11100011")
WINDOW, MISMATCHES, SHORTEST = 12, 2, 6
BITS = 1 << 20
#: Rows up to which a side is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _split(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Kept columns and the words ``w`` of texts with enough of them. The
    generator keeps the optimizer from putting the split into every use of w."""
    return df.select(*keep, F.explode(F.array(words(F.col(text)))).alias("w")).filter(F.size("w") >= SHORTEST)


def _masked(mask: str, w: Column, i: Column) -> Column:
    """Hash of the words under the mask at position i (null beyond the end)."""
    last = F.get(w, i + (len(mask) - 1))
    return F.when(last.isNotNull(), F.xxhash64(F.lit(len(mask)), *[F.get(w, i + k) for k, bit in enumerate(mask) if bit == "1"]))


def _slot(x: Column, y: Column, z: Column) -> Column:
    """Place of a word triple in the bitmap (words beyond the end are null)."""
    return F.xxhash64(x, y, z).bitwiseAND(F.lit(BITS - 1))


def _starts(df: DataFrame, keep: str) -> DataFrame:
    """A row for each position ``at``, with the words ``w`` and its triple's
    slot. Generator, filter and hashes run as one generated function, so the
    words are not copied for positions that are filtered out."""
    n = F.size("w")
    triples = F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, n).alias("y"), F.slice("w", 3, n).alias("z"))
    rows = df.select(keep, "w", F.posexplode(triples).alias("at", "t"))
    return rows.select(keep, "w", "at", _slot(F.col("t.x"), F.col("t.y"), F.col("t.z")).alias("slot"))


def _seeds(starts: DataFrame, keep: str) -> DataFrame:
    """One row per start and mask: ``at`` and ``seed``."""
    every = F.array(*[F.struct("at", _masked(m, F.col("w"), F.col("at")).alias("seed")) for m in MASKS])
    return starts.select(keep, F.inline(every)).filter("seed is not null")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast after counting its rows; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (document, item) with ``n_equal``, the most equal words in line,
    and ``n_words`` of the item."""
    items = _split(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).filter("item is not null"), "t", "item").distinct()
    at_items = _starts(items, "item")
    # at most BITS / 64 rows come to the driver
    bits = at_items.groupBy(F.shiftright("slot", 6).cast("int").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).collect()
    bitmap = [0] * (BITS // 64)
    for r in bits:
        bitmap[r.i] = r.bits
    table = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")  # folded into one literal
    seeds = _seeds(at_items, "item").withColumnRenamed("at", "item_at").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("id is not null")
    word = F.get(table, F.shiftright("slot", 6).cast("int"))
    known = F.call_function("shiftrightunsigned", word, F.col("slot").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) != 0
    found = _seeds(_starts(_split(texts, "t", "id"), "id").filter(known), "id").join(_small(seeds), "seed")
    lines = found.select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    # verify around the hits: only documents with a hit are split again
    hit = lines.groupBy("id").agg(F.collect_set(F.struct("item", "shift")).alias("lines"))  # at most items x words of one document
    doc = _split(texts.join(_small(hit), "id"), "t", "id", "lines").select("id", "w", F.inline("lines"))
    both = doc.join(_small(items.withColumnRenamed("w", "b")), "item")
    equal = F.transform("b", lambda x, j: F.when((F.col("shift") + j >= 0) & F.get("w", F.col("shift") + j).eqNullSafe(x), 1).otherwise(0))
    n = F.size("b")
    both = both.select("id", "item", n.cast("long").alias("n_words"), F.explode(F.array(equal)).alias("eq"))
    in_line = lambda s: F.aggregate(F.slice("eq", s + 1, WINDOW), F.lit(0), lambda a, x: a + x)
    whole = F.aggregate("eq", F.lit(0), lambda a, x: a + x)
    ok = F.when(F.size("eq") < WINDOW, whole == F.size("eq")).otherwise(F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("eq") - WINDOW)), lambda s: in_line(s) >= WINDOW - MISMATCHES))
    pairs = both.filter(ok).groupBy("id", "item").agg(F.max(whole).cast("long").alias("n_equal"), F.max("n_words").alias("n_words"))
    return pairs.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_equal", "n_words")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **names) -> DataFrame:
    """``docs`` without the documents that leak an item (rows without an id stay)."""
    return docs.join(leaks(docs, benchmark, id_col=id_col, **names).select(id_col).distinct(), id_col, "left_anti")


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for ``leaks``."""
    masked = lambda m: " || ' ' || ".join(f"lead(w, {k}) OVER p" if k else "w" for k, b in enumerate(m) if b == "1")
    seeds = lambda t, k: " UNION ALL ".join(f"SELECT {k}, j, {n} AS m, {masked(m)} AS seed FROM {t} WINDOW p AS (PARTITION BY {k} ORDER BY j)" for n, m in enumerate(MASKS))
    return f"""
WITH iw AS (SELECT item_id, {_WORDS} AS ws FROM {benchmark}),
it AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM iw WHERE len(ws) >= {SHORTEST}),
dw AS (SELECT doc_id, {_WORDS} AS ws FROM {documents}),
dt AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM dw WHERE len(ws) >= {SHORTEST}),
si AS ({seeds("it", "item_id")}), sd AS ({seeds("dt", "doc_id")}),
ln AS (SELECT DISTINCT doc_id, item_id, sd.j - si.j AS shift FROM sd JOIN si USING (m, seed)),
eq AS (SELECT ln.doc_id, ln.item_id, shift, it.j, it.n, CASE WHEN dt.w = it.w THEN 1 ELSE 0 END AS e
  FROM ln JOIN it USING (item_id) LEFT JOIN dt ON dt.doc_id = ln.doc_id AND dt.j = it.j + shift),
wn AS (SELECT *, sum(e) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM eq),
pr AS (SELECT doc_id, item_id, shift, any_value(n) AS n, sum(e) AS n_equal,
  bool_or(CASE WHEN n < {WINDOW} THEN false ELSE j <= n - {WINDOW} + 1 AND s >= {WINDOW - MISMATCHES} END) OR (any_value(n) < {WINDOW} AND sum(e) = any_value(n)) AS leak
  FROM wn GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(n_equal) AS BIGINT) AS n_equal, CAST(any_value(n) AS BIGINT) AS n_words FROM pr WHERE leak GROUP BY doc_id, item_id
"""
