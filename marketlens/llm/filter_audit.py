"""Filter interaction audit: what each filter removes in every order.

A document is reduced to the set of filters that it fails, a mask with one bit
per filter; per part, documents are counted by mask (a cell), so a part of any
size is at most 2^k cells. One Gray-code walk then visits all 2^k subsets of
filters, toggling one filter per step: each cell holds a counter of its active
failures, and the running survivors change by the cells whose counter leaves
or reaches 0. The survivors of every subset (a state) are stored; a step of an
order is the difference of two states.

The duplicate filter fails every row whose text also stands in a row of a
smaller id. Copies are counted per text hash before they meet: per (hash, id),
then per (hash, part, label), so a text copied by a third of all rows is a few
rows by then.

Defined results: null texts are empty; null parts are the empty string; rows
of a null id never fail the duplicate filter and fail no other row; rows that
repeat an id are all counted, and as copies of each other they do not fail; a
row is good or toxic if any label of its id says so; labels of unknown ids are
ignored; an empty table has no parts and so no rows; columns other than those
named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Counts of a cell.
COUNTS = ["n", "good", "toxic"]


def text_filters(text: Column) -> dict[str, Column]:
    """The per-row failure conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def gray_states(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of every subset of k filters: 2^k rows of sums of ``counts``
    (cells x counts) over the cells that fail no filter of the subset."""
    failures = np.zeros(len(masks), np.int64)
    alive = counts.sum(0)
    states = np.zeros((1 << k, counts.shape[1]), np.int64)
    states[0], subset = alive, 0
    for step in range(1, 1 << k):
        bit = step & -step  # the filter that the reflected code toggles
        subset ^= bit
        hit = (masks & bit) > 0
        if subset & bit:
            alive = alive - counts[hit & (failures == 0)].sum(0)
            failures[hit] += 1
        else:
            failures[hit] -= 1
            alive = alive + counts[hit & (failures == 0)].sum(0)
        states[subset] = alive
    return states


def order_rows(masks: np.ndarray, counts: np.ndarray, names: str) -> pd.DataFrame:
    """One row per order of the filters and step, from the stored states."""
    k = len(names)
    orders = np.array(list(permutations(range(k))))
    bits = 1 << orders
    after = np.cumsum(bits, 1)
    before = after - bits
    states = gray_states(masks, counts, k)
    lost = states[before] - states[after]
    fails = np.array([counts[(masks >> f) & 1 == 1, 0].sum() for f in range(k)])
    only = np.array([counts[masks == 1 << f, 0].sum() for f in range(k)])
    total = np.zeros(k, np.int64)
    np.add.at(total, orders.ravel(), lost[..., 0].ravel())
    removed = lost[..., 0].ravel()
    filters = orders.ravel()
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        "kept": states[after][..., 0].ravel(), "removed": removed, "redundant": fails[filters] - removed, "unique_fails": only[filters],
        "good_lost": lost[..., 1].ravel(), "toxic_lost": lost[..., 2].ravel(), "shapley": total[filters],
    })


def cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=text_filters, duplicates: str = "E") -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic) and the names of the filters, bit 0 first;
    the last is the duplicate filter."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    conditions: Mapping[str, Column] = filters(text)
    names = "".join(conditions) + duplicates
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("hash"), mask.alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, F.col("id") == F.col("label_id"), "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    # rows of one (text, id), then of one (text, part, labels) with its smallest id and the rows that have it
    ids = rows.select("hash", "id", "part", "mask", *flags).groupBy("hash", "id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    kinds = ids.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.sum(F.when(known, F.col("n"))).alias("n"), F.sum(F.when(~known, F.col("n"))).alias("unnamed"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    least = kinds.groupBy("hash").agg(F.min("first.id").alias("least"))
    # texts of one kind of row are their own smallest; others look theirs up
    kinds = kinds.join(least, "hash")
    firsts = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    last = F.lit(1 << len(conditions))
    split = kinds.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), (firsts + F.coalesce("unnamed", F.lit(0))).alias("n")),
        F.struct(F.col("mask").bitwiseOR(last).alias("mask"), (F.coalesce("n", F.lit(0)) - firsts).alias("n")),
    )).alias("c")).select("part", "good", "toxic", "c.mask", F.coalesce("c.n", F.lit(0)).alias("n")).filter("n > 0")
    out = split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    return out, names


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. A part is one group of at
    most 2^k cells, whatever its number of documents."""
    counted, names = cells(docs, labels, **columns)

    def walk(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        out = order_rows(cell["mask"].to_numpy(np.int64), cell[COUNTS].to_numpy(np.int64), names)
        out.insert(0, "part", key[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counted.groupBy("part").applyInPandas(walk, schema)


def oracle() -> str:
    """The same rows in SQL, each step counted from the cells."""
    letters = "ABCDE"
    joins = ", ".join(f"l l{i}" for i in range(1, 6))
    differ = " AND ".join(f"l{i}.f <> l{j}.f" for i in range(1, 6) for j in range(i + 1, 6))
    values = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    order = " || ".join(f"l{i}.f" for i in range(1, 6))
    steps = " UNION ALL ".join(f"SELECT {order} AS filter_order, {s} AS step, l{s}.b AS bit, {' + '.join([f'l{i}.b' for i in range(1, s)] or ['0'])} AS prior FROM {joins} WHERE {differ}" for s in range(1, 6))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), masked AS (
  SELECT d.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN firsts.least < d.doc_id THEN 16 ELSE 0 END AS mask
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN lab ON d.doc_id = lab.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masked GROUP BY part, mask
), l AS (SELECT * FROM (VALUES {values}) t(f, b)), steps AS ({steps}), counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (prior + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & prior = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & prior > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & prior = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & prior = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
