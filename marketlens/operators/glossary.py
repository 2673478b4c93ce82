"""Glossary of original -> English labels as a table.

Table form: (key, original, english, seq) with ``key`` the normalised
original. Only real translations are kept (identity pairs are dropped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from marketlens.functions.text import is_identity_pair, normalize_key, once, py_strip, sanitize_field_reason


def _reason() -> Column:
    """B4 of the stripped columns original and english."""
    return F.coalesce(sanitize_field_reason("original", "original", stripped=True), sanitize_field_reason("english", "english", stripped=True))


def _identity() -> Column:
    """B3 of the stripped columns original and english."""
    return F.lower("original") == F.lower("english")


def parse_lines(lines: DataFrame, line_col: str = "value", seq_col: str = "seq") -> DataFrame:
    """A4: glossary rows from TSV lines: skip blank, comment and tab-less
    lines; split on the first tab; drop unusable (B4) and identity (B3) rows;
    key = lower-cased stripped original; the last row of a key wins."""
    rows = once(lines, F.col(seq_col), py_strip(line_col).alias("_s")).where(
        (F.col("_s") != "") & ~F.col("_s").startswith("#") & (F.instr("_s", "\t") > 0)
    )
    rows = once(
        rows, seq_col,
        py_strip(F.substring_index("_s", "\t", 1)).alias("original"),
        py_strip(F.expr("substring(_s, instr(_s, '\t') + 1)")).alias("english"),
    )
    rows = rows.where(_reason().isNull() & ~_identity())
    last = rows.groupBy(F.lower("original").alias("key")).agg(
        F.max_by(F.struct("original", "english", seq_col), F.col(seq_col)).alias("r"))
    return last.select("key", "r.original", "r.english", F.col(f"r.{seq_col}").alias(seq_col))


def lookup(df: DataFrame, label_col: str, glossary: DataFrame, out_col: str = "glossary_english") -> DataFrame:
    """Left join on the normalised label. The glossary is a small
    dimension; Spark broadcasts it when its size statistics allow."""
    g = glossary.select(F.col("key").alias("_gk"), F.col("english").alias(out_col))
    return df.join(g, normalize_key(label_col) == F.col("_gk"), "left").drop("_gk")


def candidate_pairs(postings: DataFrame, *, id_col="id", title_col="role_title", title_en_col="role_title_en",
                    skills_col="skills", skills_en_col="skills_en") -> DataFrame:
    """Glossary candidates of each posting: the title pair and the
    zipped skill pairs (missing English -> the skill itself); blank and
    identity pairs skipped. Output: (id, pos, original, english), pos 0 for
    the title, i + 1 for skill i."""
    title = F.struct(F.lit(0).alias("pos"), F.col(title_col).alias("o"), F.col(title_en_col).alias("e"))
    skills = F.transform(
        F.arrays_zip(F.col(skills_col).alias("s"), F.col(skills_en_col).alias("x")),
        lambda p, i: F.struct((i + 1).alias("pos"), p["s"].alias("o"), F.coalesce(p["x"], p["s"]).alias("e")),
    )
    none = F.array().cast("array<struct<pos:int,o:string,e:string>>")
    ex = postings.select(id_col, F.explode(F.concat(F.array(title), F.coalesce(skills, none))).alias("p"))
    ex = ex.select(id_col, "p.pos", F.col("p.o").alias("o"), F.col("p.e").alias("e"))
    ok = (F.coalesce(F.length("o"), F.lit(0)) > 0) & (F.coalesce(F.length("e"), F.lit(0)) > 0)
    return once(ex.where(ok), id_col, "pos", py_strip("o").alias("original"), py_strip("e").alias("english")).where(~_identity())


#: Sequence values per range of a key.
RANGE = 1 << 16


def merge(existing: DataFrame, pairs: DataFrame, seq_col: str = "seq", part: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """H5: merge new (original, english, seq) pairs into the glossary.

    Per key: a new key takes the first pair's original casing; an english
    change that is only a change of case is no change; the last real change
    wins. Blank, unusable (B4) and identity pairs are skipped (reported in the
    second frame with a reason). Returns (merged glossary, actions) where
    actions has one row per changed pair (action insert / update) and the
    rejected pairs (action reject).

    A key's pairs are looked at in ranges of ``part`` (a number that rises with
    the sequence; the sequence itself by default), ``RANGE`` values each, so the
    pairs of a frequent key are never one group. A range is reduced to its
    first pair, its last value and its last change; those few rows per key are
    then put in order, which settles the first pair of every range and the
    final run. Two exchanges, no join back. ``seq_col`` may be a struct."""
    p = once(pairs, F.col(seq_col).alias("seq"), (F.col(seq_col) if part is None else part).cast("long").alias("at"),
             py_strip("original").alias("original"), py_strip("english").alias("english"))
    p = p.withColumn("reason", _reason())
    rejected = p.where(F.col("reason").isNotNull() & (F.col("original") != "") & (F.col("english") != ""))
    p = p.where(F.col("reason").isNull() & ~_identity()).withColumn("key", F.lower("original")).withColumn("n", F.lower("english"))
    kind = p.schema["seq"].dataType
    old = existing.where(~is_identity_pair("original", "english")).select(
        "key", F.lit(-1).cast("long").alias("range"), F.lit(None).cast(kind).alias("seq"), "original", "english", normalize_key("english").alias("n"))
    stream = old.unionByName(p.select("key", F.floor(F.col("at") / RANGE).cast("long").alias("range"), "seq", "original", "english", "n"))
    w = Window.partitionBy("key", "range").orderBy(F.col("seq").asc_nulls_first())
    row = stream.withColumn("prev", F.lag("n").over(w))
    found = F.struct("seq", "original", "english", "n")
    inside = F.col("prev").isNotNull() & (F.col("prev") != F.col("n"))
    # per range, in the partitioning of the window
    ranges = row.groupBy("key", "range").agg(
        F.min(found).alias("first"), F.max(F.struct("seq", "n")).alias("last"), F.max(F.when(inside, F.struct("seq", "english"))).alias("change"))
    by_range = Window.partitionBy("key").orderBy("range")
    ranges = ranges.withColumn("before", F.lag("last.n").over(by_range))
    is_old = F.col("range") == -1
    starts = F.col("before").isNull() | (F.col("before") != F.col("first.n"))  # the range's first pair starts a run
    run = F.coalesce(F.col("change"), F.when(starts, F.struct(F.col("first.seq").alias("seq"), F.col("first.english").alias("english"))))
    merged = ranges.withColumn("run", run).groupBy("key").agg(
        F.min_by("first.original", "range").alias("original"),
        F.max_by("run.english", F.when(F.col("run").isNotNull(), F.col("range"))).alias("english"),
        F.max_by("last.seq", "range").alias(seq_col))
    if isinstance(kind, (LongType, IntegerType)):
        merged = merged.withColumn(seq_col, F.coalesce(seq_col, F.lit(-1)))
    heads = ranges.where(starts & ~is_old).select("key", "first.seq", "first.original", "first.english", F.when(F.col("before").isNull(), F.lit("insert")).otherwise(F.lit("update")).alias("action"))
    changes = row.where(inside).select("key", "seq", "original", "english", F.lit("update").alias("action"))
    none = F.lit(None).cast("string").alias("reason")
    actions = heads.unionByName(changes).select("key", F.col("seq").alias(seq_col), "original", "english", "action", none)
    return merged, actions.unionByName(rejected.select(
        F.lower("original").alias("key"), F.col("seq").alias(seq_col), "original", "english", F.lit("reject").alias("action"), "reason"))


def changed_count(actions: DataFrame) -> Column:
    """Number of inserts and updates (the merge's return value)."""
    return F.count_if(F.col("action").isin("insert", "update"))
