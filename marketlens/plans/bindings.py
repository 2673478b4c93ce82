"""Bindings of the posting model to the benchmark tables.

The operators only know column names; this module says which table plays
which role (and mirrors, column for column, the DuckDB SQL in ``oracle``):

- postings  <- ``orders``: id ``o_orderkey``, date ``o_orderdate``, role label
  ``o_orderpriority``, work type from ``o_orderstatus``, salaries derived from
  ``o_totalprice`` (status 'O' has no minimum, status 'P' has no maximum).
- companies <- ``customer.c_name`` through ``o_custkey``.
- skills    <- ``part``: id ``p_partkey``, display name ``p_brand``, English
  label ``p_name``, key ``lower(p_name)``.
- links     <- distinct ``lineitem(l_orderkey, l_partkey)``.
- texts     <- ``documents.text``; payloads <- ``orders`` as JSON;
  attempts  <- ``events``; chat envelopes <- ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import read_table

# Order status -> work type of the bound postings.
WORK_TYPE_BY_STATUS = {"F": "onsite", "O": "remote", "P": "hybrid"}
#: Rows of a task that sorts rows or keeps keys of them (up to some 100 bytes a row and step).
TASK_ROWS = 400_000


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting projection (A2): only the columns the operators use."""
    o = read_table(spark, sf_dir, "orders")
    work = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in WORK_TYPE_BY_STATUS.items()], F.lit("unknown"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.to_date("o_orderdate").alias("date_added"),
        F.col("o_orderpriority").alias("role_title"),
        F.col("o_orderpriority").alias("role_title_en"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") / 10.0).alias("salary_min"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 8.0).alias("salary_max"),
        work.alias("work_type"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.lower(F.col("p_name")).alias("name"),
        F.col("p_brand").alias("display_name"),
        F.col("p_name").alias("display_name_en"),
    )


def _link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("posting_id"), F.col("l_partkey").alias("skill_id"))


def link_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for the links where they are dealt by key, ``TASK_ROWS`` each (the
    count reads file footers); None where Spark's own choice, a few tasks per
    core, is as fine. Left to itself Spark would make tasks of few but
    well-compressed bytes, and so of ever more rows."""
    parts = -(-_link_keys(spark, sf_dir).count() // TASK_ROWS)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting-skill links; the pair is the key, so duplicates are removed.
    Dealt by posting once: the removal of duplicates and the join to the
    postings both use that shuffle."""
    parts, li = link_parts(spark, sf_dir), _link_keys(spark, sf_dir)
    return (li.repartition(parts, "posting_id") if parts else li.repartition("posting_id")).dropDuplicates(["posting_id", "skill_id"])


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs as they stand, repeats included, for operators that
    remove them after a join (``distinct=True``). Many are dealt by posting."""
    parts, li = link_parts(spark, sf_dir), _link_keys(spark, sf_dir)
    return li.repartition(parts, "posting_id") if parts else li


def company_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings per company name, pre-aggregated by key before the join to the
    customer table (one row per customer crosses the join, not one per order)."""
    per_key = postings(spark, sf_dir).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.join(companies(spark, sf_dir), "company_id").select("company_name", "n")


# ------------------------------------------------------------------ ingest side
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of earlier postings: the benchmark passages, fingerprinted."""
    from marketlens.functions.text import fingerprint

    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), fingerprint("text").alias("content_hash"))


# Market segment -> currency text of the bound payloads.
CURRENCY_BY_SEGMENT = {"BUILDING": " eur ", "AUTOMOBILE": "euro", "MACHINERY": "usd"}


def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed extraction fields per order (orders, customer, lineitem, part):
    the skill lists come from the order's parts in line order. Status 'P'
    orders state a minimum above the maximum, customers with a negative
    balance a negative minimum, parts of size < 3 a blank English label."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    lines, parts = li.join(p, li.l_partkey == p.p_partkey), link_parts(spark, sf_dir)
    # many are dealt by order first: payloads are built and validated in that many tasks
    lines = (lines.repartition(parts, "l_orderkey") if parts else lines).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name", F.when(F.col("p_size") >= 3, F.col("p_brand")).otherwise(F.lit("")).alias("en")))).alias("ls"))
    seg = F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in CURRENCY_BY_SEGMENT.items()])
    work = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in WORK_TYPE_BY_STATUS.items()], F.lit("unknown"))
    is_p = F.col("o_orderstatus") == "P"
    j = o.join(c, o.o_custkey == c.c_custkey).join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").alias("payload_id"),
        F.col("c_name").alias("company_name"),
        F.col("o_orderpriority").alias("role_title"),
        F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).when(is_p, F.lit("   ")).alias("role_title_en"),
        F.when(F.col("c_acctbal") < 0, F.lit(-1.0)).when(is_p, F.col("o_totalprice") / 8.0).otherwise(F.col("o_totalprice") / 10.0).alias("salary_min"),
        F.when(is_p, F.col("o_totalprice") / 10.0).otherwise(F.col("o_totalprice") / 8.0).alias("salary_max"),
        seg.alias("salary_currency"),
        work.alias("work_type"),
        (F.col("c_acctbal") > 5000).alias("has_nondiscrimination_disclaimer"),
        F.coalesce(F.transform("ls", lambda r: r["p_name"]), F.array().cast("array<string>")).alias("skills"),
        F.coalesce(F.transform("ls", lambda r: r["en"]), F.array().cast("array<string>")).alias("skills_en"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction payloads as JSON texts (what an extractor would return)."""
    f = payload_fields(spark, sf_dir)
    return f.select("payload_id", F.to_json(F.struct(*[c for c in f.columns if c != "payload_id"])).alias("payload"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction attempts from ``events``: posting = user, order = event id,
    purchases are fallback-tier attempts; views and purchases succeed, errors
    fail with a category by value, signups fail validation, clicks fail with
    an API error; payload = props."""
    e = read_table(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    cat = (
        F.when(et == "error", F.when(v < 10, F.lit("rate_limit")).when(v < 30, F.lit("parse_error"))
               .when(v < 60, F.lit("timeout")).otherwise(F.lit("validation_failure")))
        .when(et == "signup", F.lit("validation_failure"))
        .when(et == "click", F.lit("api_error"))
    )
    return e.select(
        F.col("user_id").alias("posting_id"), F.col("event_id").alias("attempt"), F.col("ts"),
        F.length("props").alias("prompt_tokens"),
        F.when(et == "purchase", F.lit("fallback")).otherwise(F.lit("primary")).alias("tier"),
        et.isin("view", "purchase").alias("succeeded"),
        cat.alias("error_category"),
        F.col("props").alias("payload"),
        et.alias("model"),
        F.concat(F.coalesce(cat, F.lit("ok")), F.lit(" after "), F.format_number(v, 2), F.lit(" ms")).alias("message"),
        (v * 100).alias("latency_ms"),
        F.when(et == "purchase", F.lit("ollama")).otherwise(F.lit("openrouter")).alias("provider"),
        F.sha2(F.col("props"), 256).alias("content_hash"),
        F.length("props").alias("posting_chars"),
    )


def indexed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts with ``chain_index``: 0 for a chain's first primary attempt,
    1 for all others (enough to tell which ones are fallbacks)."""
    a = attempts(spark, sf_dir)
    first = a.where("tier = 'primary'").groupBy("posting_id").agg(F.min("attempt").alias("_first"))
    index = F.when(F.col("attempt").eqNullSafe(F.col("_first")), 0).otherwise(1)
    return a.join(first, "posting_id", "left").withColumn("chain_index", index).drop("_first")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat responses from ``conversations``: assistant turns return a fenced
    JSON object, system turns a JSON array, user turns plain prose; usage
    counts from the text length and turn."""
    cv = read_table(spark, sf_dir, "conversations")
    role = F.col("role")
    content = (
        F.when(role == "assistant", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("role_title"))), F.lit("\n```")))
        .when(role == "system", F.to_json(F.array("text")))
        .otherwise(F.col("text"))
    )
    usage = F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"),
                     (F.length("text") + F.col("turn")).alias("total_tokens"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"), usage.alias("usage")))
    return cv.select("conv_id", "turn", "role", "text", body.alias("body"))
