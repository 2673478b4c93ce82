"""Extraction as table jobs.

Payloads are JSON texts parsed to VARIANT. Field types are tested with
``schema_of_variant`` so that absent, explicit null, string and number are
told apart (lax typing: numeric strings are accepted for numbers, numbers are
not accepted for strings). Every check yields a reason; the first reason
rejects the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import SALARY_SOFT_MAX, round_half_even, salary_reason
from marketlens.functions.text import (currency_code, currency_reason, normalize_key, optional_stripped, py_strip,
                                       strip_markdown_fences)

# Payload bounds and the work-type domain.
MAX_SHORT_TEXT = 200
MAX_LONG_TEXT = 20_000
MAX_CURRENCY_LEN = 16
MAX_SKILL_LEN = 100
MAX_SKILLS = 50
WORK_TYPES = ("onsite", "hybrid", "remote", "unknown")
SHORT_FIELDS = ("company_name", "role_title_en", "location", "country", "city")
LONG_FIELDS = ("responsibilities", "requirements")
# Truthy / falsy strings accepted for a boolean field.
TRUE_STRINGS = ("true", "t", "yes", "y", "on", "1")
# Fixed value: numbers within strings (a Java double would also take "12d").
NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"
FALSE_STRINGS = ("false", "f", "no", "n", "off", "0")
# Error categories that stop the remaining primary attempts.
BARRIER_CATEGORIES = ("rate_limit", "parse_error", "timeout")


STRING_FIELDS = {**{f: MAX_SHORT_TEXT for f in ("role_title",) + SHORT_FIELDS}, **{f: MAX_LONG_TEXT for f in LONG_FIELDS},
                 "salary_currency": MAX_CURRENCY_LEN}
NUMBER_FIELDS = ("salary_min", "salary_max")
LIST_FIELDS = ("skills", "skills_en")
ALL_FIELDS = tuple(STRING_FIELDS) + NUMBER_FIELDS + ("application_deadline", "work_type", "has_nondiscrimination_disclaimer") + LIST_FIELDS


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _extract(df: DataFrame, payload_col: str, id_col: str) -> DataFrame:
    """Parse once and take all fields in one walk over the object, then read
    each field by itself: ``k_<f>`` its VARIANT kind (STRING / BIGINT / DOUBLE /
    DECIMAL(..) / BOOLEAN / VOID for json null / ARRAY<..> / OBJECT<..>; NULL
    when absent) and ``s_<f>`` its typed value, cast only where the kind calls
    for it. Staged projections keep the steps from being repeated per check."""
    parsed = df.select(F.col(id_col), F.try_parse_json(F.col(payload_col)).alias("_v"))
    # NULL unless the payload is an object; its other fields are left aside
    whole = F.try_variant_get("_v", "$", "struct<" + ", ".join(f"{f}: variant" for f in ALL_FIELDS) + ">")
    parsed = parsed.select(id_col, F.col("_v").isNull().alias("not_json"), whole.alias("_f"))
    # as one array, which keeps the generated code of each step short enough to be compiled
    kinds = F.transform(F.array(*[F.col(f"_f.{f}") for f in ALL_FIELDS]), lambda v: F.schema_of_variant(v))
    parsed = parsed.select(id_col, "not_json", F.col("_f").isNull().alias("not_object"), "_f", kinds.alias("_k"))
    parsed = parsed.select(id_col, "not_json", "not_object", "_f", *[F.col("_k")[i].alias(f"k_{f}") for i, f in enumerate(ALL_FIELDS)])
    k = lambda f: F.col(f"k_{f}")
    get = lambda f, kind: F.try_variant_get(f"_f.{f}", "$", kind)
    cols = [F.col(c) for c in parsed.columns if c != "_f"]
    for f in STRING_FIELDS:
        cols.append(F.when(k(f) == "STRING", get(f, "string")).alias(f"s_{f}"))
    for f in ("application_deadline", "work_type"):
        cols.append(get(f, "string").alias(f"s_{f}"))
    for f in NUMBER_FIELDS:
        cols.append(F.when(k(f) != "STRING", get(f, "double")).alias(f"d_{f}"))
        cols.append(F.when(k(f) == "STRING", get(f, "string")).alias(f"s_{f}"))
    flag = "has_nondiscrimination_disclaimer"
    cols.append(F.when(k(flag) == "BOOLEAN", get(flag, "boolean")).alias("b_flag"))
    cols.append(F.when(k(flag) != "BOOLEAN", F.lower(get(flag, "string"))).alias("s_flag"))
    for f in LIST_FIELDS:
        cols.append(get(f, "array<string>").alias(f"a_{f}"))
    return parsed.select(*cols)


def validate_payloads(df: DataFrame, payload_col: str = "payload", id_col: str = "payload_id") -> DataFrame:
    """J1 (+B12-B16): schema then domain checks of extraction payloads.

    Output: id, ``accepted``, ``reason`` (the first failed check; NULL when
    accepted) and the normalised posting fields (strings stripped, currency
    upper-cased, skill lists cleaned, English title defaulted to the title)."""
    x = _extract(df, payload_col, id_col)
    k = lambda f: F.col(f"k_{f}")
    # typed values (stage 2)
    vals = [F.col(id_col), F.col("not_json"), F.col("not_object")]
    for f in STRING_FIELDS:
        vals.append(F.col(f"s_{f}").alias(f))
    for f in NUMBER_FIELDS:
        vals.append(F.when(_is_number(k(f)) | (k(f) == "BOOLEAN"), F.col(f"d_{f}"))
                    .when((k(f) == "STRING") & F.trim(f"s_{f}").rlike(NUMBER_TEXT), F.trim(f"s_{f}").try_cast("double")).alias(f))
    # a date, or a timestamp at midnight
    day = F.regexp_replace("s_application_deadline", r"^(\d{4}-\d{2}-\d{2})[T ]00:00(:00(\.0+)?)?(Z|[+-]00:?00)?$", "$1")
    vals.append(F.try_to_date(day, "yyyy-MM-dd").alias("application_deadline"))
    vals.append(F.col("s_work_type").alias("work_type"))
    vals.append(F.when(k("has_nondiscrimination_disclaimer").isNull(), F.lit(False))
                .when(k("has_nondiscrimination_disclaimer") == "BOOLEAN", F.col("b_flag"))
                .when(F.col("s_flag").isin(*TRUE_STRINGS), F.lit(True))
                .when(F.col("s_flag").isin(*FALSE_STRINGS), F.lit(False)).alias("has_nondiscrimination_disclaimer"))
    for f in LIST_FIELDS:
        vals.append(F.when(k(f).isNull(), F.array().cast("array<string>")).otherwise(F.col(f"a_{f}")).alias(f))
    kinds = [k(f) for f in ALL_FIELDS]
    t = x.select(*vals, *kinds)
    c = F.col
    # schema checks
    reasons: list[Column] = [
        F.when(c("not_json"), F.lit("schema: payload is not JSON")),
        F.when(c("not_object"), F.lit("schema: payload is not a JSON object")),
        F.when(k("role_title").isNull() | (k("role_title") == "VOID"), F.lit("schema: role_title is required")),
    ]
    for f, max_len in STRING_FIELDS.items():
        reasons.append(F.when(k(f).isNotNull() & (k(f) != "VOID") & (k(f) != "STRING"), F.lit(f"schema: {f} must be a string"))
                       .when(F.length(c(f)) > max_len, F.lit(f"schema: {f} longer than {max_len}")))
    for f in NUMBER_FIELDS:
        reasons.append(
            F.when(k(f).isNotNull() & (k(f) != "VOID") & c(f).isNull(), F.lit(f"schema: {f} must be a number"))
            .when(F.isnan(c(f)) | (F.abs(c(f)) == float("inf")), F.lit(f"schema: {f} must be finite"))
            .when(c(f) < 0, F.lit(f"schema: {f} must be >= 0"))
            .when(c(f) > SALARY_SOFT_MAX, F.lit(f"schema: {f} must be <= {SALARY_SOFT_MAX:g}")))
    reasons.append(F.when(k("application_deadline").isNotNull() & (k("application_deadline") != "VOID") & c("application_deadline").isNull(),
                          F.lit("schema: application_deadline must be a date")))
    reasons.append(F.when(k("work_type").isNotNull() & ~((k("work_type") == "STRING") & c("work_type").isin(*WORK_TYPES)),
                          F.lit("schema: work_type must be one of " + ", ".join(WORK_TYPES))))
    reasons.append(F.when(c("has_nondiscrimination_disclaimer").isNull(), F.lit("schema: has_nondiscrimination_disclaimer must be a boolean")))
    for f in LIST_FIELDS:
        # [] and [null] are both ARRAY<VOID>
        ok_kind = k(f).isNull() | (k(f) == "ARRAY<VOID>") | (k(f) == "ARRAY<STRING>")
        reasons.append(F.when(~ok_kind, F.lit(f"schema: {f} must be a list of strings"))
                       .when(F.exists(c(f), lambda v: v.isNull()), F.lit(f"schema: {f} must not hold nulls"))
                       .when(F.size(c(f)) > MAX_SKILLS, F.lit(f"schema: {f} holds more than {MAX_SKILLS} items")))
    # domain rules (B12-B16) on stage-3 columns
    has_en = F.size("skills_en") > 0
    pairs = F.filter(
        F.transform(F.arrays_zip(c("skills").alias("s"), c("skills_en").alias("e")),
                    lambda p: F.struct(py_strip(p["s"]).alias("s"), py_strip(p["e"]).alias("e"))),
        lambda p: p["s"] != "",
    )
    u = t.select("*", py_strip("role_title").alias("_title"), pairs.alias("_pairs"), has_en.alias("_has_en"))
    reasons += [
        F.when(c("_title") == "", F.lit("domain:role_title:empty")),
        F.concat(F.lit("domain:"), salary_reason(c("salary_min"), c("salary_max"))),
        F.when(c("_has_en") & (F.size("skills_en") != F.size("skills")), F.lit("domain:skills_en:length_differs")),
        F.when(F.exists("_pairs", lambda p: F.length(p["s"]) > MAX_SKILL_LEN), F.lit(f"domain:skill:length>{MAX_SKILL_LEN}")),
        F.when(c("_has_en") & F.exists("_pairs", lambda p: F.coalesce(p["e"], F.lit("")) == ""),
               F.lit("domain:skills_en:blank_entry")),
        F.when(c("_has_en") & F.exists("_pairs", lambda p: F.length(p["e"]) > MAX_SKILL_LEN),
               F.lit(f"domain:skills_en:length>{MAX_SKILL_LEN}")),
        F.when(F.size("_pairs") > MAX_SKILLS, F.lit(f"domain:skills:more_than_{MAX_SKILLS}")),
        F.concat(F.lit("domain:"), currency_reason(c("salary_currency"))),
    ]
    u = u.withColumn("reason", F.coalesce(*reasons))
    return u.select(
        F.col(id_col),
        c("reason").isNull().alias("accepted"),
        "reason",
        optional_stripped("company_name").alias("company_name"),
        c("_title").alias("role_title"),
        F.coalesce(optional_stripped("role_title_en"), c("_title")).alias("role_title_en"),
        optional_stripped("responsibilities").alias("responsibilities"),
        optional_stripped("requirements").alias("requirements"),
        "application_deadline", "salary_min", "salary_max",
        currency_code("salary_currency").alias("salary_currency"),
        optional_stripped("location").alias("location"),
        optional_stripped("country").alias("country"),
        optional_stripped("city").alias("city"),
        F.coalesce(c("work_type"), F.lit("unknown")).alias("work_type"),
        "has_nondiscrimination_disclaimer",
        F.transform("_pairs", lambda p: p["s"]).alias("skills"),
        F.transform("_pairs", lambda p: F.when(c("_has_en"), p["e"]).otherwise(p["s"])).alias("skills_en"),
    )


def resolve_labels(valid: DataFrame, glossary: DataFrame, id_col: str = "payload_id") -> DataFrame:
    """J4 labels (B5, B6, C6): title and each skill resolved glossary >
    extracted English > original. ``glossary``: (key, english) with
    normalised keys (A4 output). Skills are exploded with their position,
    joined, and collected back in order (at most 50 per payload)."""
    g = glossary.select(F.col("key").alias("_k"), F.col("english").alias("_g"))
    titled = valid.join(g, normalize_key("role_title") == F.col("_k"), "left").select(
        *[c for c in valid.columns if c != "role_title_en"],
        F.coalesce("_g", optional_stripped("role_title_en"), py_strip("role_title")).alias("role_title_en"),
    )
    skills = valid.select(id_col, F.posexplode(F.arrays_zip("skills", "skills_en")).alias("pos", "p"))
    skills = skills.join(g, normalize_key(F.col("p.skills")) == F.col("_k"), "left").select(
        id_col, "pos", F.coalesce("_g", optional_stripped("p.skills_en"), py_strip("p.skills")).alias("label"))
    labelled = skills.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda r: r["label"]).alias("_en"))
    return titled.join(labelled, id_col, "left").select(
        *[c for c in titled.columns if c != "skills_en"],
        F.coalesce("_en", F.array().cast("array<string>")).alias("skills_en"))


# ------------------------------------------------------------------ envelopes
def parse_envelope(df: DataFrame, body_col: str = "body", shape: str = "openai") -> DataFrame:
    """B24 (+B23): ``choices[0].message.content`` (``message.content`` in the
    "local" shape) must be a non-blank string that (after fence stripping) holds a JSON object. Adds ``content``,
    ``payload`` (the JSON object text) and ``reason``."""
    holder, path = ("$.choices[0]", "$.choices[0].message.content") if shape == "openai" else ("$.message", "$.message.content")
    v = F.try_parse_json(F.col(body_col))
    content = F.try_variant_get(v, path, "string")
    ck = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = strip_markdown_fences(py_strip(content))
    parsed = F.try_parse_json(text)
    reason = (
        F.when(v.isNull(), F.lit("response is not JSON"))
        .when(F.try_variant_get(v, holder, "variant").isNull(), F.lit("unexpected response shape"))
        .when(ck.isNull() | (ck != "STRING") | (py_strip(content) == ""), F.lit("empty or non-string message content"))
        .when(parsed.isNull(), F.lit("non-JSON message content"))
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("JSON content is not an object"))
    )
    return df.select("*", content.alias("content"), F.when(reason.isNull(), text).alias("payload"), reason.alias("reason"))


def token_usage(body_col: str = "body", shape: str = "openai") -> Column:
    """Token counts from two response shapes; integers only; total
    derived for the second shape; NULL when nothing is known."""
    v = F.try_parse_json(F.col(body_col))

    def int_at(path):
        k = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(k == "BIGINT", F.try_variant_get(v, path, "int"))

    if shape == "openai":
        p, c, t = int_at("$.usage.prompt_tokens"), int_at("$.usage.completion_tokens"), int_at("$.usage.total_tokens")
    else:
        p, c = int_at("$.prompt_eval_count"), int_at("$.eval_count")
        t = F.when(p.isNotNull() | c.isNotNull(), F.coalesce(p, F.lit(0)) + F.coalesce(c, F.lit(0)))
    return F.when(p.isNotNull() | c.isNotNull() | t.isNotNull(),
                  F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), t.alias("total_tokens")))


def error_category(message, kind=None) -> Column:
    """Ordered first-match substring rules over the lower-cased
    message; ``kind`` (timeout / connection / value / runtime) is tested first."""
    t = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    k = F.lower(F.coalesce(F.col(kind) if isinstance(kind, str) else kind, F.lit(""))) if kind is not None else F.lit("")
    has = lambda *ws: reduce(lambda a, b: a | b, [t.contains(w) for w in ws])
    return (
        F.when(k == "timeout", F.lit("timeout"))
        .when(k == "connection", F.lit("connection"))
        .when(has("429", "rate limit", "free-tier"), F.lit("rate_limit"))
        .when(has("401", "403", "api key"), F.lit("api_error"))
        .when(has("404", "not found"), F.lit("api_error"))
        .when(has("timed out", "timeout"), F.lit("timeout"))
        .when(has("could not connect", "connection"), F.lit("connection"))
        .when(has("json", "parse", "non-json", "unexpected"), F.lit("parse_error"))
        .when(k.isin("value", "type", "key") & has("schema", "domain", "validation"), F.lit("validation_failure"))
        .when(has("validation") & has("schema", "domain", "validation"), F.lit("validation_failure"))
        .when((k == "runtime") & has("http", "ai "), F.lit("api_error"))
        .otherwise(F.lit("other"))
    )


def http_status_class(code) -> Column:
    """Auth / not_found / rate_limit / unavailable / other / invalid."""
    c = (F.col(code) if isinstance(code, str) else code).try_cast("int")
    return (
        F.when(c.isNull(), F.lit("invalid"))
        .when(c.isin(401, 403), F.lit("auth"))
        .when(c == 404, F.lit("not_found"))
        .when(c == 429, F.lit("rate_limit"))
        .when(c.isin(500, 502, 503, 504), F.lit("unavailable"))
        .otherwise(F.lit("other"))
    )


# ------------------------------------------------------------------ attempts
def first_usable_attempt(attempts: DataFrame, *, key_col: str = "posting_id", order_col: str = "attempt",
                         tier_col: str = "tier", ok_col: str = "succeeded", category_col: str = "error_category",
                         payload_col: str = "payload", model_col: str = "model", message_col: str = "message",
                         stop_on=BARRIER_CATEGORIES, fallback_enabled: bool = True, fatal=(), salts: int = 8) -> DataFrame:
    """J2 + J3: per posting, the payload that its chain of attempts ends with,
    or why there is none.

    Primary attempts run in order until one succeeds; a failure of a ``stop_on``
    category ends the primary chain (validation failures do not). Only when the
    primary chain has brought nothing do the fallback attempts count, wherever
    they stand in the order. A failure of a ``fatal`` category ends everything.

    What decides (first primary success, first stop, first fallback success)
    are grouped minima, combined before the shuffle. The counts need a second
    pass over keys, orders and tiers, spread over ``salts``; entries are made
    for exhausted chains only. Output: key, payload (NULL when exhausted),
    used_attempt, tried and skipped (primary attempts), detail (for exhausted
    chains: 'model: message' and 'model: skipped after <category>', joined)."""
    a = attempts.select(
        F.col(key_col).alias("_k"), F.col(order_col).alias("_o"), (F.col(tier_col) == "primary").alias("_p"), F.col(ok_col).alias("_ok"),
        F.col(category_col).alias("_cat"), F.col(payload_col).alias("_payload"), F.col(model_col).alias("_model"), F.col(message_col).alias("_msg"))
    p, ok, o = F.col("_p"), F.col("_ok"), F.col("_o")
    at = lambda cond: F.when(cond, o)
    dead = ~ok & F.col("_cat").isin(*fatal) if fatal else F.lit(False)
    stop = p & ~ok & (F.col("_cat").isin(*stop_on) if stop_on else F.lit(False)) | p & dead
    ends = a.groupBy("_k").agg(
        F.min(at(p & ok)).alias("_win"), F.min_by("_payload", at(p & ok)).alias("_win_payload"),
        F.min(at(stop)).alias("_stop"), F.min_by("_cat", at(stop)).alias("_stop_cat"), F.min(at(p & dead)).alias("_dead"),
        F.min(at(~p & ok)).alias("_back"), F.min_by("_payload", at(~p & ok)).alias("_back_payload"))
    won = F.col("_win").isNotNull() & (F.col("_stop").isNull() | (F.col("_win") < F.col("_stop")))
    died = ~won & F.col("_dead").isNotNull() & (F.col("_dead") <= F.col("_stop"))
    saved = ~won & ~died & F.lit(fallback_enabled) & F.col("_back").isNotNull()
    ends = ends.select(
        "_k", F.when(won, F.col("_win")).when(saved, F.col("_back")).alias("used_attempt"),
        F.when(won, F.col("_win_payload")).when(saved, F.col("_back_payload")).alias("payload"),
        F.when(won, F.col("_win")).otherwise(F.col("_stop")).alias("_last"), F.when(~won, F.col("_stop_cat")).alias("_stop_cat"), won.alias("_won"), died.alias("_died"))
    spread = ends.select("_k", "_last", "_won", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    narrow = a.where(p).select("_k", "_o", F.pmod(F.xxhash64("_o"), F.lit(salts)).cast("int").alias("_salt")).join(spread, ["_k", "_salt"])
    over = F.col("_last").isNotNull() & (o > F.col("_last"))
    counts = narrow.groupBy("_k", "_salt").agg(F.count_if(~over).alias("tried"), F.count_if(over & ~F.col("_won")).alias("skipped")).groupBy("_k").agg(F.sum("tried").alias("tried"), F.sum("skipped").alias("skipped"))
    lost = a.where(~ok).join(ends.where("used_attempt is null").select("_k", "_last", "_stop_cat", "_died"), "_k")
    entry = (
        F.when(p & over, F.concat(F.col("_model"), F.lit(": skipped after "), F.col("_stop_cat")))
        .when(p | F.lit(fallback_enabled) & ~F.col("_died"), F.concat_ws(": ", "_model", F.coalesce("_msg", F.lit(""))))
    )
    skipped_ok = a.where(p & ok).join(ends.where("used_attempt is null").select("_k", "_last", "_stop_cat", "_died"), "_k").where(over)
    entries = lost.unionByName(skipped_ok).select("_k", (~p).alias("_f"), "_o", entry.alias("_e")).where("_e is not null")
    # one chain's entries: the models configured for one posting
    detail = entries.groupBy("_k").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("_f", "_o", "_e"))), lambda r: r["_e"])).alias("detail"))
    out = ends.join(counts, "_k", "left").join(detail, "_k", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("_k").alias(key_col), "payload", "used_attempt", zero("tried"), zero("skipped"),
                      F.when(F.col("used_attempt").isNull(), F.coalesce("detail", F.lit(""))).alias("detail"))


def attempt_records(attempts: DataFrame, *, ts_col="ts", key_col="posting_id", provider_col="provider",
                    model_col="model", ok_col="succeeded", latency_col="latency_ms", category_col="error_category",
                    order_col="attempt", tier_col="tier", hash_col="content_hash", chars_col="posting_chars",
                    index_col="chain_index", usage_cols=()) -> DataFrame:
    """The attempt-log record (never the text itself). ``index_col``
    is the attempt's place in its chain, from 0; ``usage_cols`` (token counts)
    are passed on."""
    return attempts.select(
        F.col(ts_col).alias("timestamp"), F.col(key_col).cast("string").alias("extract_id"),
        F.col(provider_col).alias("provider"), F.col(model_col).alias("model"),
        F.when(F.col(ok_col), F.lit("success")).otherwise(F.lit("failure")).alias("status"),
        F.col(latency_col).cast("int").alias("response_time_ms"),
        # every attempt after the chain's first one
        ((F.col(tier_col) != "primary") | (F.col(index_col) > 0)).alias("fallback_used"),
        F.when(F.col(ok_col), F.lit("accepted")).when(F.col(category_col) == "validation_failure", F.lit("rejected")).otherwise(F.lit("n/a")).alias("validation_result"),
        F.when(~F.col(ok_col), F.col(category_col)).alias("error_category"),
        F.col(order_col).cast("int").alias("attempt_index"),
        F.col(chars_col).cast("int").alias("posting_chars"),
        F.substring(F.col(hash_col), 1, 12).alias("content_hash_prefix"),
        *usage_cols,
    )


def log_health(records: DataFrame) -> DataFrame:
    """Per provider and model: attempts, success rate, category counts,
    fallback share, exact median and p95 latency, token sums where the records
    have them.

    Records are counted per latency first, so what a group keeps for its
    percentiles is bounded by its distinct latencies (whole milliseconds)."""
    group = ["provider", "model"]
    n = F.count(F.lit(1))
    tokens = [c for c in ("prompt_tokens", "completion_tokens", "total_tokens") if c in records.columns]
    totals = records.groupBy(*group).agg(
        n.alias("attempts"),
        F.count_if(F.col("status") == "success").alias("successes"),
        round_half_even(F.count_if(F.col("status") == "success") / n, 4).alias("success_rate"),
        *[F.count_if(F.col("error_category") == c).alias(f"n_{c}") for c in
          ("rate_limit", "parse_error", "timeout", "validation_failure", "api_error", "connection", "other")],
        round_half_even(F.count_if(F.col("fallback_used")) / n, 4).alias("fallback_share"),
        *[F.sum(c).alias(c) for c in tokens])
    lat = F.col("response_time_ms").cast("double")
    seen = records.where(lat.isNotNull()).groupBy(*group, lat.alias("_l")).agg(n.alias("_n"))
    share = seen.groupBy(*group).agg(F.percentile("_l", 0.5, F.col("_n")).alias("latency_p50"), F.percentile("_l", 0.95, F.col("_n")).alias("latency_p95"))
    return totals.join(share, group, "left")
