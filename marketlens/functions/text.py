"""String column functions: blank tests, Unicode strip, keys, fingerprints,
sanitising with reject reasons, fenced-block strip.

All functions take and return ``Column`` so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points Python's ``str.strip()`` removes (29 in all):
# U+0009-U+000D, U+001C-U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
_PY_WS_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
]
PY_WS = "".join(chr(c) for lo, hi in _PY_WS_RANGES for c in range(lo, hi + 1))

# Fixed value: glossary field limit.
MAX_GLOSSARY_FIELD_LEN = 200


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Strip the same whitespace set as Python's ``str.strip()`` (not just spaces)."""
    return F.trim(_c(col), F.lit(PY_WS))


def non_blank(col) -> Column:
    """B1: not NULL and not empty after a space-only SQL ``trim``."""
    c = _c(col)
    return c.isNotNull() & (F.trim(c) != F.lit(""))


def optional_stripped(col) -> Column:
    """Unicode strip, empty becomes NULL."""
    return F.nullif(py_strip(col), F.lit(""))


def normalize_key(col) -> Column:
    """B2: lower-cased, Unicode-stripped lookup key."""
    return F.lower(py_strip(col))


def is_identity_pair(a, b) -> Column:
    """Both sides name the same label once normalised."""
    return normalize_key(a) == normalize_key(b)


def fingerprint(col) -> Column:
    """SHA-256 hex of the Unicode-stripped UTF-8 text."""
    return F.sha2(py_strip(col), 256)


def once(df: DataFrame, *cols) -> DataFrame:
    """``df.select(*cols)`` whose columns are computed once per row. A filter goes
    below a plain select, and each of its uses of a column computes it anew;
    below this one it does not go."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def sanitize_field_reason(col, field_name: str = "value", max_len: int = MAX_GLOSSARY_FIELD_LEN, stripped: bool = False) -> Column:
    """Reject reason of a glossary field (NULL when the field is usable);
    a ``stripped`` one is not stripped again."""
    s = F.coalesce(_c(col), F.lit(""))
    s = s if stripped else py_strip(s)
    return (
        F.when(s == "", F.lit(f"{field_name}:empty"))
        .when(s.rlike("[\\t\\n\\r]"), F.lit(f"{field_name}:control_character"))
        .when(F.length(s) > max_len, F.lit(f"{field_name}:length>{max_len}"))
    )


def text_size_reason(col, max_chars: int | None = None) -> Column:
    """Reject reason for a posting text: empty after strip, or longer than
    the cap of a caller who sets one."""
    n = F.length(py_strip(F.coalesce(_c(col), F.lit(""))))
    reason = F.when(n == 0, F.lit("text:empty"))
    return reason if max_chars is None else reason.when(n > max_chars, F.concat(F.lit(f"text:length>{max_chars}:"), n))


def strip_markdown_fences(col) -> Column:
    """For a text starting with three backticks, drop its first line and
    drop a last line that is only three backticks, then strip."""
    s = _c(col)
    body = F.regexp_replace(s, "^[^\\r\\n]*(\\r?\\n|\\z)", "")
    body = F.regexp_replace(body, "(^|\\r?\\n)[ \\t]*```[ \\t]*\\z", "")
    return F.when(s.startswith("```"), py_strip(body)).otherwise(s)


def currency_code(col) -> Column:
    """B13 value: stripped upper-case code, NULL when blank."""
    return F.upper(optional_stripped(col))


def currency_reason(col) -> Column:
    """B13 reason: a present code must be exactly three letters A-Z."""
    code = currency_code(col)
    return F.when(
        code.isNotNull() & ~code.rlike("^[A-Z]{3}$"),
        F.concat(F.lit("salary_currency:not_a_code:"), _c(col).cast("string")),
    )
