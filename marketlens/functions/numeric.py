"""Numeric column functions: non-finite scrub, half-even rounding, salary
midpoint and salary rule, holdout-style clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: upper bound of a salary figure.
SALARY_SOFT_MAX = 50_000_000.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def finite_or_null(col) -> Column:
    """NULL / NaN / +-Inf / uncastable -> NULL, else the double value."""
    d = _c(col).try_cast(T.DoubleType())
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)


def round_half_even(col, digits: int = 0) -> Column:
    """Half-even rounding with numpy / pandas semantics: scale by
    10**digits, round to the nearest even integer, scale back. (``bround``
    alone rounds the shortest decimal form of the double, which differs on
    values such as 9099.825.) NULL stays NULL."""
    if digits == 0:
        return F.bround(_c(col), 0) + F.lit(0.0)
    scale = float(10 ** digits)
    # "+ 0.0" turns a rounded negative zero into zero.
    return F.bround(_c(col) * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def salary_midpoint(lo, hi) -> Column:
    """Both -> mean, one -> that one, none -> NULL."""
    lo_c, hi_c = _c(lo).cast("double"), _c(hi).cast("double")
    return F.coalesce((lo_c + hi_c) / F.lit(2.0), lo_c, hi_c)


def salary_reason(lo, hi, soft_max: float = SALARY_SOFT_MAX) -> Column:
    """Each >= 0 and <= soft_max, and lo <= hi; NULL when valid."""
    lo_c, hi_c = _c(lo), _c(hi)
    return (
        F.when(lo_c < 0, F.lit("salary_min:negative"))
        .when(lo_c > soft_max, F.lit(f"salary_min:above_{soft_max:g}"))
        .when(hi_c < 0, F.lit("salary_max:negative"))
        .when(hi_c > soft_max, F.lit(f"salary_max:above_{soft_max:g}"))
        .when(lo_c > hi_c, F.lit("salary_min:above_salary_max"))
    )


def clamp_point(col, digits: int = 4) -> Column:
    """Forecast value clamped at 0 and rounded half-even to 4 digits."""
    return round_half_even(F.greatest(F.lit(0.0), _c(col)), digits)


def scrub_struct(col: Column, dtype: T.DataType) -> Column:
    """Apply ``finite_or_null`` to every double leaf of a nested value,
    walking structs, arrays and map values by their declared type."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite_or_null(col)
    if isinstance(dtype, T.StructType):
        return F.when(col.isNull(), F.lit(None)).otherwise(
            F.struct(*[scrub_struct(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        )
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: scrub_struct(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _k, v: scrub_struct(v, dtype.valueType))
    return col
