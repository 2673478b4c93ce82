"""Column contracts (L1, section 1.3): any DataFrame with the contract's
columns works as a series source; typed empty frames for empty sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marketlens.operators.periods import ROLES_SCHEMA, SKILLS_SCHEMA, TOTALS_SCHEMA

CONTRACTS = {"roles": ROLES_SCHEMA, "skills": SKILLS_SCHEMA, "totals": TOTALS_SCHEMA}


def assert_schema(df: DataFrame, schema: T.StructType, *, allow_extra: bool = True) -> DataFrame:
    """Fail early when a column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in schema.fields:
        if f.name not in have:
            problems.append(f"missing column {f.name}")
        elif have[f.name] != f.dataType:
            problems.append(f"column {f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}")
    if not allow_extra:
        extra = set(have) - {f.name for f in schema.fields}
        problems += [f"unexpected column {c}" for c in sorted(extra)]
    if problems:
        raise ValueError("; ".join(problems))
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the contract's columns in order, cast to the contract's types;
    columns missing from an older layout come back NULL."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty(spark: SparkSession, contract: str) -> DataFrame:
    return spark.createDataFrame([], CONTRACTS[contract])
