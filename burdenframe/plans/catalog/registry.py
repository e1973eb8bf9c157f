"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def undotted(df: DataFrame) -> DataFrame:
    """Bin columns with an underscore for the dot, so that they can be selected unquoted."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: undotted(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = re.sub(r'"(\w+)\.(\w+)"', r'"\1_\2"', sql)
        return fn

    return keep


def r(col: Column | str) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, DIGITS) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    """Round every floating-point column."""
    return df.select(
        *[r(f"`{c}`").alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def strings(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
