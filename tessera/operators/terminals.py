"""Terminal operators, as relations (for composition) and as actions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import QueryError


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def any_rows(df: DataFrame) -> DataFrame:
    """found: whether there is a row; stops at the first."""
    return df.select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias("found"))


def first(df: DataFrame, *by: Column | str) -> DataFrame:
    """The first row in this order, any row without one; empty if there is none."""
    return (df.orderBy(*by) if by else df).limit(1)


def to_list(df: DataFrame) -> list[Row]:
    return df.collect()


def stream(df: DataFrame) -> Iterator[Row]:
    """Rows partition by partition; the driver holds one partition at a time."""
    return df.toLocalIterator()


def first_or_none(df: DataFrame, *by: Column | str) -> Row | None:
    return first(df, *by).head()


def first_or_raise(df: DataFrame, *by: Column | str) -> Row:
    row = first_or_none(df, *by)
    if row is None:
        raise QueryError("the sequence contains no elements", phase="Terminal")
    return row
