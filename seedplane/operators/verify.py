"""Integrity checks as DataFrames: Spark enforces no constraint, so each is a query whose rows are violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedplane.functions.dialect import SPARK, Spark
from seedplane.functions.generators import luhn_sum, mod97


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows whose NULL-free key has no parent."""
    keys = parent.select(*[F.col(p).alias(f"__k{i}") for i, p in enumerate(parent_columns)]).distinct()
    present = child.dropna(subset=columns)
    on = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(columns)]
    return present.join(keys, on, "left_anti")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("copies")).filter("copies > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def outside(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(*labels))


def failing(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which a CHECK is false; unknown passes, as in SQL."""
    return df.filter(~check)


def luhn_valid(value: str, d: Spark = SPARK) -> str:
    return f"({luhn_sum(d, value)} = 0)"


def iban_valid(value: str, d: Spark = SPARK) -> str:
    """Letters count as two digits; the first four characters move to the end."""
    moved = f"concat(substr({value}, 5), substr({value}, 1, 4))"
    expanded = d.chars(moved, f"case when {d.matches('c', '^[A-Z]$')} then cast(ascii(c) - 55 as {d.strings()}) else c end")
    return f"({mod97(d, f'({expanded})')} = 1)"
