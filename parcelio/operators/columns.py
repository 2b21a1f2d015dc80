"""Selection, renaming, filtering, recoding and casting of whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename all columns in order; the number of names must match."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns by name; names the table does not have are ignored."""
    return df.drop(*columns)


def date_between(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    return df.filter(F.col(column).between(F.lit(first), F.lit(last)))


def filter_unless_all(
    df: DataFrame, column: str, choice: str | None, all_choice: str = "Todos"
) -> DataFrame:
    """Rows equal to `choice`; every row for the "all" choice or none given."""
    if choice is None or choice == all_choice:
        return df
    return df.filter(F.col(column) == choice)


def filter_members(df: DataFrame, column: str, members: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(*members))


def masked_update(df: DataFrame, column: str, where: Column, value: Column) -> DataFrame:
    """Replace `column` where the condition holds; unknown counts as no."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def batch_cast(df: DataFrame, columns: Sequence[str], to: str) -> DataFrame:
    """Cast several columns; text that is not such a value becomes null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(to) for c in columns})
