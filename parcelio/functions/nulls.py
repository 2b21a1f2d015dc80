"""Missing-value rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def propagate_null(source: Column, result: Column) -> Column:
    """`result`, but null wherever `source` is null.

    A plain `when` chain sends a null test to its `otherwise`; the rules built
    here want an unknown input to give an unknown answer.
    """
    return F.when(source.isNotNull(), result)


def sum_strict(value: Column) -> Column:
    """Sum that is null as soon as one row of the group is null."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def mean_strict(value: Column) -> Column:
    """Mean that is null as soon as one row of the group is null."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.avg(value))


def left_join_null_safe(
    left: DataFrame, right: DataFrame, on: dict[str, str]
) -> DataFrame:
    """Left join in which a null key matches a null key.

    `on` maps left column names to right column names; the right key columns
    are dropped from the result. The join type is left to Spark, which
    broadcasts a side only when its size is below the configured threshold.
    """
    marked = {right_key: f"__key_{i}" for i, right_key in enumerate(on.values())}
    renamed = right.withColumnsRenamed(marked)
    condition = None
    for left_key, right_key in on.items():
        test = F.col(f"`{left_key}`").eqNullSafe(F.col(marked[right_key]))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, "left").drop(*marked.values())


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a lookup table for broadcast once its size is checked.

    A table of more than `rows` rows is returned unmarked; Spark then chooses
    the join from its own statistics.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fill_missing(
    df: DataFrame, number: float = 0, text: str | None = None, text_columns: Iterable[str] = ()
) -> DataFrame:
    """Numeric nulls become `number`; nulls of `text_columns` become `text`.

    Dates are left alone: a date filled with zero would read as 1970-01-01.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    filled = df.na.fill(number, subset=numeric) if numeric else df
    text_columns = list(text_columns)
    if text is not None and text_columns:
        filled = filled.na.fill(text, subset=text_columns)
    return filled


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())
