"""Columnar tables: scores, polygons, reference and page tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A Parquet table, with only the named columns if any are named."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_polygons(spark: SparkSession, path: str, regions: Sequence[int]) -> DataFrame:
    """Map polygons of some regions; the filter reaches the scan."""
    return read_table(spark, path).filter(F.col("Region").isin(*regions))
