"""Reads over JDBC.

Connection settings are given by the caller as options; none are kept here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelio.operators.dictionaries import MODEL_PHASES


def parallel_options(
    column: str, lower: int, upper: int, partitions: int, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options that split a read into ranges of a numeric column.

    The bounds only shape the ranges; rows outside them are read as well.
    """
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_jdbc(
    spark: SparkSession,
    table: str,
    connection: Mapping[str, str],
    parallel: Mapping[str, str] | None = None,
) -> DataFrame:
    """One database table; later filters and selections are pushed down."""
    reader = spark.read.format("jdbc").options(**connection).option("dbtable", table)
    return reader.options(**(parallel or {})).load()


def filter_phases(
    portfolio: DataFrame, phase: str = "FaseSISFIES", phases: Sequence[str] = MODEL_PHASES
) -> DataFrame:
    """Contracts in the given phases with a known delay."""
    return portfolio.filter(F.col(phase).isin(*phases)).filter(F.col("DiasAtraso").isNotNull())


def read_portfolio(
    spark: SparkSession,
    table: str,
    connection: Mapping[str, str],
    parallel: Mapping[str, str] | None = None,
) -> DataFrame:
    return filter_phases(read_jdbc(spark, table, connection, parallel))


EXTRACT_TABLES = (
    "balances",
    "accounts",
    "linked_programmes",
    "programmes",
    "statuses",
    "entities",
)


def read_extract_tables(
    spark: SparkSession,
    names: Mapping[str, str],
    connection: Mapping[str, str],
    parallel: Mapping[str, Mapping[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """The six tables of the account extract, by role.

    `names` gives the database name of each role; the result feeds
    `operators.balances.account_extract`.
    """
    missing = [role for role in EXTRACT_TABLES if role not in names]
    if missing:
        raise ValueError(f"no table name for {missing}")
    parallel = parallel or {}
    return {
        role: read_jdbc(spark, names[role], connection, parallel.get(role))
        for role in EXTRACT_TABLES
    }
