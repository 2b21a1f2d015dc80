"""Writers: scenario totals, digests and delimited exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the longest number of decimals of an exported amount.
EXPORT_DECIMALS = 5


def comma_number(value: Column, decimals: int = EXPORT_DECIMALS) -> Column:
    """Plain decimal text with a comma and without trailing zeros."""
    text = value.cast(T.DecimalType(38, decimals)).cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.translate(trimmed, ".", ",")


def scenario_rows(totals: DataFrame, amount: str) -> DataFrame:
    """Text rows of a scenario file: index, semester, contracts, amount.

    One row per semester, so the numbering window covers a bounded table.
    """
    return totals.select(
        F.row_number().over(Window.orderBy("cmpt")).cast("string").alias("index"),
        F.col("cmpt").cast("string").alias("cmpt"),
        F.col("qtd_contratos").cast("string").alias("qtd_contratos"),
        comma_number(F.col(amount)).alias(amount),
    )


def write_scenario(totals: DataFrame, amount: str, path: str) -> None:
    """`;`-separated file with quoted header and index and a decimal comma."""
    rows = scenario_rows(totals, amount)
    quoted = F.concat(F.lit('"'), F.col("index"), F.lit('"'))
    header = ";".join(f'"{name}"' for name in ("", "cmpt", "qtd_contratos", amount))
    lines = rows.select(
        F.col("index").cast("int").alias("n"),
        F.concat_ws(";", quoted, "cmpt", "qtd_contratos", amount).alias("value"),
    )
    first = totals.sparkSession.range(1).select(
        F.lit(0).alias("n"), F.lit(header).alias("value")
    )
    first.unionByName(lines).coalesce(1).sortWithinPartitions("n").select("value").write.mode(
        "overwrite"
    ).text(path)


def write_digest(digest: DataFrame, path: str, body: str = "body") -> None:
    """Digest text, one row per block; keep the blocks' order in one file."""
    digest.select(F.col(body).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_semicolon(
    df: DataFrame,
    path: str,
    encoding: str = "UTF-8",
    date_format: str = "yyyy-MM-dd",
    comma_columns: Sequence[str] = (),
) -> None:
    """`;`-separated files with header; `comma_columns` get a decimal comma."""
    out = df.withColumns({c: comma_number(F.col(c)) for c in comma_columns}) if comma_columns else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("sep", ";")
        .option("nullValue", "NA")
        .option("emptyValue", "")
        .option("encoding", encoding)
        .option("dateFormat", date_format)
        .csv(path)
    )
