"""Delimited text in the Brazilian conventions.

Schemas are always given: inference would turn identifiers with leading zeros
into numbers. Numbers with a decimal comma must be declared as decimals; Spark
reads them by locale only for that type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns and formats of the regime table.
REGIME_SCHEMA = (
    "inicio date, fim date, tipo_regencia string, tx_juros double, carencia int, "
    "amortizacao string, pgto_juros int, percent_garantia int"
)
DAY_FIRST = "dd/MM/yyyy"


def read_semicolon(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    *,
    null_value: str = "NA",
    date_format: str = "yyyy-MM-dd",
    encoding: str = "UTF-8",
    decimal_comma: bool = True,
) -> DataFrame:
    """`;`-separated text with header, blanks trimmed, decimal comma by default.

    `null_value` marks a missing value; an empty field of a text column is an
    empty text. Spark reads both as null when told the marker, so the marker is
    resolved after the read. A field that is not of its type reads as null.
    """
    options = _semicolon_options(date_format, encoding, decimal_comma)
    reader = spark.read.option("header", True).options(**options)
    return _resolve_marker(reader.schema(schema).csv(path), null_value)


def _semicolon_options(date_format: str, encoding: str, decimal_comma: bool) -> dict[str, str]:
    options = {
        "sep": ";",
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
        "dateFormat": date_format,
        "encoding": encoding,
    }
    return options | ({"locale": "pt-BR"} if decimal_comma else {})


#: What `read_checked` adds: the line, its file, and what is wrong with it.
CHECKS = ("__line", "__file", "__rejects")


def read_checked(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    *,
    null_value: str = "NA",
    date_format: str = "yyyy-MM-dd",
    encoding: str = "UTF-8",
    decimal_comma: bool = True,
) -> DataFrame:
    """As `read_semicolon`, with what is wrong with each line, in the same scan.

    Adds `__file`, `__line` (the text of a line that has a fault, else null) and
    `__rejects`: an array of column, value and reason for each field that is not
    of its type, or one entry without a column where the number of fields is
    wrong. The missing-value marker and an empty field are no faults. Every line
    is a row; `accepted` and `rejected` tell them apart.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    options = _semicolon_options(date_format, encoding, decimal_comma)
    # All columns are parsed, also for a query of some of them: a fault must not depend on the query.
    reader = spark.read.option("header", True).option("columnPruning", False).options(**options)
    reader = reader.option("columnNameOfCorruptRecord", "__line")
    table = reader.schema(T.StructType([*fields, T.StructField("__line", T.StringType())])).csv(path)
    raw = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(fields) + 2)])
    # A mark behind the line tells where its fields end.
    ended = F.concat("__line", F.lit(f"{options['sep']}{_END}"))
    parsed = F.from_csv(ended, ", ".join(f"{f.name} string" for f in raw), options)
    table = table.withColumn("__file", F.col("_metadata.file_path")).withColumn("__raw", parsed)
    checks = []
    for k, f in enumerate(fields):
        value, typed = F.col(f"__raw.c{k}"), F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            continue
        wrong = typed.isNull() & value.isNotNull() & ~value.isin("", null_value)
        checks.append(F.when(wrong, _reject(f.name, value, f"not {f.dataType.simpleString()}")))
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast(_REJECTS)
    amount = F.array(_reject(None, F.lit(None), f"not {len(fields)} fields"))
    behind, beyond = F.col(f"__raw.c{len(fields)}"), F.col(f"__raw.c{len(fields) + 1}")
    whole = behind.eqNullSafe(F.lit(_END)) & beyond.isNull()
    # Spark refuses a query that needs nothing of a file but its doubtful lines, so a field is asked for too.
    field = F.coalesce(F.col(f"`{fields[0].name}`").cast("string"), F.lit(""))
    clean = F.col("__line").isNull() & (F.length(field) >= 0)
    # A marker in a number's place makes the reader doubt the line, without a fault.
    rejects = (
        F.when(clean, F.array().cast(_REJECTS))
        .when(~whole, amount)
        .otherwise(found)
    )
    checked = table.withColumn("__rejects", rejects.cast(_REJECTS)).drop("__raw")
    return _resolve_marker(checked, null_value, CHECKS)


#: A mark that no field has.
_END = "=end of the line="
_REJECTS = "array<struct<column:string,value:string,reason:string>>"


def _reject(column: str | None, value: Column, reason: str) -> Column:
    return F.struct(
        F.lit(column).cast("string").alias("column"),
        value.cast("string").alias("value"),
        F.lit(reason).alias("reason"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    """The rows of lines without fault, with the columns of the schema."""
    return checked.filter(F.size("__rejects") == 0).drop(*CHECKS)


def rejected(checked: DataFrame) -> DataFrame:
    """`file`, `line`, `column`, `value`, `reason`: one row for each fault."""
    faults = checked.filter(F.size("__rejects") > 0)
    return faults.select(
        F.col("__file").alias("file"), F.col("__line").alias("line"), F.inline("__rejects")
    )


def _resolve_marker(
    table: DataFrame, null_value: str, apart: Sequence[str] = ()
) -> DataFrame:
    texts = [
        f.name
        for f in table.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in apart
    ]
    resolved = {
        c: F.nullif(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(null_value)) for c in texts
    }
    return table.withColumns(resolved) if resolved else table


def read_semicolon_latin1(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType, **options
) -> DataFrame:
    """As `read_semicolon`, for files in ISO-8859-1."""
    return read_semicolon(spark, path, schema, encoding="ISO-8859-1", **options)


def read_regimes(spark: SparkSession, path: str) -> DataFrame:
    """Contract regimes: `dd/MM/yyyy` dates and a decimal point."""
    return read_semicolon(
        spark, path, REGIME_SCHEMA, date_format=DAY_FIRST, decimal_comma=False
    )


def read_comma_drop_index(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    index: str = "X1",
    null_value: str = "NA",
) -> DataFrame:
    """`,`-separated text with header; the unnamed index column is dropped.

    `schema` names every column of the file, the index first.
    """
    return (
        spark.read.option("header", True)
        .option("nullValue", null_value)
        .schema(schema)
        .csv(path)
        .drop(index)
    )


def read_comma_latin1(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType
) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("encoding", "ISO-8859-1")
        .schema(schema)
        .csv(path)
    )


def decimals_to_double(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Decimal columns as doubles, once the locale has done its work."""
    chosen = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)
    ]
    return df.withColumns({c: df[c].cast("double") for c in chosen}) if chosen else df
