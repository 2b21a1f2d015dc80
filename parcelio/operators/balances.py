"""Fund balances by state, programme and month."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelio.functions.nulls import mean_strict, sum_strict
from parcelio.functions.text import mask_identifier
from parcelio.operators.columns import date_between, filter_members, filter_unless_all

# The four balance measures and the names of the report table.
MEASURES = ("VL_SALDO_CONTA", "VL_SALDO_FUNDOS", "VL_SALDO_POUPANCA", "VL_SALDO_RDB")
REPORT_NAMES = ("SALDO_CONTA", "SALDO_FUNDOS", "SALDO_POUPANCA", "SALDO_RDB")

STATE = "SG_UF"
MONTH = "ME_REFERENCIA"
PROGRAMME = "DS_PROGRAMA"


def choose(
    balances: DataFrame,
    state: str | None = None,
    programmes: Sequence[str] | None = None,
    first: date | None = None,
    last: date | None = None,
) -> DataFrame:
    """Cascading report filters: period, then state, then programmes."""
    chosen = balances
    if first is not None and last is not None:
        chosen = date_between(chosen, MONTH, first, last)
    elif first is not None:
        chosen = chosen.filter(F.col(MONTH) >= F.lit(first))
    chosen = filter_unless_all(chosen, STATE, state)
    if programmes is not None:
        chosen = filter_members(chosen, PROGRAMME, programmes)
    return chosen


def balance_by_state(balances: DataFrame) -> DataFrame:
    """Totals of the four measures per state and month."""
    sums = [sum_strict(F.col(m)).alias(f"saldo_{i}") for i, m in enumerate(MEASURES, 1)]
    return balances.groupBy(STATE, MONTH).agg(*sums)


def balance_table(balances: DataFrame) -> DataFrame:
    """Totals of the four measures per state, month and programme, for display."""
    sums = [sum_strict(F.col(m)).alias(n) for m, n in zip(MEASURES, REPORT_NAMES)]
    return (
        balances.groupBy(STATE, MONTH, PROGRAMME)
        .agg(*sums)
        .select(
            F.col(STATE).alias("UF"),
            F.col(MONTH).cast("string").alias("DATA"),
            F.col(PROGRAMME).alias("PROGRAMA"),
            *REPORT_NAMES,
        )
    )


def latest_state_balance(balances: DataFrame) -> DataFrame:
    """Total balance of each state in that state's own latest month.

    The window runs over the grouped totals, at most one row per state and
    month, not over the balances.
    """
    total = reduce(add, map(F.col, MEASURES))
    totals = balances.groupBy(STATE, MONTH).agg(sum_strict(total).alias("value"))
    last = F.max(MONTH).over(Window.partitionBy(STATE))
    return (
        totals.withColumn("__last", last)
        .filter(F.col(MONTH) == F.col("__last"))
        .select(F.col(STATE).alias("code"), "value")
    )


def month_spine(spark, first: date, last: date) -> DataFrame:
    """One row per month from `first` to `last`, both included."""
    months = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias(MONTH))


def monthly_series(
    balances: DataFrame,
    first: date,
    last: date,
    state: str | None = None,
    programme: str | None = None,
    measure: str = "VL_SALDO_FUNDOS",
) -> DataFrame:
    """Regular monthly series of one measure; a month without data is null."""
    chosen = choose(
        balances, state, None if programme is None else [programme], first=first, last=last
    )
    sums = chosen.groupBy(MONTH).agg(sum_strict(F.col(measure)).alias("total_saldo"))
    return month_spine(balances.sparkSession, first, last).join(sums, MONTH, "left")


def state_mean_series(
    balances: DataFrame, state: str, first: date, measure: str = "VL_SALDO_FUNDOS"
) -> DataFrame:
    """Monthly mean of one measure in one state.

    The mean is the same on every row of a month, so the maximum of the
    attached mean is the mean itself: one aggregation, no window.
    """
    return (
        choose(balances, state, first=first)
        .groupBy(MONTH)
        .agg(mean_strict(F.col(measure)).alias("saldo_fundos"))
    )


def account_extract(
    balances: DataFrame,
    accounts: DataFrame,
    linked_programmes: DataFrame,
    programmes: DataFrame,
    statuses: DataFrame,
    entities: DataFrame,
    bank: object,
    programme_codes: Sequence[str],
    mask: tuple[str, str],
) -> DataFrame:
    """Balances with the programme, entity and status of their account.

    Both filters sit on the inputs so that they reach the scans; the bank
    filter holds for the accounts too, which share that key. Accounts are
    narrowed and described first, and only then meet the balances, which hold
    many months per account: one large join, on the four-column account key.
    """
    linked = linked_programmes.filter(F.col("co_programa").isin(*programme_codes)).select(
        F.col("co_programa_vinculado").alias("co_programa")
    )
    described = (
        accounts.filter(F.col("nu_banco") == bank)
        .join(linked, "co_programa")
        .join(programmes, "co_programa")
        .join(entities, "nu_seq_entidade")
        .join(statuses.withColumnRenamed("co_st_conta", "co_situacao_conta"), "co_situacao_conta")
        .drop("nu_seq_entidade", "co_situacao_conta")
        .withColumnRenamed("nu_identificador", "nu_cnpj")
    )
    return (
        balances.filter(F.col("nu_banco") == bank)
        .join(described, ["nu_cnpj", "nu_agencia", "nu_banco", "nu_conta_corrente"])
        .withColumn("nu_processo_mask", mask_identifier(F.col("nu_processo"), *mask))
    )
