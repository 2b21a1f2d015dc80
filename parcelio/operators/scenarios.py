"""Guarantee-fund provisions by semester under four scenarios.

1: defaulters only, whole debt.  2: defaulters whole, others by score.
3: as 2 in the first repayment semester, then the earlier debt times the rate.
4: everybody by score.  Provisions arise only in repayment semesters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.functions.nulls import sum_strict
from parcelio.operators.projection import LABEL_REPAY

SCENARIOS = (1, 2, 3, 4)


def provision_amount(scenario: int, threshold: float = 0.3, rate_scale: float = 1.0) -> Column:
    """Provision of one contract in one semester.

    Scenario 3 multiplies by the yearly rate in percent, as the published
    totals do; `rate_scale=0.01` would read it as a fraction.
    """
    repaying = F.col("fase") == LABEL_REPAY
    score = F.col("score")
    share = F.col("percent_garantia") / 100
    debt_two = F.col("valor_divida_II") * share
    if scenario == 1:
        amount = F.col("valor_divida") * share
    elif scenario == 2:
        amount = F.when(score > threshold, debt_two).otherwise(debt_two * score)
    elif scenario == 3:
        later = F.col("valor_divida_III_anterior") * F.col("tx_juros")
        if rate_scale != 1.0:
            later = later * F.lit(rate_scale)
        amount = (
            F.when(score > threshold, debt_two)
            .when(F.col("id_fase") == 1, debt_two * score)
            .otherwise(later)
        )
    elif scenario == 4:
        amount = debt_two * score
    else:
        raise ValueError(f"unknown scenario {scenario}")
    return F.when(repaying, amount).otherwise(F.lit(0.0))


def provision_scenario(
    debts: DataFrame, scenario: int, threshold: float = 0.3, rate_scale: float = 1.0
) -> DataFrame:
    """Contracts and total provision per semester under one scenario."""
    rows = debts.filter(F.col("score") > threshold) if scenario == 1 else debts
    amount = provision_amount(scenario, threshold, rate_scale)
    return rows.groupBy("cmpt").agg(
        F.count(F.lit(1)).alias("qtd_contratos"),
        sum_strict(amount).alias(f"tot_prov_cen{scenario}"),
    )


def provision_all(
    debts: DataFrame, threshold: float = 0.3, rate_scale: float = 1.0
) -> DataFrame:
    """The four scenarios side by side from one pass over the projection."""
    counted = F.col("score") > threshold
    amounts = {
        s: provision_amount(s, threshold, rate_scale) for s in SCENARIOS
    }
    # Rows outside scenario 1 add an exact zero to its total.
    amounts[1] = F.when(counted, amounts[1]).otherwise(F.lit(0.0))
    return debts.groupBy("cmpt").agg(
        F.count(F.lit(1)).alias("qtd_contratos"),
        F.count_if(counted).alias("qtd_contratos_cen1"),
        *[sum_strict(a).alias(f"tot_prov_cen{s}") for s, a in amounts.items()],
    )
