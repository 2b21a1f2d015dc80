"""From contracts, scores and regimes to provision totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parcelio.functions.nulls import fill_missing
from parcelio.operators import lifecycle, projection, scenarios

# The columns of a contract that must be numbers.
NUMERIC_COLUMNS = ("tx_juros", "qtd_sem_contratado", "qtd_sem_dilatado", "qtd_sem_cursado")

CARRIED = ["cpf", "tx_juros", "score", "percent_garantia"]


def clean_contracts(contracts: DataFrame) -> DataFrame:
    """Missing amounts and counts read as zero; counts are doubles."""
    typed = contracts.withColumns(
        {c: contracts[c].try_cast("double") for c in NUMERIC_COLUMNS}
    )
    return fill_missing(typed)


def contract_terms(contracts: DataFrame, regimes: DataFrame) -> DataFrame:
    """Cleaned contracts with regime, life-cycle dates and amounts."""
    return lifecycle.contract_lifecycle(
        lifecycle.assign_regime(clean_contracts(contracts), regimes)
    )


def debt_projection(
    contracts: DataFrame,
    scores: DataFrame,
    regimes: DataFrame,
    threshold: float = 0.3,
    default_score: float = 0.5,
    variant_four: bool = False,
) -> DataFrame:
    """Settled debts of every contract and semester."""
    terms = lifecycle.attach_scores(contract_terms(contracts, regimes), scores, default_score)
    projected = projection.project_debt(
        terms, CARRIED, threshold=threshold, variant_four=variant_four
    )
    return projection.debt_columns(projected)


def provision_all(
    contracts: DataFrame, scores: DataFrame, regimes: DataFrame, threshold: float = 0.3
) -> DataFrame:
    debts = debt_projection(contracts, scores, regimes, threshold)
    return scenarios.provision_all(debts, threshold)


def provision_scenario(
    contracts: DataFrame,
    scores: DataFrame,
    regimes: DataFrame,
    scenario: int,
    threshold: float = 0.3,
) -> DataFrame:
    debts = debt_projection(contracts, scores, regimes, threshold)
    return scenarios.provision_scenario(debts, scenario, threshold)
