"""Contract regimes, life-cycle dates and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.functions.dates import add_semesters, half_year_floor
from parcelio.functions.nulls import broadcast_if_small, left_join_null_safe, propagate_null
from parcelio.functions.numbers import divide_or_null, round_half_even
from parcelio.operators import intervals

# Phase names, the regime used when no period matches, and the
# extra amortisation semesters of the earlier regimes.
PHASE_USE = "utilizacao"
PHASE_GRACE = "carencia"
CATCH_ALL_REGIME = "III"
EXTRA_SEMESTERS = 2
REGIMES_WITH_EXTRA = ("I", "II")
GRACE_SEMESTERS = 3

# Terms of a regime that are attached to its contracts.
TERMS = ("carencia", "amortizacao", "pgto_juros", "percent_garantia")

# Regimes that are written into the plan as conditions.
LITERAL_REGIMES = 16

# Regimes whose terms every executor may hold.
TERMS_LIMIT = 100_000


def assign_regime(
    contracts: DataFrame, regimes: DataFrame, catch_all: str = CATCH_ALL_REGIME
) -> DataFrame:
    """Attach the regime in force on the signing date, and its terms.

    Dates outside every period take `catch_all`; a missing date stays without
    regime. A null start or end of a period is open. Where periods overlap, the
    one that starts first wins. A handful of
    regimes becomes plain conditions of the plan, without a join; a longer
    table is joined.
    """
    rows = regimes.orderBy("inicio", "tipo_regencia").limit(LITERAL_REGIMES + 1).collect()
    if len(rows) > LITERAL_REGIMES:
        return join_regimes(contracts, regimes, catch_all)
    signed = F.col("dt_assinatura_contrato")
    name = F.lit(catch_all)
    for row in reversed(rows):
        begun = F.lit(True) if row["inicio"] is None else signed >= F.lit(row["inicio"])
        in_force = begun & (F.lit(True) if row["fim"] is None else signed <= F.lit(row["fim"]))
        name = F.when(in_force, row["tipo_regencia"]).otherwise(name)
    named = contracts.withColumn("tipo_regencia", propagate_null(signed, name))
    terms = {}
    for term in TERMS:
        value = F.lit(None)
        for row in reversed(rows):
            same = F.col("tipo_regencia") == row["tipo_regencia"]
            value = F.when(same, F.lit(row[term])).otherwise(value)
        terms[term] = value.cast(regimes.schema[term].dataType)
    return named.withColumns(terms)


def join_regimes(
    contracts: DataFrame, regimes: DataFrame, catch_all: str = CATCH_ALL_REGIME
) -> DataFrame:
    """`assign_regime` for any number of regimes, of any length, with open ends.

    Contracts are not shuffled while the periods are few; otherwise their
    distinct dates are swept with the periods. The terms are broadcast once
    their size is checked.
    """
    signed = F.col("dt_assinatura_contrato")
    named = regimes.select("inicio", "fim", F.col("tipo_regencia").alias("regime_do_dia"))
    dated = intervals.lookup(
        contracts, "dt_assinatura_contrato", named, "inicio", "fim", ["regime_do_dia"]
    ).withColumn(
        "tipo_regencia",
        propagate_null(signed, F.coalesce(F.col("regime_do_dia"), F.lit(catch_all))),
    )
    terms = broadcast_if_small(regimes.select("tipo_regencia", *TERMS), TERMS_LIMIT)
    return left_join_null_safe(
        dated.drop("regime_do_dia"), terms, {"tipo_regencia": "tipo_regencia"}
    )


def contract_lifecycle(contracts: DataFrame) -> DataFrame:
    """Durations, phase boundary dates and amounts of each contract.

    A contract whose completed semesters are zero has no semester value; the
    flag `bad_terms` marks it.
    """
    phase = F.col("fase")
    done = F.col("qtd_sem_cursado")
    use = F.when(phase == PHASE_USE, F.col("qtd_sem_contratado")).otherwise(done)
    repay = 3 * F.col("duracao_utilizacao") + F.when(
        F.col("tipo_regencia").isin(*REGIMES_WITH_EXTRA), EXTRA_SEMESTERS
    ).otherwise(0)
    base = F.when(phase.isin(PHASE_USE, PHASE_GRACE), F.col("valor_divida")).otherwise(
        F.col("valor_liberado")
    )
    return (
        contracts.withColumn("duracao_utilizacao", use)
        .withColumns(
            {
                "duracao_amortizacao": repay,
                "in_utilizacao": half_year_floor(F.col("dt_assinatura_contrato")),
                "vlr_semestre": round_half_even(divide_or_null(base, done)),
            }
        )
        .withColumns(
            {
                "fim_utilizacao": add_semesters(
                    F.col("in_utilizacao"), F.col("duracao_utilizacao") - 1
                ),
                "divida_total": round_half_even(
                    F.col("vlr_semestre") * F.col("qtd_sem_contratado")
                ),
            }
        )
        .withColumns(
            {
                "in_carencia": add_semesters(F.col("fim_utilizacao"), F.lit(1)),
                "fim_carencia": add_semesters(F.col("fim_utilizacao"), F.lit(GRACE_SEMESTERS)),
                "vlr_abatimento": round_half_even(
                    divide_or_null(F.col("divida_total"), F.col("duracao_amortizacao"))
                ),
            }
        )
        .withColumns(
            {
                "in_amortizacao": add_semesters(F.col("fim_carencia"), F.lit(1)),
                "fim_amortizacao": add_semesters(
                    F.col("fim_carencia"), F.col("duracao_amortizacao")
                ),
                "bad_terms": F.col("vlr_semestre").isNull() | F.col("vlr_abatimento").isNull(),
            }
        )
    )


def score_or_default(score: Column, default_score: float = 0.5) -> Column:
    return F.coalesce(score, F.lit(default_score))


def attach_scores(
    contracts: DataFrame, scores: DataFrame, default_score: float = 0.5
) -> DataFrame:
    """Left join of payer scores; a contract without score takes the default."""
    joined = left_join_null_safe(contracts, scores.select("cpf", "score"), {"cpf": "cpf"})
    return joined.withColumn("score", score_or_default(F.col("score"), default_score))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values held by more than one row, with their counts.

    The grid and the name joins multiply rows on repeated keys, so callers can
    check for them first.
    """
    return df.groupBy(*keys).count().filter(F.col("count") > 1)
