"""Semester grid, phase labels and the debt recurrence.

Within a phase every semester turns a debt D into g D + b, so n semesters turn
it into g^n D + b (g^n - 1) / (g - 1). A contract's debts at the ends of its
phases follow from each other in this way; a semester then needs the end of the
phase before and its place in its own phase. There is neither an iteration nor
a shuffle, and the plan is the same for any horizon.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.functions.dates import semester_starts
from parcelio.functions.nulls import left_join_null_safe
from parcelio.functions.numbers import clamp_negative, round_half_even

# The projection horizon and the phase labels.
HORIZON_START = date(2018, 1, 1)
HORIZON_END = date(2030, 7, 1)
LABEL_USE = "1-utilizacao"
LABEL_GRACE = "2-carencia"
LABEL_REPAY = "3-amortizacao"
LABEL_DONE = "4-sem fase"
LABEL_NONE = ""

BOUNDARIES = (
    "in_utilizacao",
    "fim_utilizacao",
    "in_carencia",
    "fim_carencia",
    "in_amortizacao",
    "fim_amortizacao",
)

_FAR = 1_000_000


def grid_limits(lifecycle: DataFrame) -> DataFrame:
    """One row: the first use semester and the last repayment semester of all."""
    return lifecycle.agg(
        F.min("in_utilizacao").alias("first_semester"),
        F.max("fim_amortizacao").alias("last_semester"),
    )


def within_limits(lifecycle: DataFrame, semesters: DataFrame, start: date) -> DataFrame:
    """Keep the semesters that lie between the limits of the whole portfolio.

    The opening debt belongs to the first semester of the horizon, so a
    portfolio that begins later has no projection and is refused.
    """
    limits = grid_limits(lifecycle).select(
        F.struct("first_semester", "last_semester").alias("limits")
    ).scalar()
    too_late = F.lit("the first contract starts after the first semester of the horizon")
    checked = F.when(
        limits["first_semester"] > F.lit(start), F.raise_error(too_late).cast("boolean")
    ).otherwise(F.col("cmpt") <= limits["last_semester"])
    return semesters.filter(checked)


def semester_grid(
    lifecycle: DataFrame,
    keep: list[str],
    start: date = HORIZON_START,
    end: date = HORIZON_END,
) -> DataFrame:
    """One row per contract and semester of the horizon, with `keep` columns.

    Each contract unfolds its own semesters: there is no cross join and the
    attributes ride along instead of being joined back.
    """
    days = F.array(*[F.lit(d) for d in semester_starts(start, end)])
    grid = lifecycle.select(*keep, F.explode(days).alias("cmpt"))
    return within_limits(lifecycle, grid, start)


def phase_label(semester: Column, end: date = HORIZON_END) -> Column:
    """Label of the phase a semester falls in.

    Phases are tested from the latest to the earliest: the semester in which
    repayment ends already counts as finished.
    """
    return (
        F.when(semester.between(F.col("fim_amortizacao"), F.lit(end)), LABEL_DONE)
        .when(semester.between(F.col("in_amortizacao"), F.col("fim_amortizacao")), LABEL_REPAY)
        .when(semester.between(F.col("in_carencia"), F.col("fim_carencia")), LABEL_GRACE)
        .when(semester.between(F.col("in_utilizacao"), F.col("fim_utilizacao")), LABEL_USE)
        .otherwise(LABEL_NONE)
    )


def semester_number(first: Column, semester: Column) -> Column:
    """1 for the first semester, 2 for the next, and so on."""
    months = (F.year(semester) - F.year(first)) * 12 + F.month(semester) - F.month(first)
    return F.floor(months / 6).cast("int") + 1


def phase_first_semester(label: Column, start: date = HORIZON_START) -> Column:
    """First visible semester of a labelled phase.

    Phases are runs of consecutive semesters, so the position inside a phase
    follows from its first visible semester; no window or shuffle is needed.
    """
    begin = (
        F.when(label == LABEL_USE, F.col("in_utilizacao"))
        .when(label == LABEL_GRACE, F.col("in_carencia"))
        .when(label == LABEL_REPAY, F.col("in_amortizacao"))
        .when(label == LABEL_DONE, F.col("fim_amortizacao"))
    )
    return F.greatest(begin, F.lit(start))


def with_semester_index(labelled: DataFrame, start: date = HORIZON_START) -> DataFrame:
    """Add the position within the contract and within the phase."""
    first = phase_first_semester(F.col("fase"), start)
    return labelled.withColumns(
        {
            "id_cpf": semester_number(F.lit(start), F.col("cmpt")),
            "id_fase": semester_number(first, F.col("cmpt")),
        }
    )


def _amounts(threshold: float) -> dict[str, Column]:
    """Per-contract factors and amounts of the recurrence.

    A missing amount becomes NaN, which passes through every later sum and
    product; columns that cannot be null compile to plain arithmetic.
    """
    growth = 1 + F.col("tx_juros") / 200
    cut = F.col("vlr_abatimento") * growth
    shared = cut * (1 - F.col("score"))
    defaulter = F.col("score") > F.lit(threshold)
    amounts = {
        "p_growth": growth,
        "p_draw": F.col("vlr_semestre"),
        "p_cut_full": F.when(defaulter, F.lit(0.0)).otherwise(-cut),
        "p_cut_shared": F.when(defaulter, F.lit(0.0)).otherwise(-shared),
        "p_cut_always": -shared,
        "p_seed": F.col("valor_divida"),
    }
    nan = F.lit(float("nan"))
    return {name: F.coalesce(a.cast("double"), nan) for name, a in amounts.items()}


def _positions(start: date) -> dict[str, Column]:
    """Phase boundaries as positions on the horizon, 1 being its first semester.

    A missing boundary becomes a position that no semester reaches.
    """
    never = {"in": F.lit(_FAR), "fim": F.lit(-_FAR)}
    positions = {}
    for boundary in BOUNDARIES:
        edge = boundary.split("_")[0]
        fallback = F.lit(_FAR) if boundary == "fim_amortizacao" else never[edge]
        position = semester_number(F.lit(start), F.col(boundary))
        positions[f"p_{boundary}"] = F.coalesce(position, fallback)
    return positions


def _grown(debt: str, amount: str, n: str) -> str:
    """A debt after n semesters of growth that each add an amount; no semester leaves it alone."""
    added = f"CASE WHEN p_growth = 1 THEN {n} ELSE (pow(p_growth, {n}) - 1) / (p_growth - 1) END"
    return f"CASE WHEN {n} <= 0 THEN {debt} ELSE {debt} * pow(p_growth, {n}) + {amount} * ({added}) END"


#: Semesters of use and of grace from the second of the horizon on, as far as the debt is not yet
#: settled; a semester of both is one of grace. Without use the pair is (2, 1), without grace the
#: pair lies empty behind the use.
_PERIODS = (
    "greatest(p_in_carencia, 2) AS grace_in",
    "least(p_fim_carencia, p_fim_amortizacao - 1) AS grace_out",
    "greatest(p_in_utilizacao, 2) AS use_in",
    "least(p_fim_utilizacao, p_fim_amortizacao - 1, "
    "CASE WHEN grace_in <= grace_out THEN grace_in - 1 ELSE p_fim_utilizacao END) AS use_out",
    "CASE WHEN use_in <= use_out THEN use_in ELSE 2 END AS use_from",
    "CASE WHEN use_in <= use_out THEN use_out ELSE 1 END AS use_to",
    "CASE WHEN grace_in <= grace_out THEN grace_in ELSE use_to + 1 END AS grace_from",
    "CASE WHEN grace_in <= grace_out THEN grace_out ELSE use_to END AS grace_to",
)


def _ends(variant: str, cut: str) -> list[str]:
    """Debts before use, after it, before grace and after it.

    Outside use and grace each semester adds the (negative) cut of the variant,
    a semester of use adds a draw, one of grace nothing.
    """
    return [
        f"{_grown('p_seed', cut, '(use_from - 2)')} AS {variant}_1",
        f"{_grown(f'{variant}_1', 'p_draw', '(use_to - use_from + 1)')} AS {variant}_2",
        f"{_grown(f'{variant}_2', cut, '(grace_from - use_to - 1)')} AS {variant}_3",
        f"{_grown(f'{variant}_3', '0e0', '(grace_to - grace_from + 1)')} AS {variant}_4",
    ]


def _ends_of_variant_four() -> list[str]:
    """The same for variant IV, which is variant I at the ends of use and grace."""
    cut = "p_cut_always"
    return [
        f"{_grown('p_seed', cut, '(use_from - 2)')} AS d4_1",
        "CASE WHEN use_from <= use_to THEN d1_2 ELSE d4_1 END AS d4_2",
        f"{_grown('d4_2', cut, '(grace_from - use_to - 1)')} AS d4_3",
        "CASE WHEN grace_from <= grace_to THEN d1_4 ELSE d4_3 END AS d4_4",
    ]


def _debt_at(i: Column, variant: str, cut: str) -> Column:
    """The debt of a variant in semester `i`."""
    growth = F.col("p_growth")

    def by_period(before, use, between, grace, after) -> Column:
        return (
            F.when(i < F.col("use_from"), before)
            .when(i <= F.col("use_to"), use)
            .when(i < F.col("grace_from"), between)
            .when(i <= F.col("grace_to"), grace)
            .otherwise(after)
        )

    debt = by_period(F.col("p_seed"), *(F.col(f"{variant}_{k}") for k in (1, 2, 3, 4)))
    amount = by_period(F.col(cut), F.col("p_draw"), F.col(cut), F.lit(0.0), F.col(cut))
    last = by_period(
        F.lit(1), F.col("use_from") - 1, F.col("use_to"), F.col("grace_from") - 1, F.col("grace_to")
    )
    n = i - last
    power = F.pow(growth, n)
    added = F.when(growth == 1, n.cast("double")).otherwise((power - 1) / (growth - 1))
    return F.when(n <= 0, debt).otherwise(debt * power + amount * added)


def _variant_four_at(i: Column) -> Column:
    follows = i.between(F.col("use_from"), F.col("use_to")) | i.between(
        F.col("grace_from"), F.col("grace_to")
    )
    own = _debt_at(i, "d4", "p_cut_always")
    return F.when(follows, _debt_at(i, "d1", "p_cut_full")).otherwise(own)


def project_debt(
    lifecycle: DataFrame,
    keep: list[str],
    threshold: float = 0.3,
    start: date = HORIZON_START,
    end: date = HORIZON_END,
    variant_four: bool = False,
) -> DataFrame:
    """Debt of every contract in every semester of the horizon.

    Input: life-cycle columns, with use before grace, and `score`. Output:
    `keep`, `cmpt`, the phase label and the positions within contract and phase,
    and the unsettled debts: `d1` (variant I), `d2` (variant II), `d2_before`
    (variant II one semester earlier) and, on request, `d4` (variant IV). A
    missing debt is NaN here. The debt of the first semester is the opening
    debt; variant IV follows variant I through use and grace.
    """
    positions = _positions(start)
    prepared = lifecycle.select(
        *keep,
        *[c.alias(n) for n, c in _amounts(threshold).items()],
        *[c.alias(n) for n, c in positions.items()],
    )
    # An expression may name results of earlier ones of the same selection.
    ends = [*_ends("d1", "p_cut_full"), *_ends("d2", "p_cut_shared")]
    if variant_four:
        ends += _ends_of_variant_four()
    n_semesters = len(semester_starts(start, end))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(n_semesters))).alias("id_cpf")
    unfolded = prepared.selectExpr("*", *_PERIODS, *ends).select("*", numbers)
    i = F.col("id_cpf")
    debts = {
        "d1": _debt_at(i, "d1", "p_cut_full"),
        "d2": _debt_at(i, "d2", "p_cut_shared"),
        "d2_before": F.when(i > 1, _debt_at(i - 1, "d2", "p_cut_shared")),
    }
    if variant_four:
        debts["d4"] = _variant_four_at(i)
    projected = unfolded.select(
        *keep,
        F.add_months(F.lit(start), (i - 1) * 6).alias("cmpt"),
        "id_cpf",
        _label_by_position().alias("fase"),
        _position_in_phase().alias("id_fase"),
        *[c.alias(n) for n, c in debts.items()],
    )
    return within_limits(lifecycle, projected, start)


def _label_by_position() -> Column:
    i = F.col("id_cpf")
    return (
        F.when(i >= F.col("p_fim_amortizacao"), LABEL_DONE)
        .when(i >= F.col("p_in_amortizacao"), LABEL_REPAY)
        .when(i.between(F.col("p_in_carencia"), F.col("p_fim_carencia")), LABEL_GRACE)
        .when(i.between(F.col("p_in_utilizacao"), F.col("p_fim_utilizacao")), LABEL_USE)
        .otherwise(LABEL_NONE)
    )


def _position_in_phase() -> Column:
    i = F.col("id_cpf")
    begin = (
        F.when(i >= F.col("p_fim_amortizacao"), F.col("p_fim_amortizacao"))
        .when(i >= F.col("p_in_amortizacao"), F.col("p_in_amortizacao"))
        .when(i.between(F.col("p_in_carencia"), F.col("p_fim_carencia")), F.col("p_in_carencia"))
        .when(
            i.between(F.col("p_in_utilizacao"), F.col("p_fim_utilizacao")),
            F.col("p_in_utilizacao"),
        )
        .otherwise(F.lit(1))
    )
    return i - F.greatest(begin, F.lit(1)) + 1


def settle(debt: Column) -> Column:
    """Final form of a projected debt: not negative, whole, null if unknown."""
    known = F.when(~F.isnan(debt), debt)
    return round_half_even(clamp_negative(known))


def debt_columns(projected: DataFrame) -> DataFrame:
    """Settled debts of every variant; variant III equals variant II."""
    settled = projected.withColumns(
        {
            "valor_divida": settle(F.col("d1")),
            "valor_divida_II": settle(F.col("d2")),
            "valor_divida_III": settle(F.col("d2")),
            "valor_divida_III_anterior": settle(F.col("d2_before")),
        }
    )
    if "d4" in projected.columns:
        settled = settled.withColumn("valor_divida_IV", settle(F.col("d4")))
    return settled.drop("d1", "d2", "d4", "d2_before")


def opening_debt(
    grid: DataFrame, contracts: DataFrame, start: date = HORIZON_START
) -> DataFrame:
    """Attach the opening debt to the first semester and the amounts to all.

    The join form of the seed of the recurrence, for grids that were built
    elsewhere. The opening debt belongs to one semester, the same for all
    contracts, so the join on contract and semester and the join on contract
    are one join and one condition.
    """
    amounts = contracts.select("cpf", "valor_divida", "vlr_semestre", "vlr_abatimento")
    joined = left_join_null_safe(grid, amounts, {"cpf": "cpf"})
    return joined.withColumn(
        "valor_divida", F.when(F.col("cmpt") == F.lit(start), F.col("valor_divida"))
    )
