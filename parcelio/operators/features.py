"""Credit-risk features: joins, dictionaries and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.functions.dates import age_years
from parcelio.functions.nulls import (
    broadcast_if_small,
    left_join_null_safe,
    propagate_null,
)
from parcelio.functions.text import pad_left
from parcelio.operators import dictionaries as d
from parcelio.session import shared_folder

# Course names that every executor may hold.
NAME_LIMIT = 100_000


def default_flag(days_late: Column, limit: int = 365) -> Column:
    """1 when more than `limit` days late, else 0; unknown stays unknown."""
    return propagate_null(days_late, F.when(days_late > limit, 1).otherwise(0)).cast("bigint")


def lookup(value: Column, groups: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    """Name of the group that lists `value`, or `otherwise` (also for null)."""
    chain = None
    for name, members in groups.items():
        listed = value.isin(*members)
        chain = F.when(listed, name) if chain is None else chain.when(listed, name)
    return chain.otherwise(otherwise)


def region_of_state(state: Column) -> Column:
    return lookup(state, d.STATE_REGIONS, F.lit(d.OTHER_REGION))


def canonical_course(name: Column) -> Column:
    return lookup(name, d.COURSE_ALIASES, name)


def course_group(name: Column) -> Column:
    return lookup(name, d.COURSE_GROUPS, F.lit(d.OTHER_GROUP))


def join_sponsors(portfolio: DataFrame, sponsors: DataFrame) -> DataFrame:
    """Size and student count of the sponsoring institution."""
    sized = sponsors.select(
        "Porte",
        "QTD alunos por Mantenedora",
        pad_left(F.col("CNPJ Mantenedora"), 14).alias("CNPJ Mantenedora"),
    )
    return left_join_null_safe(portfolio, sized, {"CnpjMant": "CNPJ Mantenedora"})


def join_course_codes(portfolio: DataFrame, courses: DataFrame) -> DataFrame:
    """Course code by upper-cased course name; courses without code are ignored."""
    coded = courses.filter(F.col("CodCurso") != "").select(
        F.upper("NomeCurso").alias("NomeCurso"), "CodCurso"
    )
    return left_join_null_safe(portfolio, coded, {"NomeCurso": "NomeCurso"})


def course_counts(df: DataFrame, name: str = "nome_curso_cat") -> DataFrame:
    """Rows per course name, ascending by count in the report order."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def pool_rare(
    df: DataFrame, name: str = "nome_curso_cat", limit: int = d.RARE_LIMIT
) -> DataFrame:
    """Attach the pooled course name and its risk group.

    Names are counted with a map-side combine. The counts are checkpointed, so
    that their number is known before the join: while it is small they are
    broadcast and the rows are not shuffled by name, of which a few may hold
    most rows. The risk group is computed once per name.
    """
    pooled = F.when(F.col("count") < limit, d.RARE_NAME).otherwise(F.col(name))
    names = course_counts(df, name).select(name, pooled.alias("novo_curso"))
    names = names.withColumn("novo_curso2", course_group(F.col("novo_curso")))
    shared_folder(df.sparkSession)
    counted = broadcast_if_small(names.checkpoint(), NAME_LIMIT)
    return left_join_null_safe(df, counted, {name: name})


def remove_outliers(df: DataFrame, income_limit: float = 20000) -> DataFrame:
    """Keep incomes up to the limit and ages over 15 up to 80."""
    return df.filter(
        (F.col("RendaFamiliarMensalBruta") <= income_limit)
        & (F.col("RendaPessoalMensalBruta") <= income_limit)
        & (F.col("idade") > 15)
        & (F.col("idade") <= 80)
    )


def _steps(value: Column, cuts: list[tuple[float, str]], above: str) -> Column:
    """Letter of the first cut that is not below `value`; null stays null."""
    chain = None
    for limit, letter in cuts:
        within = value <= limit
        chain = F.when(within, letter) if chain is None else chain.when(within, letter)
    return propagate_null(value, chain.otherwise(above))


def _either(value: Column, test: Column, yes: str, no: str) -> Column:
    return propagate_null(value, F.when(test, yes).otherwise(no))


def bucket_columns() -> dict[str, Column]:
    """The sixteen bucket columns. An unknown input gives an unknown bucket,
    except where the rule itself asks for membership or for missing values."""
    c = F.col
    semesters = c("QtdeSemestreContratado")
    sponsor_income = c("ValorRendaComprovadaFiadores")
    guarantee = c("TipoGarantia")
    region = c("Regiao_UF")
    code = c("CodCurso")
    return {
        "qtdsemestre_cat": _either(semesters, semesters.between(0, 9), "a", "b"),
        "rendafamiliarmensalbruta_cat": _steps(
            c("RendaFamiliarMensalBruta"), [(1000, "a"), (2000, "b")], "c"
        ),
        "rendapessoalmensalbruta_cat": _steps(
            c("RendaPessoalMensalBruta"), [(2000, "a"), (3000, "b")], "c"
        ),
        "valorfinaciados_cat": _steps(c("ValorFinanciadoSISFIES"), [(80000, "a")], "b"),
        "valorrendafiadoress_cat": F.coalesce(
            _steps(sponsor_income, [(1500, "b"), (2500, "c")], "d"), F.lit("a")
        ),
        "idade_cat": _steps(c("idade"), [(20, "b")], "a"),
        "taxadejuros_cat": _either(c("TaxaDeJuros"), c("TaxaDeJuros") == 650, "b", "a"),
        "garantia_cat": propagate_null(
            guarantee,
            F.when(guarantee.isin(*d.GUARANTEE_D), "d")
            .when(guarantee.isin(*d.GUARANTEE_B), "b")
            .when(guarantee.isin(*d.GUARANTEE_C), "c")
            .otherwise("a"),
        ),
        "turno_cat": F.when(c("NomeTurno") == "INTEGRAL", "b").otherwise("a"),
        "ufies_cat": propagate_null(
            region, F.when(region == "Sul", "c").when(region == "Norte", "a").otherwise("b")
        ),
        "estadocivil_cat": _either(
            c("EstadoCivil"), c("EstadoCivil") == "Solteiro", "b", "a"
        ),
        "curso_cat": F.when(code.isin("5", "6"), "c").when(code.isin("4", "7"), "b").otherwise("a"),
        "percentual_cat": _either(
            c("PercentualFinanciado"), c("PercentualFinanciado") == 10000, "a", "b"
        ),
        "porte_cat": _either(c("Porte"), c("Porte") == "GM", "GM", "PMM"),
        "escola_cat": _either(
            c("CursouEnsinoMedioEscolaPublica"),
            c("CursouEnsinoMedioEscolaPublica") == "N",
            "b",
            "a",
        ),
        # The source pads the letter with blanks; they are ignored here.
        "deficiente_cat": _either(
            c("Deficiente"), F.rtrim(c("Deficiente")) == "N", "a", "b"
        ),
    }


def add_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns(bucket_columns())


def derive(portfolio: DataFrame) -> DataFrame:
    """Age at signing, response and region of the institution."""
    return portfolio.withColumns(
        {
            "idade": age_years(F.col("DtNascimento"), F.col("DtAssinaturaContratoAF")),
            "resposta": default_flag(F.col("DiasAtraso")),
            "Regiao_UF": region_of_state(F.col("UfIES")),
        }
    )
