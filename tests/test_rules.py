"""Hand-written rows for the rules that differ from Spark's defaults."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelio.functions import dates, nulls, numbers, text
from parcelio.operators import balances, columns, digest, features, geo, lifecycle


def one(df, column="v"):
    return [r[column] for r in df.select(column).collect()]


def values(spark, rows, kind):
    return spark.createDataFrame([(r,) for r in rows], f"x {kind}")


def test_null_goes_through_a_rule(spark):
    df = values(spark, [400, 100, 365, None], "int")
    assert one(df.select(features.default_flag(F.col("x")).alias("v"))) == [1, 0, 0, None]


def test_strict_sum_and_mean(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double"
    )
    rows = df.groupBy("k").agg(
        nulls.sum_strict(F.col("x")).alias("s"), nulls.mean_strict(F.col("x")).alias("m")
    )
    assert {r.k: (r.s, r.m) for r in rows.collect()} == {"a": (None, None), "b": (6.0, 3.0)}


def test_null_key_matches_null_key(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "code string, y int")
    joined = nulls.left_join_null_safe(left, right, {"k": "code"})
    assert joined.columns == ["k", "x", "y"]
    assert {(r.x, r.y) for r in joined.collect()} == {(1, 10), (2, 20), (3, None)}


def test_broadcast_only_below_the_limit(spark):
    table = spark.range(10)
    assert "broadcast" in nulls.broadcast_if_small(table, 10)._jdf.queryExecution().toString()
    assert "broadcast" not in nulls.broadcast_if_small(table, 9)._jdf.queryExecution().toString()


def test_fill_leaves_dates(spark):
    df = spark.createDataFrame([(None, None, None)], "d date, x double, t string")
    assert nulls.fill_missing(df, 0, "", ["t"]).first() == (None, 0.0, "")


def test_padding_keeps_long_text(spark):
    df = values(spark, ["7", "123456789012345", None], "string")
    padded = one(df.select(text.pad_left(F.col("x"), 14).alias("v")))
    assert padded == ["0" * 13 + "7", "123456789012345", None]


def test_round_half_to_even(spark):
    df = values(spark, [0.5, 1.5, 2.5, -0.5, 2.4999, None], "double")
    rounded = one(df.select(numbers.round_half_even(F.col("x")).alias("v")))
    assert rounded == [0.0, 2.0, 2.0, 0.0, 2.0, None]


def test_division_by_zero_and_clamp(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-3.0, 2.0), (None, 2.0)], "a double, b double")
    v = numbers.clamp_negative(numbers.divide_or_null(F.col("a"), F.col("b")))
    assert one(df.select(v.alias("v"))) == [None, 0.0, None]


def test_rescale_censors(spark):
    df = values(spark, [3299.0, 3300.0, 3525.0, 3750.0, 3751.0], "double")
    v = numbers.rescale_censored(F.col("x"), geo.SCALE_LOW, geo.SCALE_HIGH)
    assert one(df.select(v.alias("v"))) == [None, 0.0, 0.5, 1.0, None]


def test_half_years(spark):
    df = values(spark, [date(2018, 1, 5), date(2017, 7, 1), date(2018, 7, 1)], "date")
    as_of = F.lit(date(2018, 8, 1))
    rows = df.select(
        dates.half_years_elapsed(F.col("x"), as_of).alias("a"),
        dates.half_years_elapsed_calendar(F.col("x"), as_of).alias("b"),
        dates.half_year_floor(F.col("x")).alias("f"),
    ).collect()
    assert [r.a for r in rows] == [1, 3, 1]
    assert [r.b for r in rows] == [2, 3, 1]
    assert [r.f for r in rows] == [date(2018, 1, 1), date(2017, 7, 1), date(2018, 7, 1)]


def test_semester_starts():
    starts = dates.semester_starts(date(2018, 1, 1), date(2030, 7, 1))
    assert len(starts) == 26
    assert starts[:2] == [date(2018, 1, 1), date(2018, 7, 1)] and starts[-1] == date(2030, 7, 1)


def test_dates_and_text(spark):
    df = values(spark, ["31/12/2017", "31/02/2018", "x", None], "string")
    parsed = one(df.select(dates.parse_day_first(F.col("x")).alias("v")))
    assert parsed == [date(2017, 12, 31), None, None, None]
    df = values(spark, [date(2018, 12, 1)], "date")
    assert one(df.select(dates.long_date(F.col("x")).alias("v"))) == ["01 December 2018"]
    df = values(spark, ["about 9 results."], "string")
    assert one(df.select(text.character_from_end(F.col("x")).alias("v"))) == ["s"]
    assert one(df.select(text.slice_text(F.col("x"), 7, 9).alias("v"))) == ["9 r"]
    assert one(df.select(text.glue("a", F.lit(None), "b").alias("v"))) == ["ab"]


def test_latin1(spark):
    df = values(spark, ["ação", "a—b", None], "string")
    encoded = one(df.select(text.latin1_bytes(F.col("x")).alias("v")))
    assert encoded[0] == "ação".encode("latin-1")
    assert encoded[1:] == [None, None]


def test_membership_rules(spark):
    df = values(spark, ["RS", "AC", "SP", None], "string")
    v = features.region_of_state(F.col("x")).alias("v")
    assert one(df.select(v)) == ["Sul", "Norte", "Sudeste", "Sudeste"]
    df = values(spark, ["ESTÉTICA E COSMETOLOGIA", "DIREITO", None], "string")
    v = features.canonical_course(F.col("x")).alias("v")
    assert one(df.select(v)) == ["ESTÉTICA", "DIREITO", None]
    df = values(spark, ["ENGENHARIA DE TELECOMUNICAÇÕES", "OUTROS", "NENHUM", None], "string")
    v = features.course_group(F.col("x")).alias("v")
    assert one(df.select(v)) == ["grupoa", "grupog", "grupom", "grupom"]


def test_group_sizes():
    from parcelio.operators.dictionaries import COURSE_ALIASES, COURSE_GROUPS

    sizes = [len(v) for v in COURSE_GROUPS.values()]
    assert sizes == [5, 7, 21, 11, 10, 15, 12, 21, 8, 7, 9]
    assert sum(map(len, COURSE_ALIASES.values())) == 16
    names = [n for v in COURSE_GROUPS.values() for n in v]
    assert len(names) == len(set(names)) == 126


def test_buckets_of_missing_values(spark):
    schema = (
        "QtdeSemestreContratado double, RendaFamiliarMensalBruta double, "
        "RendaPessoalMensalBruta double, ValorFinanciadoSISFIES double, "
        "ValorRendaComprovadaFiadores double, idade double, TaxaDeJuros double, "
        "TipoGarantia string, NomeTurno string, Regiao_UF string, EstadoCivil string, "
        "CodCurso string, PercentualFinanciado double, Porte string, "
        "CursouEnsinoMedioEscolaPublica string, Deficiente string"
    )
    empty = (None,) * 16
    edge = (
        9.0, 1000.0, 3000.0, 80000.0, 2500.0, 20.0, 650.0, "SEM FIANÇA", "INTEGRAL", "Norte",
        "Solteiro", "7", 10000.0, "GM", "N", "N         ",
    )
    rows = features.add_buckets(spark.createDataFrame([empty, edge], schema)).collect()
    kept = {k: v for k, v in rows[0].asDict().items() if k.endswith("_cat") and v is not None}
    assert kept == {"valorrendafiadoress_cat": "a", "turno_cat": "a", "curso_cat": "a"}
    names = list(features.bucket_columns())
    assert [rows[1][n] for n in names] == [
        "a", "a", "b", "a", "c", "b", "b", "c", "b", "a", "b", "b", "a", "GM", "b", "a",
    ]


def test_rare_names_are_pooled(spark):
    rows = [("DIREITO",)] * 4 + [("MODA",)] * 2 + [(None,)] * 3
    pooled = features.pool_rare(spark.createDataFrame(rows, "nome_curso_cat string"), limit=3)
    got = {(r.nome_curso_cat, r.novo_curso, r.novo_curso2) for r in pooled.collect()}
    assert pooled.count() == 9
    assert got == {
        ("DIREITO", "DIREITO", "grupof"), ("MODA", "OUTROS", "grupog"), (None, None, "grupom"),
    }


def test_hot_name_is_not_shuffled(spark):
    hot = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "DIREITO").otherwise(F.col("id").cast("string")).alias(
            "nome_curso_cat"
        )
    )
    pooled = features.pool_rare(hot)
    assert "Exchange hashpartitioning" not in pooled._jdf.queryExecution().executedPlan().toString()
    groups = {r.novo_curso: r["count"] for r in pooled.groupBy("novo_curso").count().collect()}
    assert groups == {"DIREITO": 3000, "OUTROS": 6000}


def test_positional_rename_checks_the_number(spark):
    with pytest.raises(ValueError):
        columns.rename_positional(spark.range(1).withColumn("b", F.lit(1)), ["a"])


def test_optional_filter(spark):
    df = values(spark, ["PE", "AC"], "string")
    assert columns.filter_unless_all(df, "x", "Todos").count() == 2
    assert columns.filter_unless_all(df, "x", None).count() == 2
    assert columns.filter_unless_all(df, "x", "AC").count() == 1


def test_batch_cast_gives_null_for_bad_text(spark):
    df = values(spark, ["1.5", "x", None], "string")
    assert one(columns.batch_cast(df, ["x"], "double"), "x") == [1.5, None, None]


BALANCE_SCHEMA = (
    "SG_UF string, ME_REFERENCIA date, DS_PROGRAMA string, VL_SALDO_CONTA double, "
    "VL_SALDO_FUNDOS double, VL_SALDO_POUPANCA double, VL_SALDO_RDB double"
)


def balance_rows(spark):
    jan, feb, apr = date(2018, 1, 1), date(2018, 2, 1), date(2018, 4, 1)
    return spark.createDataFrame(
        [
            ("PE", jan, "p", 1.0, 1.0, 1.0, 1.0),
            ("PE", feb, "p", 2.0, 2.0, 2.0, 2.0),
            ("PE", apr, "q", 3.0, 4.0, 5.0, None),
            ("AC", jan, "p", 1.0, 2.0, 3.0, 4.0),
        ],
        BALANCE_SCHEMA,
    )


def test_latest_month_is_per_state(spark):
    rows = balances.latest_state_balance(balance_rows(spark)).collect()
    assert {(r.code, r.value) for r in rows} == {("PE", None), ("AC", 10.0)}


def test_series_has_every_month(spark):
    series = balances.monthly_series(
        balance_rows(spark), date(2018, 1, 1), date(2018, 4, 1), "PE"
    )
    rows = sorted((r.ME_REFERENCIA.month, r.total_saldo) for r in series.collect())
    assert rows == [(1, 1.0), (2, 2.0), (3, None), (4, 4.0)]


def test_duplicate_names(spark):
    df = values(spark, ["a", "b", "a"], "string")
    assert [(r.x, r["count"]) for r in lifecycle.duplicate_keys(df, "x").collect()] == [("a", 2)]


def test_search_and_digest(spark):
    pages = spark.createDataFrame(
        [
            (1, "Sobre o PROJOVEM e mais", "A", "s1", "l1"),
            (2, "projovem", "B", "s2", "l2"),
            (3, "nada", "C", "s3", "l3"),
        ],
        "id int, text string, title string, summary string, href string",
    )
    words = ["Projovem", "ausente"]
    counts = digest.keyword_counts(pages, "text", words).collect()
    assert {(r.keyword, r.n_results) for r in counts} == {("Projovem", 2), ("ausente", 0)}
    found = digest.first_results(digest.matches(pages, "text", words), [F.col("id")], 1)
    blocks = digest.keyword_digest(found, words).orderBy("keyword_order").collect()
    assert blocks[0].header == digest.INTRODUCTION + "\n"
    assert blocks[0].body == "\nProjovem - A\n\n* l1\n"
    assert blocks[1].body == f"\nausente - {digest.NOTHING_FOUND}\n"
    day = F.lit(date(2018, 12, 1))
    body = digest.single_digest(found, "x", day).first().body
    assert body.endswith("\n\n *A\n\ns1\n\nLink - l1")
    empty = digest.single_digest(found.limit(0), "x", day).collect()
    assert [r.body for r in empty] == [
        f"Diário Oficial da União - 01 December 2018\n\n{digest.NOTHING_FOUND}: x."
    ]


def test_map_without_value(spark):
    regions = spark.createDataFrame([(1, 2), (9, 1)], "City bigint, Region int")
    data = spark.createDataFrame([(1, 5.0, 6.0)], "code bigint, a double, b double")
    rows = geo.choropleth(regions, data, {"City": "code"}, ["a", "b"]).collect()
    assert {(r.City, r.measure, r.value) for r in rows} == {
        (1, "a", 5.0), (1, "b", 6.0), (9, "a", None), (9, "b", None),
    }
