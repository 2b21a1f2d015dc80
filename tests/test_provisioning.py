"""Regimes, life-cycle and the recurrence, against plain arithmetic."""

import random
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelio.operators import lifecycle, projection
from parcelio.operators.projection import LABEL_DONE, LABEL_GRACE, LABEL_REPAY, LABEL_USE
from parcelio.plans import catalog, provisioning, views

SCHEMA = (
    "cpf string, dt_assinatura_contrato date, fase string, tx_juros double, "
    "qtd_sem_contratado double, qtd_sem_dilatado double, qtd_sem_cursado double, "
    "valor_divida double, valor_liberado double"
)


def contract(cpf, day, phase="utilizacao", rate=3.4, agreed=4.0, done=2.0, debt=1000.0):
    return (cpf, day, phase, rate, agreed, 0.0, done, debt, debt / 2)


def contracts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_regime_edges(spark):
    days = {
        date(2009, 12, 31): "III", date(2010, 1, 1): "I", date(2013, 1, 31): "I",
        date(2013, 2, 1): "II", date(2015, 1, 31): "II", date(2015, 2, 1): "III",
        date(2017, 12, 31): "III", date(2020, 1, 1): "III", None: None,
    }
    rows = [contract(str(i), day) for i, day in enumerate(days)]
    assigned = lifecycle.assign_regime(contracts(spark, *rows), views.regimes(spark))
    got = {r.dt_assinatura_contrato: (r.tipo_regencia, r.percent_garantia)
           for r in assigned.collect()}
    share = {"I": 80, "II": 90, "III": 90, None: None}
    assert got == {day: (name, share[name]) for day, name in days.items()}


def test_conditions_and_join_agree(spark, sf_dir):
    rows = views.contracts(spark, sf_dir).unionByName(
        contracts(spark, contract("0", None)).withColumn("cpf", F.col("cpf").cast("bigint"))
    )
    regimes = views.regimes(spark)
    by_condition = lifecycle.assign_regime(rows, regimes)
    by_join = lifecycle.join_regimes(rows, regimes)
    assert by_condition.dtypes == by_join.dtypes
    assert by_condition.exceptAll(by_join).count() == 0
    assert by_join.count() == rows.count()


def test_lifecycle_dates(spark):
    rows = contracts(spark, contract("a", date(2012, 9, 15)))
    r = provisioning.contract_terms(rows, views.regimes(spark)).first()
    assert (r.duracao_utilizacao, r.duracao_amortizacao) == (4.0, 14.0)
    assert r.in_utilizacao == date(2012, 7, 1) and r.fim_utilizacao == date(2014, 1, 1)
    assert r.in_carencia == date(2014, 7, 1) and r.fim_carencia == date(2015, 7, 1)
    assert r.in_amortizacao == date(2016, 1, 1) and r.fim_amortizacao == date(2022, 7, 1)
    assert (r.vlr_semestre, r.divida_total, r.vlr_abatimento) == (500.0, 2000.0, 143.0)
    assert r.bad_terms is False


def test_no_completed_semesters(spark):
    rows = contracts(
        spark,
        contract("a", date(2012, 9, 15), done=0.0),
        contract("b", date(2016, 1, 1), phase="carencia", done=None),
    )
    for r in provisioning.contract_terms(rows, views.regimes(spark)).collect():
        assert r.vlr_semestre is None and r.bad_terms is True


def walk(seed, growth, draw, cut, score, phases):
    """The recurrence for one contract, semester by semester."""
    one, two, four = [seed], [seed], [seed]
    for phase in phases[1:]:
        grown = one[-1] * growth
        if phase == LABEL_USE:
            new = (grown + draw, two[-1] * growth + draw, grown + draw)
        elif phase == LABEL_GRACE:
            new = (grown, two[-1] * growth, grown)
        elif score > 0.3:
            new = (grown, two[-1] * growth, four[-1] * growth - cut * growth * (1 - score))
        else:
            new = (
                grown - cut * growth,
                two[-1] * growth - cut * growth * (1 - score),
                four[-1] * growth - cut * growth * (1 - score),
            )
        for series, value in zip((one, two, four), new):
            series.append(value)
    return one, two, four


def test_recurrence_matches_a_walk(spark):
    days = [date(2010, 3, 1), date(2014, 8, 1), date(2016, 5, 1), date(2017, 12, 1),
            date(2019, 8, 1), date(2026, 1, 1)]
    rows = [
        contract(f"{i}-{s}", day, rate=6.5 if i % 2 else 3.4, debt=9876.5 + i)
        for i, day in enumerate(days) for s in (10, 30, 31, 90)
    ]
    scores = spark.createDataFrame(
        [(r[0], int(r[0].split("-")[1]) / 100) for r in rows], "cpf string, score double"
    )
    terms = lifecycle.attach_scores(
        provisioning.contract_terms(contracts(spark, *rows), views.regimes(spark)), scores
    )
    given = {r.cpf: r for r in terms.collect()}
    debts = projection.debt_columns(
        projection.project_debt(terms, provisioning.CARRIED, variant_four=True)
    )
    found = {}
    for r in debts.collect():
        found.setdefault(r.cpf, []).append(r)
    assert len(found) == len(rows)
    for cpf, got in found.items():
        got.sort(key=lambda r: r.cmpt)
        c = given[cpf]
        assert len(got) == 26
        series = walk(c.valor_divida, 1 + c.tx_juros / 200, c.vlr_semestre, c.vlr_abatimento,
                      c.score, [r.fase for r in got])
        settled = [[float(round(max(v, 0.0))) for v in s] for s in series]
        assert [r.valor_divida for r in got] == settled[0]
        assert [r.valor_divida_II for r in got] == settled[1]
        assert [r.valor_divida_IV for r in got] == settled[2]
        assert [r.valor_divida_III_anterior for r in got] == [None, *settled[1][:-1]]
        counter = {}
        for position, r in enumerate(got, start=1):
            counter[r.fase] = counter.get(r.fase, 0) + 1
            assert (r.id_cpf, r.id_fase) == (position, counter[r.fase])


def test_long_horizon_matches_a_walk(spark):
    """120 semesters, with rates from zero on; the plan has as many nodes as for two."""
    rng = random.Random(8)
    rows = [
        contract(
            str(i), date(rng.randint(2010, 2017), rng.randint(1, 12), 5),
            rate=rng.choice([0.0, 0.5, 3.4, 6.5]), debt=rng.uniform(0, 50_000),
            done=float(rng.choice([1, 3, 9])),
        )
        for i in range(60)
    ] + [contract("long", date(2017, 6, 1), agreed=28.0)]
    terms = provisioning.contract_terms(contracts(spark, *rows), views.regimes(spark))
    terms = terms.withColumn("score", F.lit(0.2))
    end = date(2077, 7, 1)
    long = projection.project_debt(terms, provisioning.CARRIED, end=end, variant_four=True)
    given = {r.cpf: r for r in terms.collect()}
    found = {}
    for r in projection.debt_columns(long).collect():
        found.setdefault(r.cpf, []).append(r)
    for cpf, got in found.items():
        got.sort(key=lambda r: r.cmpt)
        c = given[cpf]
        series = walk(c.valor_divida, 1 + c.tx_juros / 200, c.vlr_semestre, c.vlr_abatimento,
                      c.score, [r.fase for r in got])
        for name, values in zip(("valor_divida", "valor_divida_II", "valor_divida_IV"), series):
            for r, v in zip(got, values):
                assert abs(r[name] - max(v, 0.0)) <= 0.5 + 1e-6 * abs(v)
    assert max(len(g) for g in found.values()) > 50

    def nodes(last):
        plan = projection.project_debt(terms, ["cpf"], end=last)._jdf.queryExecution()
        return len(plan.optimizedPlan().toString())

    assert abs(nodes(end) - nodes(date(2018, 7, 1))) < 200


def test_debts_equal_the_recurrence_on_all_rows(spark, sf_dir):
    """Semester after semester by a running product of the steps, for every contract of the tables."""
    terms = lifecycle.attach_scores(catalog._terms(spark, sf_dir), views.scores(spark, sf_dir))
    debts = projection.debt_columns(projection.project_debt(terms, provisioning.CARRIED))
    amounts = terms.select(
        F.col("cpf").alias("key"), "valor_divida", "vlr_semestre", "vlr_abatimento"
    ).withColumnRenamed("valor_divida", "opening")
    series = (
        debts.join(amounts, F.col("cpf") == F.col("key")).groupBy("cpf")
        .agg(
            F.array_sort(F.collect_list(F.struct("cmpt", "fase", "valor_divida", "valor_divida_II"))).alias("rows"),
            *[F.first(c).alias(c) for c in ("opening", "vlr_semestre", "vlr_abatimento", "tx_juros", "score")],
        )
    )
    checked = 0
    for r in series.collect():
        expected = walk(r.opening, 1 + r.tx_juros / 200, r.vlr_semestre, r.vlr_abatimento, r.score, [x.fase for x in r.rows])
        for name, values in zip(("valor_divida", "valor_divida_II"), expected):
            assert [x[name] for x in r.rows] == [float(round(max(v, 0.0))) for v in values]
            checked += len(values)
    assert checked == 2 * debts.count()


def test_phase_labels_of_both_forms_agree(spark, sf_dir):
    terms = lifecycle.attach_scores(
        catalog._terms(spark, sf_dir), views.scores(spark, sf_dir)
    )
    debts = projection.project_debt(terms, ["cpf"]).select("cpf", "cmpt", "fase", "id_fase")
    rows = projection.with_semester_index(catalog._labelled(spark, sf_dir)).select(
        "cpf", "cmpt", "fase", "id_fase"
    )
    assert debts.exceptAll(rows).count() == 0
    assert rows.exceptAll(debts).count() == 0


def test_last_repayment_semester_is_finished(spark):
    rows = contracts(spark, contract("a", date(2012, 9, 15)))
    terms = lifecycle.attach_scores(
        provisioning.contract_terms(rows, views.regimes(spark)),
        spark.createDataFrame([], "cpf string, score double"),
    )
    got = projection.project_debt(terms, ["cpf", "score"]).collect()
    assert {r.score for r in got} == {0.5}
    # The grid ends with the last repayment semester of the whole portfolio.
    assert max(r.cmpt for r in got) == date(2022, 7, 1)
    labels = {r.cmpt: r.fase for r in got}
    assert labels[date(2022, 1, 1)] == LABEL_REPAY
    assert labels[date(2022, 7, 1)] == LABEL_DONE


def test_late_portfolio_is_refused(spark):
    rows = contracts(spark, contract("a", date(2019, 9, 15)))
    terms = provisioning.contract_terms(rows, views.regimes(spark)).withColumn(
        "score", F.lit(0.5)
    )
    with pytest.raises(PySparkException, match="first contract starts after"):
        projection.project_debt(terms, ["cpf"]).collect()


def test_missing_date_and_amount(spark):
    rows = contracts(
        spark,
        contract("old", date(2012, 1, 1)),
        contract("undated", None),
        contract("bad", date(2012, 1, 1), done=0.0),
    )
    terms = provisioning.contract_terms(rows, views.regimes(spark)).withColumn(
        "score", F.lit(0.1)
    )
    got = projection.debt_columns(projection.project_debt(terms, ["cpf"])).collect()
    assert {r.fase for r in got if r.cpf == "undated"} == {""}
    first = [r.valor_divida for r in got if r.cpf == "bad" and r.id_cpf == 1]
    later = {r.valor_divida for r in got if r.cpf == "bad" and r.id_cpf > 1}
    assert first == [1000.0] and later == {None}


@pytest.fixture(scope="module")
def totals(spark, sf_dir):
    return sorted(catalog.provision_all(spark, sf_dir).collect(), key=lambda r: r.cmpt)


def test_scenario_properties(totals):
    assert len(totals) == 26
    assert totals[0].cmpt == "2018-01-01" and totals[-1].cmpt == "2030-07-01"
    assert len({r.qtd_contratos for r in totals}) == 1
    assert len({r.qtd_contratos_cen1 for r in totals}) == 1
    assert totals[0].tot_prov_cen3 == totals[0].tot_prov_cen2
    for r in totals:
        assert r.tot_prov_cen2 >= r.tot_prov_cen1
        assert r.tot_prov_cen4 <= r.tot_prov_cen2
        assert r.tot_prov_cen3 >= r.tot_prov_cen2


def test_published_fixture_totals(spark):
    rows = {r.cmpt: r for r in catalog.provision_all(spark, "/root/testdata/sf0.01").collect()}
    first, last = rows["2018-01-01"], rows["2030-07-01"]
    assert (first.qtd_contratos, first.qtd_contratos_cen1) == (15000, 11423)
    expected = {
        first: (1031708036.70, 1080875009.37, 1080875009.37, 675679611.04),
        last: (1731501257.50, 1765278986.76, 2835734802.12, 1096047028.72),
    }
    for row, amounts in expected.items():
        got = [row[f"tot_prov_cen{s}"] for s in (1, 2, 3, 4)]
        assert got == pytest.approx(amounts, abs=0.006)


def test_no_shuffle_of_the_projection(spark, sf_dir):
    plan = catalog.provision_all(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
