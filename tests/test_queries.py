"""Every query with a SQL equivalent gives the same values in both engines."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from parcelio.plans import catalog, oracles

QUERIES = catalog.QUERIES
ORACLES = oracles.ORACLES
MODEL_QUERIES = ("credit_model", "coef_table", "score_contracts")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    without = set(QUERIES) - set(ORACLES)
    assert without == {"credit_model", "coef_table", "stepwise_aic", "score_contracts"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_values(name, spark, sf_dir, duck):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_queries_give_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_scores_cover_every_row(spark, sf_dir):
    scored = QUERIES["score_contracts"](spark, sf_dir)
    assert scored.count() == catalog._model_table(spark, sf_dir).count()
    assert scored.filter("score IS NULL").count() > 0
    assert scored.filter("score < 0 OR score > 1").count() == 0


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[0] == "cmpt"
    assert result.count() == 26
