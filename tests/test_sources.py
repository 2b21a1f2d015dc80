"""File formats and database options."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelio.operators import digest
from parcelio.operators.dictionaries import MODEL_PHASES
from parcelio.session import new_shared_path, shared_folder
from parcelio.sources import database, delimited, sinks, tables


def write(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(content, encoding=encoding)
    return str(path)


def test_decimal_comma_needs_decimals(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id;v;t\n 007 ;2950870153,9;x\n8;1.234,5;\n9;NA;NA\n')
    df = delimited.read_semicolon(spark, path, "id string, v decimal(20,4), t string")
    rows = df.collect()
    assert [r.id for r in rows] == ["007", "8", "9"]
    assert [r.v for r in rows] == [Decimal("2950870153.9000"), Decimal("1234.5000"), None]
    assert [r.t for r in rows] == ["x", "", None]
    assert delimited.decimals_to_double(df).dtypes[1] == ("v", "double")


def test_regimes(spark, tmp_path):
    content = (
        "inicio;fim;tipo_regencia;tx_juros;carencia;amortizacao;pgto_juros;share\n"
        "01/01/2010;31/01/2013;I;3.4;3;(3*qtd_sem_contratado)+2;100;80\n"
        "01/02/2015;31/12/2017;III;6.5;3;3*qtd_sem_contratado;300;90\n"
    )
    rows = delimited.read_regimes(spark, write(tmp_path, "r.csv", content)).collect()
    assert rows[0].inicio == date(2010, 1, 1) and rows[0].fim == date(2013, 1, 31)
    assert (rows[1].tipo_regencia, rows[1].tx_juros, rows[1].percent_garantia) == ("III", 6.5, 90)


def test_latin1(spark, tmp_path):
    path = write(tmp_path, "l.csv", "nome;v\nEducação;1,5\n", "latin-1")
    row = delimited.read_semicolon_latin1(spark, path, "nome string, v decimal(9,2)").first()
    assert (row.nome, row.v) == ("Educação", Decimal("1.50"))
    path = write(tmp_path, "m.csv", "Nome,Codigo\nSão Luís,2111300\n", "latin-1")
    row = delimited.read_comma_latin1(spark, path, "Nome string, Codigo bigint").first()
    assert tuple(row) == ("São Luís", 2111300)


def test_index_column_is_dropped(spark, tmp_path):
    path = write(tmp_path, "i.csv", ",cpf,v\n1,001,2.5\n2,002,NA\n")
    df = delimited.read_comma_drop_index(spark, path, "X1 int, cpf string, v double")
    assert df.columns == ["cpf", "v"]
    assert [tuple(r) for r in df.collect()] == [("001", 2.5), ("002", None)]


def test_comma_number(spark):
    df = spark.createDataFrame(
        [(2950870153.9,), (3857635314.88344,), (100.0,), (0.0,), (None,)], "v double"
    )
    got = [r.t for r in df.select(sinks.comma_number(F.col("v")).alias("t")).collect()]
    assert got == ["2950870153,9", "3857635314,88344", "100", "0", None]


def test_scenario_file(spark, tmp_path):
    totals = spark.createDataFrame(
        [(date(2018, 7, 1), 7, 20.25), (date(2018, 1, 1), 7, 10.5)],
        "cmpt date, qtd_contratos bigint, tot_prov_cen1 double",
    )
    path = str(tmp_path / "out")
    sinks.write_scenario(totals, "tot_prov_cen1", path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == [
        '"";"cmpt";"qtd_contratos";"tot_prov_cen1"',
        '"1";2018-01-01;7;10,5',
        '"2";2018-07-01;7;20,25',
    ]
    back = delimited.read_semicolon(
        spark, path, "i string, cmpt date, n bigint, total decimal(20,5)"
    )
    assert [r.total for r in back.collect()] == [Decimal("10.50000"), Decimal("20.25000")]


def test_digest_file(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "fies aqui", "T", "S", "L")],
        "id int, text string, title string, summary string, href string",
    )
    found = digest.first_results(
        digest.matches(pages, "text", [digest.SINGLE_WORD]), [F.col("id")], 9
    )
    body = digest.single_digest(found, digest.SINGLE_WORD, F.lit(date(2018, 12, 3)))
    path = str(tmp_path / "digest")
    sinks.write_digest(body, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "Diário Oficial da União - 03 December 2018"
    assert lines[-1] == "Link - L"


def test_round_trip_keeps_empty_text(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "x")]
    path = str(tmp_path / "rt")
    sinks.write_semicolon(spark.createDataFrame(rows, "id bigint, t string"), path)
    back = delimited.read_semicolon(spark, path, "id bigint, t string").orderBy("id")
    assert [tuple(r) for r in back.collect()] == rows


def test_polygon_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "polygons")
    spark.createDataFrame([(1, 2), (2, 5)], "City bigint, Region int").write.parquet(path)
    chosen = tables.read_polygons(spark, path, [1, 2])
    assert [r.City for r in chosen.collect()] == [1]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "In(Region, [1,2])" in plan


def test_database_options():
    assert database.parallel_options("id", 0, 100, 4) == {
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4",
        "fetchsize": "10000",
    }


def test_phase_filter(spark):
    rows = [("amortizacao", 1), ("liquidado", None), ("liquidado", 2), ("utilizacao", 3)]
    df = spark.createDataFrame(rows, "FaseSISFIES string, DiasAtraso int")
    assert MODEL_PHASES == ("amortizacao", "liquidado")
    assert [r.DiasAtraso for r in database.filter_phases(df).collect()] == [1, 2]


def test_extract_needs_every_table(spark):
    with pytest.raises(ValueError):
        database.read_extract_tables(spark, {"balances": "b"}, {})


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert new_shared_path(spark, "x").startswith(named)
    assert new_shared_path(spark, "x") != new_shared_path(spark, "x")
