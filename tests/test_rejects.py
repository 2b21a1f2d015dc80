"""Rejected fields, fields of pages, and tables of keywords, on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from parcelio.operators import digest
from parcelio.sources import delimited

SCHEMA = "id bigint, nome string, dia date, valor decimal(12,2)"
LINES = [
    "id;nome;dia;valor",
    "1;ana;01/02/2020;1.234,56",
    "2;NA;NA;NA",
    "3;;;",
    "x4;bia;01/02/2020;1,5",
    "5;caio;31/02/2020;abc",
    "6;dora;01/02/2020",
    "7;edu;01/02/2020;1,5;mais",
    '8;"a;b";01/02/2020;-2,25',
    "9; fim ;01/02/2020; 3 ",
]


@pytest.fixture
def checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id;nome;dia;valor\n10;gil;2020-01-01;1,0\n", encoding="utf-8")
    return delimited.read_checked(spark, str(tmp_path), SCHEMA, date_format=delimited.DAY_FIRST)


def test_rejects_name_file_column_and_reason(checked):
    got = {(r.file.split("/")[-1], r.line, r.column, r.value, r.reason) for r in delimited.rejected(checked).collect()}
    assert got == {
        ("a.csv", LINES[4], "id", "x4", "not bigint"),
        ("a.csv", LINES[5], "dia", "31/02/2020", "not date"),
        ("a.csv", LINES[5], "valor", "abc", "not decimal(12,2)"),
        ("a.csv", LINES[6], None, None, "not 4 fields"),
        ("a.csv", LINES[7], None, None, "not 4 fields"),
        ("b.csv", "10;gil;2020-01-01;1,0", "dia", "2020-01-01", "not date"),
    }


def test_accepted_and_rejected_lines_are_all_lines(checked):
    good = {r.id: (r.nome, str(r.dia), r.valor and float(r.valor)) for r in delimited.accepted(checked).collect()}
    assert good == {
        1: ("ana", "2020-02-01", 1234.56), 2: (None, "None", None), 3: ("", "None", None),
        8: ("a;b", "2020-02-01", -2.25), 9: ("fim", "2020-02-01", 3.0),
    }
    assert len(good) + delimited.rejected(checked).select("line").distinct().count() == checked.count() == 10
    # A query of some columns finds the same faults.
    assert delimited.accepted(checked).select("nome").count() == 5
    assert delimited.accepted(checked).agg(F.count("*")).first()[0] == 5


def test_faults_do_not_hide_in_texts_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2\n3\n", encoding="utf-8")
    checked = delimited.read_checked(spark, str(tmp_path / "t.csv"), "a string, b string")
    assert delimited.accepted(checked).count() == 1
    assert [r.reason for r in delimited.rejected(checked).collect()] == ["not 2 fields"]


PAGES = [
    ("<title>Plain</title><p>One.</p>", "Plain", "One."),
    ('<TITLE lang="pt" data-x="a>b">Di&aacute;rio &#8211; &#x41;&amp;lt;</TITLE><pre>no</pre><p class=\'x>y\'>Uma <b>forte <i>frase</i></b> aqui.</p>', "Diário – A&lt;", "Uma forte frase aqui."),
    ("<!-- <title>no</title><p>no</p> --><title>Yes</title><p>a<!-- hidden -->b</p>", "Yes", "ab"),
    ("<title>t</title><script>var p='<p>no</p>';</script><style>p{}</style><p>real</p>", "t", "real"),
    ("<title>t</title><p>first<p>second</p>", "t", "first"),
    ("<title>t</title><p>first<br>line<br/>two<div>block</div></p>", "t", "first line two"),
    ("<p>open to the end &nbsp;&bogus; &amp", "", "open to the end  &bogus; &amp"),
    ("<param><picture><p\n id=1>x</p>", "", "x"),
    ("no tags &lt;p&gt;", "", ""),
    ("<title></title><p></p><p>later</p>", "", ""),
    ("<title>&#0;&#55296;&#1114112;&#128512;</title>", "���😀", ""),
    ("<!-- never closed <p>no</p>", "", ""),
    ("", "", ""),
    (None, None, None),
]


def test_page_fields(spark):
    rows = spark.createDataFrame([(i, html, f"u{i}") for i, (html, *_) in enumerate(PAGES)], "i int, html string, url string")
    got = {r.i: (r.title, r.summary) for r in digest.page_fields(rows).collect()}
    assert got == {i: (title, summary) for i, (_, title, summary) in enumerate(PAGES)}


def test_page_fields_of_long_pages(spark):
    long = "<title " + "a='b' " * 50_000 + ">t</title><p>" + "<b>x</b> " * 100_000 + "&amp;" * 50_000 + "</p>" + "<!--" * 100_000
    row = digest.page_fields(spark.createDataFrame([(long, "u")], "html string, url string")).first()
    assert row.title == "t" and row.summary == "x " * 100_000 + "&" * 50_000


def test_table_of_keywords_against_contains(spark):
    rng = random.Random(7)
    letters = "abcdeé ß"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(900, None), (901, "")]
    texts += texts[:5]
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 7]))) for _ in range(200)]
    words += ["ABC", "É", "", None, "a" * 40, "zz", "%", "ab", "ab"]
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    docs = spark.createDataFrame(texts, "id int, text string")
    got = sorted((r.id, r.keyword) for r in digest.table_matches(docs, "text", table).collect())
    want = sorted((i, w) for i, t in texts for w in {w for w in words if w} if t is not None and w.lower() in t.lower())
    assert got == want and len(want) > 1000
    counts = {r.keyword: r.n_results for r in digest.table_counts(docs, "text", table.filter("keyword <> ''")).collect()}
    assert counts["zz"] == 0 and counts["ABC"] == sum(w == "ABC" for _, w in want) and len(counts) == len({w for w in words if w})
    assert digest.table_matches(docs, "text", table.limit(0)).count() == 0
    assert digest.table_matches(docs.limit(0), "text", table).count() == 0


def test_a_hundred_thousand_keywords(spark):
    words = spark.range(100_000).select(F.format_string("w%06dx", "id").alias("keyword"))
    docs = spark.range(400).select(F.col("id"), F.format_string("Some W%06dX and w%06dx words", "id", F.col("id") + 50_000).alias("text"))
    found = digest.table_matches(docs, "text", words)
    assert found.count() == 800
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_few_keywords_take_no_pieces_of_texts(spark, monkeypatch):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abcdÉ ß") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(0, "ab"), (1, None), (2, "")]
    words = ["".join(rng.choice("abcdé ß") for _ in range(rng.choice([1, 2, 3, 5]))) for _ in range(60)] + ["AB", "ab", None, ""]
    docs = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    few = digest.table_matches(docs, "text", table)
    assert few.columns == ["id", "text", "keyword"]
    assert "regexp_extract_all" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(digest, "TESTED_KEYWORDS", 0)
    many = digest.table_matches(docs, "text", table)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.count() > 200
