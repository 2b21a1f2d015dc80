"""Named queries over the test tables, one per operator of the library.

Every query reads whole tables. Results hold text, whole numbers and doubles
only, so that other engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelio.functions import dates, nulls, numbers, text
from parcelio.operators import (
    balances,
    columns,
    digest,
    features,
    geo,
    intervals,
    lifecycle,
    metrics,
    model,
    projection,
    sampling,
    scenarios,
)
from parcelio.operators import dictionaries as d
from parcelio.plans import credit, gazette, provisioning, views
from parcelio.session import new_shared_path
from parcelio.sources import database, delimited, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

KEYWORDS = ("the", "que", "und", "zzzquux")
FIRST_MONTH = date(1995, 1, 1)
LAST_MONTH = date(2001, 11, 1)
STATE = "NATION_7"
PROGRAMMES = ("ECONOMY", "PROMO")
AS_OF = date(2018, 11, 30)
SEED = 42


def portable(df: DataFrame, rounded: int | None = None) -> DataFrame:
    """Dates as text, flags and small integers as bigint, doubles rounded."""
    changed = {}
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            changed[field.name] = column.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.BooleanType)):
            changed[field.name] = column.cast("bigint")
        elif isinstance(field.dataType, T.FractionalType):
            value = column.cast("double")
            changed[field.name] = value if rounded is None else F.round(value, rounded)
    return df.withColumns(changed) if changed else df


# Provisioning ---------------------------------------------------------------


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provisioning.contract_terms(views.contracts(spark, sf_dir), views.regimes(spark))


def regime_assign(spark, sf_dir):
    assigned = lifecycle.assign_regime(views.contracts(spark, sf_dir), views.regimes(spark))
    return portable(
        assigned.select(
            "cpf", "dt_assinatura_contrato", "tipo_regencia", "carencia", "amortizacao",
            "pgto_juros", "percent_garantia",
        )
    )


def _order_periods(spark, sf_dir):
    """Every order as a period of its customer: some without end, some to the year 9999, some void."""
    day = F.col("o_orderdate").cast("date")
    key = F.col("o_orderkey")
    end = (
        F.when(key % 9 == 0, F.lit(None))
        .when(key % 7 == 0, F.lit("9999-12-31").cast("date"))
        .otherwise(F.date_add(day, ((key * 37) % 700 - 30).cast("int")))
    )
    return views.source(spark, sf_dir, "orders").select(
        "o_custkey", F.when(key % 31 != 0, day).alias("begins"), end.alias("ends"), "o_orderkey"
    )


def interval_lookup(spark, sf_dir):
    """The order in force for its customer 45 days after each order, or none."""
    points = views.source(spark, sf_dir, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("id"),
        F.date_add(F.col("o_orderdate").cast("date"), 45).alias("asked"),
    )
    found = intervals.lookup(
        points, "asked", _order_periods(spark, sf_dir), "begins", "ends", ["o_orderkey"],
        by=["o_custkey"],
    )
    return portable(found)


def interval_sweep(spark, sf_dir):
    """The same for numbers without a key, by sweep: which part of the number line holds each line item."""
    periods = views.source(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 4).alias("low"),
        (F.col("o_orderkey") * 4 + F.col("o_custkey") % 9 - 1).alias("high"),
        "o_orderkey",
    )
    points = views.source(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 4 + F.col("l_linenumber") - 2).alias("place")
    )
    return portable(intervals.lookup(points, "place", periods, "low", "high", ["o_orderkey"], few=0))


def contract_lifecycle(spark, sf_dir):
    return portable(
        _terms(spark, sf_dir).select(
            "cpf", "tipo_regencia", "duracao_utilizacao", "duracao_amortizacao",
            *projection.BOUNDARIES, "vlr_semestre", "divida_total", "vlr_abatimento",
            "bad_terms",
        )
    )


def score_attach(spark, sf_dir):
    joined = lifecycle.attach_scores(
        views.contracts(spark, sf_dir), views.scores(spark, sf_dir)
    )
    return joined.select("cpf", "score")


def semester_grid(spark, sf_dir):
    return portable(projection.semester_grid(_terms(spark, sf_dir), ["cpf", "tx_juros"]))


def _labelled(spark, sf_dir):
    grid = projection.semester_grid(_terms(spark, sf_dir), ["cpf", *projection.BOUNDARIES])
    return grid.withColumn("fase", projection.phase_label(F.col("cmpt")))


def phase_label(spark, sf_dir):
    return portable(_labelled(spark, sf_dir).select("cpf", "cmpt", "fase"))


def semester_index(spark, sf_dir):
    indexed = projection.with_semester_index(_labelled(spark, sf_dir))
    return portable(indexed.select("cpf", "cmpt", "fase", "id_cpf", "id_fase"))


def two_key_join(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    grid = projection.semester_grid(terms, ["cpf"])
    return portable(projection.opening_debt(grid, terms))


def _inputs(spark, sf_dir):
    return views.contracts(spark, sf_dir), views.scores(spark, sf_dir), views.regimes(spark)


def debt_projection(spark, sf_dir):
    debts = provisioning.debt_projection(*_inputs(spark, sf_dir), variant_four=True)
    return portable(
        debts.select(
            "cpf", "cmpt", "fase", "valor_divida", "valor_divida_II", "valor_divida_III",
            "valor_divida_IV",
        )
    )


def provision_scenario(spark, sf_dir, scenario):
    totals = provisioning.provision_scenario(*_inputs(spark, sf_dir), scenario)
    return portable(totals, rounded=3)


def provision_all(spark, sf_dir):
    return portable(provisioning.provision_all(*_inputs(spark, sf_dir)), rounded=3)


def scenario_export(spark, sf_dir):
    totals = provisioning.provision_scenario(*_inputs(spark, sf_dir), 2)
    rounded = totals.withColumn("tot_prov_cen2", F.round("tot_prov_cen2", 3))
    return sinks.scenario_rows(rounded, "tot_prov_cen2")


def half_years_elapsed(spark, sf_dir):
    as_of = F.lit(AS_OF)
    day = F.col("dt_assinatura_contrato")
    return views.contracts(spark, sf_dir).select(
        "cpf",
        dates.half_years_elapsed(day, as_of).alias("half_years"),
        dates.half_years_elapsed_calendar(day, as_of).alias("half_years_calendar"),
    )


# Balances -------------------------------------------------------------------


def balance_by_state(spark, sf_dir):
    return portable(balances.balance_by_state(views.balances(spark, sf_dir)), rounded=2)


def balance_table(spark, sf_dir):
    return portable(balances.balance_table(views.balances(spark, sf_dir)), rounded=2)


def latest_state_balance(spark, sf_dir):
    return portable(balances.latest_state_balance(views.balances(spark, sf_dir)), rounded=2)


def monthly_series(spark, sf_dir):
    series = balances.monthly_series(
        views.balances(spark, sf_dir), FIRST_MONTH, LAST_MONTH, STATE, PROGRAMMES[0]
    )
    return portable(series, rounded=2)


def state_mean_series(spark, sf_dir):
    series = balances.state_mean_series(views.balances(spark, sf_dir), STATE, FIRST_MONTH)
    return portable(series, rounded=6)


def cascade_filter(spark, sf_dir):
    chosen = balances.choose(
        views.balances(spark, sf_dir), STATE, PROGRAMMES, date(1997, 1, 1), date(1999, 12, 1)
    )
    return portable(chosen)


def account_balance_extract(spark, sf_dir):
    t = views.account_tables(spark, sf_dir)
    return portable(
        balances.account_extract(
            *[t[role] for role in database.EXTRACT_TABLES],
            bank=1,
            programme_codes=["R"],
            mask=(r"^(\d{5})(\d+)$", "$1.$2"),
        )
    )


def date_range_filter(spark, sf_dir):
    rows = views.balances(spark, sf_dir).filter(dates.year_range(F.col("ME_REFERENCIA"), 1998))
    chosen = columns.date_between(rows, "ME_REFERENCIA", date(1998, 3, 1), date(2000, 6, 1))
    return portable(chosen)


# Columns --------------------------------------------------------------------


def scan_phase_filter(spark, sf_dir):
    chosen = database.filter_phases(views.portfolio(spark, sf_dir))
    return chosen.select("id", "FaseSISFIES", "DiasAtraso")


def project_columns(spark, sf_dir):
    return views.balances(spark, sf_dir).select("SG_UF", "DS_PROGRAMA", "VL_SALDO_CONTA")


def drop_columns(spark, sf_dir):
    return columns.drop_columns(views.portfolio(spark, sf_dir), d.UNUSED_COLUMNS)


def rename_positional(spark, sf_dir):
    totals = balances.balance_by_state(views.balances(spark, sf_dir))
    names = ["code", "month", "conta", "fundos", "poupanca", "rdb"]
    return portable(columns.rename_positional(totals, names), rounded=2)


def distinct_sorted(spark, sf_dir):
    return columns.distinct_sorted(views.balances(spark, sf_dir), "SG_UF", "DS_PROGRAMA")


def outlier_filter(spark, sf_dir):
    derived = features.derive(views.portfolio(spark, sf_dir))
    return features.remove_outliers(derived).select(
        "id", "idade", "RendaFamiliarMensalBruta", "RendaPessoalMensalBruta"
    )


def drop_null_rows(spark, sf_dir):
    kept = nulls.drop_null_rows(views.portfolio(spark, sf_dir), "DiasAtraso")
    return kept.select("id", "DiasAtraso")


def masked_update(spark, sf_dir):
    school = "CursouEnsinoMedioEscolaPublica"
    updated = columns.masked_update(
        views.portfolio(spark, sf_dir), school, F.col(school) == "P", F.lit("S")
    )
    return updated.select("id", school)


def fill_nulls(spark, sf_dir):
    rows = views.portfolio(spark, sf_dir).select(
        "id", "DiasAtraso", "ValorRendaComprovadaFiadores", "UfIES", "NomeTurno"
    )
    return nulls.fill_missing(rows, 0, "", ["UfIES"])


def batch_cast(spark, sf_dir):
    rows = views.portfolio(spark, sf_dir).select(
        "id", "CnpjMant", "QtdeSemestreContratado", "UfIES", "NomeCurso"
    )
    named = rows.withColumn("texto", F.coalesce("UfIES", F.col("CnpjMant")))
    return columns.batch_cast(named, ["CnpjMant", "texto"], "double").select(
        "id", "CnpjMant", "texto"
    )


def string_slice(spark, sf_dir):
    title = F.col("o_orderpriority")
    return views.source(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.slice_text(title, 3, 5).alias("piece"),
        text.character_from_end(title).alias("before_last"),
        F.length(title).cast("bigint").alias("size"),
    )


def mask_identifier(spark, sf_dir):
    number = F.lpad(F.col("o_orderkey").cast("string"), 11, "0")
    masked = text.mask_identifier(number, r"^(\d{5})(\d{6})$", "$1.$2/2018")
    return views.source(spark, sf_dir, "orders").select("o_orderkey", masked.alias("masked"))


def latin1_encode(spark, sf_dir):
    encoded = text.latin1_bytes(F.col("text"))
    return views.source(spark, sf_dir, "documents").select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_characters"),
        F.length(encoded).cast("bigint").alias("n_bytes"),
    )


def parse_dates(spark, sf_dir):
    orders = views.source(spark, sf_dir, "orders")
    good = F.date_format("o_orderdate", "dd/MM/yyyy")
    damaged = F.when(F.col("o_orderkey") % 13 == 0, F.lit("31/02/1998")).otherwise(good)
    parsed = orders.select("o_orderkey", dates.parse_day_first(damaged).alias("day"))
    return portable(parsed)


def age_years(spark, sf_dir):
    return views.portfolio(spark, sf_dir).select(
        "id",
        dates.age_years(F.col("DtNascimento"), F.col("DtAssinaturaContratoAF")).alias("idade"),
    )


def rescale_censor(spark, sf_dir):
    scaled = numbers.rescale_censored(F.col("valor_atual"), geo.SCALE_LOW, geo.SCALE_HIGH)
    rows = views.municipal_values(spark, sf_dir).select("municipio", scaled.alias("fill"))
    return portable(rows, rounded=6)


# Credit features ------------------------------------------------------------


def default_flag(spark, sf_dir):
    return views.portfolio(spark, sf_dir).select(
        "id", features.default_flag(F.col("DiasAtraso")).alias("resposta")
    )


def region_map(spark, sf_dir):
    return views.portfolio(spark, sf_dir).select(
        "id", features.region_of_state(F.col("UfIES")).alias("Regiao_UF")
    )


def sponsor_join(spark, sf_dir):
    rows = views.portfolio(spark, sf_dir).select("id", "CnpjMant")
    joined = features.join_sponsors(rows, views.sponsors(spark, sf_dir))
    return joined.withColumnRenamed("QTD alunos por Mantenedora", "qtd_alunos")


def course_code_join(spark, sf_dir):
    rows = views.portfolio(spark, sf_dir).select("id", F.upper("NomeCurso").alias("NomeCurso"))
    return features.join_course_codes(rows, views.courses(spark, sf_dir))


def canonical_category(spark, sf_dir):
    name = features.canonical_course(F.upper("NomeCurso"))
    return views.portfolio(spark, sf_dir).select("id", name.alias("nome_curso_cat"))


def rare_category(spark, sf_dir):
    counts = features.course_counts(canonical_category(spark, sf_dir))
    pooled = F.when(F.col("count") < d.RARE_LIMIT, d.RARE_NAME).otherwise(
        F.col("nome_curso_cat")
    )
    return counts.select(
        "nome_curso_cat", F.col("count").alias("n"), pooled.alias("novo_curso")
    ).orderBy("n", "nome_curso_cat")


def category_group(spark, sf_dir):
    return features.pool_rare(canonical_category(spark, sf_dir))


def _model_table(spark, sf_dir):
    return credit.model_table(
        views.portfolio(spark, sf_dir),
        views.sponsors(spark, sf_dir),
        views.courses(spark, sf_dir),
    )


def feature_buckets(spark, sf_dir):
    return _model_table(spark, sf_dir).select(
        "id", F.col("resposta").cast("bigint"), "novo_curso2", *features.bucket_columns()
    )


# Samples --------------------------------------------------------------------


def sample_n(spark, sf_dir):
    sizes = geo.category_sizes(views.source(spark, sf_dir, "part"), "p_type", "p_brand")
    key = F.concat_ws("/", "category", "subcategory")
    return sampling.sample_rows(sizes, key, 31, SEED)


def bootstrap_sample(spark, sf_dir):
    rows = views.portfolio(spark, sf_dir).select("id", "DiasAtraso")
    return sampling.bootstrap_sample(rows, "id", rows.count(), SEED)


def train_test_split(spark, sf_dir):
    rows = views.portfolio(spark, sf_dir).select("id", "DiasAtraso")
    marked = sampling.mark_test_rows(rows, "id", 30, SEED)
    test = marked.filter("is_test").select("id", F.lit("test").alias("part"))
    train = sampling.complement(rows, test, "id").select("id", F.lit("train").alias("part"))
    return test.unionByName(train)


# Statistics -----------------------------------------------------------------


def roc_curve(spark, sf_dir):
    points = metrics.roc_curve(views.scored(spark, sf_dir))
    finite = points.withColumn(
        "cutoff", F.when(F.col("cutoff") == float("inf"), 9.0).otherwise(F.col("cutoff"))
    )
    return portable(finite, rounded=9)


def auc(spark, sf_dir):
    return portable(metrics.auc(views.scored(spark, sf_dir)), rounded=9)


def ks_two_sample(spark, sf_dir):
    return portable(metrics.ks_two_sample(views.scored(spark, sf_dir)), rounded=9)


def threshold_class(spark, sf_dir):
    return views.scored(spark, sf_dir).select(
        "doc_id", "p", metrics.threshold_class(F.col("p")).alias("p_class")
    )


def _classified(spark, sf_dir):
    return views.scored(spark, sf_dir).withColumn(
        "p_class", metrics.threshold_class(F.col("p"))
    )


def confusion_matrix(spark, sf_dir):
    matrix = metrics.confusion_matrix(_classified(spark, sf_dir), "p_class", "y")
    return portable(matrix, rounded=9)


def contingency_table(spark, sf_dir):
    table = metrics.contingency_table(_classified(spark, sf_dir), "p_class", "y", [0, 1])
    return table.withColumnsRenamed({"0": "actual_0", "1": "actual_1"})


def percent_table(spark, sf_dir):
    return portable(metrics.percent_table(_classified(spark, sf_dir), "p_class"), rounded=9)


# Model ----------------------------------------------------------------------


def _written_model_table(spark, sf_dir):
    """The model table, computed once for the split, the fit and the scores."""
    path = new_shared_path(spark, "model-table")
    table = _model_table(spark, sf_dir)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _training_rows(spark, sf_dir, table=None):
    table = _written_model_table(spark, sf_dir) if table is None else table
    return sampling.mark_test_rows(table, "id", 30, SEED)


def _final_model(spark, sf_dir, table=None):
    train = _training_rows(spark, sf_dir, table).filter(~F.col("is_test"))
    return model.fit_logit(train, "resposta", d.FINAL_PREDICTORS)


def credit_model(spark, sf_dir):
    """The final model, saved to the shared folder and read back."""
    path = new_shared_path(spark, "credit-model")
    _final_model(spark, sf_dir).save(spark, path)
    stored = model.FittedModel.load(spark, path)
    rows = [(p, v, float(b)) for (p, v), b in stored.effects().items()]
    rows.append((model.INTERCEPT, "", stored.intercept))
    return spark.createDataFrame(rows, "predictor string, level string, effect double")


def coef_table(spark, sf_dir):
    """The coefficients of the final model, saved to the shared folder and read back."""
    path = new_shared_path(spark, "credit-model")
    _final_model(spark, sf_dir).save(spark, path)
    return model.coefficient_table(spark, model.FittedModel.load(spark, path))


def score_balance(spark, sf_dir):
    """Scores of the final model, added up over its training rows by level."""
    train = _training_rows(spark, sf_dir).filter(~F.col("is_test"))
    frame = model.combinations(train, "resposta", d.FINAL_PREDICTORS)
    fitted = model.fit(frame, d.FINAL_PREDICTORS)
    return portable(model.score_balance(frame, fitted, d.FINAL_PREDICTORS), rounded=3)


def score_balance_copies(spark, sf_dir):
    """The same with two predictors that depend on the others: a copy, and a coarser one."""
    train = _training_rows(spark, sf_dir).filter(~F.col("is_test"))
    train = train.withColumn("rate_copy", F.col("taxadejuros_cat")).withColumn(
        "south", F.when(F.col("ufies_cat") == "c", "y").otherwise("n")
    )
    predictors = [*d.FINAL_PREDICTORS, "rate_copy", "south"]
    frame = model.combinations(train, "resposta", predictors)
    fitted = model.fit(frame, predictors)
    return portable(model.score_balance(frame, fitted, predictors), rounded=3)


def stepwise_aic(spark, sf_dir):
    train = _training_rows(spark, sf_dir).filter(~F.col("is_test"))
    frame = model.combinations(train, "resposta", d.FULL_PREDICTORS)
    _, steps = model.backward_aic(frame, d.FULL_PREDICTORS)
    return spark.createDataFrame(steps, "step int, dropped string, aic double")


def score_contracts(spark, sf_dir):
    table = _written_model_table(spark, sf_dir)
    scored = model.score_contracts(table, _final_model(spark, sf_dir, table))
    return scored.select("id", F.col("resposta").cast("bigint"), "score")


# Digest ---------------------------------------------------------------------


def _documents(spark, sf_dir):
    return views.source(spark, sf_dir, "documents")


def keyword_search(spark, sf_dir):
    return digest.keyword_counts(_documents(spark, sf_dir), "text", KEYWORDS)


def keyword_matches(spark, sf_dir):
    found = digest.matches(_documents(spark, sf_dir), "text", KEYWORDS)
    return found.select("keyword", "doc_id")


def keyword_table_search(spark, sf_dir):
    """Keywords that are rows: beginnings of benchmark items, brands, and language codes."""
    starts = F.substring("text", 1, 14)
    parts = (
        views.source(spark, sf_dir, "benchmark").select(starts.alias("keyword")),
        views.source(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword")),
        views.source(spark, sf_dir, "documents").select(F.col("lang").alias("keyword")),
    )
    keywords = parts[0].unionAll(parts[1]).unionAll(parts[2]).filter(F.length("keyword") > 0)
    return digest.table_counts(_documents(spark, sf_dir), "text", keywords)


def keyword_no_match(spark, sf_dir):
    return digest.keywords_without_match(_documents(spark, sf_dir), "text", KEYWORDS)


def _first_results(spark, sf_dir, n=5):
    found = digest.matches(_documents(spark, sf_dir), "text", KEYWORDS).select(
        "keyword",
        "doc_id",
        F.concat(F.lit("Documento "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("summary"),
        F.col("source").alias("href"),
    )
    return digest.first_results(found, [F.col("doc_id")], n)


def keyword_topn(spark, sf_dir):
    return portable(_first_results(spark, sf_dir).select("keyword", "position", "doc_id"))


def keyword_digest(spark, sf_dir):
    return digest.keyword_digest(_first_results(spark, sf_dir), KEYWORDS)


def single_digest(spark, sf_dir):
    results = _first_results(spark, sf_dir).filter(F.col("keyword") == KEYWORDS[0])
    return digest.single_digest(results, KEYWORDS[0], F.lit(AS_OF))


def page_fields(spark, sf_dir):
    fields = digest.page_fields(views.source(spark, sf_dir, "pages"))
    return fields.select("page_id", "title", "summary", "href")


def programme_digest(spark, sf_dir):
    return gazette.programme_digest(views.source(spark, sf_dir, "pages"), KEYWORDS, n=3)


def word_digest(spark, sf_dir):
    pages = views.source(spark, sf_dir, "pages")
    return gazette.word_digest(pages, F.lit(AS_OF), KEYWORDS[1], n=3)


# Geography ------------------------------------------------------------------


def municipal_value_join(spark, sf_dir):
    return geo.join_codes(
        views.municipal_values(spark, sf_dir), views.municipality_codes(spark, sf_dir)
    )


def region_filter(spark, sf_dir):
    return geo.filter_regions(views.municipality_codes(spark, sf_dir), [1, 2])


def choropleth_join(spark, sf_dir):
    regions = views.municipality_codes(spark, sf_dir).select(
        F.col("Codigo_IBGE").alias("City"), "Region"
    )
    return geo.choropleth(
        geo.filter_regions(regions, [1, 2]),
        municipal_value_join(spark, sf_dir),
        {"City": "Codigo_IBGE"},
        ["valor_atual", "valor_proposto"],
    )


def polygon_vertices(spark, sf_dir):
    vertices = geo.polygon_vertices(views.map_polygons(spark, sf_dir))
    return portable(vertices, rounded=6)


def category_hierarchy(spark, sf_dir):
    sizes = geo.category_sizes(views.source(spark, sf_dir, "part"), "p_type", "p_brand")
    return geo.category_hierarchy(sizes)


def duplicate_names(spark, sf_dir):
    rows = views.portfolio(spark, sf_dir)
    return lifecycle.duplicate_keys(rows, "CnpjMant").withColumnRenamed("count", "n")


# Files ----------------------------------------------------------------------


def read_delim_ptbr(spark, sf_dir):
    """Written with a decimal comma to the shared folder, then read back."""
    path = new_shared_path(spark, "ptbr")
    rows = views.portfolio(spark, sf_dir).select(
        "id", "CnpjMant", "DtNascimento", "DiasAtraso", "ValorFinanciadoSISFIES", "TipoGarantia"
    )
    sinks.write_semicolon(rows, path, comma_columns=["ValorFinanciadoSISFIES"])
    schema = (
        "id bigint, CnpjMant string, DtNascimento date, DiasAtraso bigint, "
        "ValorFinanciadoSISFIES decimal(20,5), TipoGarantia string"
    )
    return portable(delimited.read_semicolon(spark, path, schema), rounded=4)


def _damaged_lines(spark, sf_dir):
    """Portfolio lines with a damaged date, number or amount in some of them."""
    path = new_shared_path(spark, "damaged")
    key = F.col("id")
    amount = sinks.comma_number(F.col("ValorFinanciadoSISFIES"))
    rows = views.portfolio(spark, sf_dir).select(
        F.when(key % 11 == 0, F.concat(F.lit("n"), key)).otherwise(key.cast("string")).alias("id"),
        F.when(key % 7 == 0, F.lit("31/02/1990"))
        .otherwise(F.date_format("DtNascimento", "dd/MM/yyyy"))
        .alias("DtNascimento"),
        F.when(key % 5 == 0, F.lit("NA")).when(key % 13 == 0, F.lit("muito")).otherwise(amount)
        .alias("ValorFinanciadoSISFIES"),
        F.when(key % 3 == 0, F.lit("NA")).otherwise(F.col("TipoGarantia")).alias("TipoGarantia"),
    )
    sinks.write_semicolon(rows, path)
    schema = "id bigint, DtNascimento date, ValorFinanciadoSISFIES decimal(20,5), TipoGarantia string"
    return delimited.read_checked(spark, path, schema, date_format=delimited.DAY_FIRST)


def read_delim_rejects(spark, sf_dir):
    """Every damaged field, by the first field of its line, with value and reason."""
    faults = delimited.rejected(_damaged_lines(spark, sf_dir))
    return faults.select(F.split("line", ";")[0].alias("line_id"), "column", "value", "reason")


def read_delim_accepted(spark, sf_dir):
    """The lines without any damage."""
    return portable(delimited.accepted(_damaged_lines(spark, sf_dir)), rounded=4)


def read_delim_latin1(spark, sf_dir):
    path = new_shared_path(spark, "latin1")
    rows = views.portfolio(spark, sf_dir).select("id", "NomeCurso", "DtNascimento")
    sinks.write_semicolon(
        rows, path, encoding="ISO-8859-1", date_format=delimited.DAY_FIRST
    )
    schema = "id bigint, NomeCurso string, DtNascimento date"
    return portable(
        delimited.read_semicolon_latin1(
            spark, path, schema, date_format=delimited.DAY_FIRST
        )
    )


def read_regimes(spark, sf_dir):
    """A table in the format of the regime file, one row per order."""
    path = new_shared_path(spark, "regimes")
    day = F.col("o_orderdate").cast("date")
    rows = views.source(spark, sf_dir, "orders").select(
        day.alias("inicio"),
        F.add_months(day, 6).alias("fim"),
        F.col("o_orderkey").cast("string").alias("tipo_regencia"),
        (F.col("o_custkey") % 100 / F.lit(10.0)).alias("tx_juros"),
        F.lit(3).alias("carencia"),
        F.lit("3*qtd_sem_contratado").alias("amortizacao"),
        F.lit(100).alias("pgto_juros"),
        (F.col("o_custkey") % 100).cast("int").alias("percent_garantia"),
    )
    sinks.write_semicolon(rows, path, date_format=delimited.DAY_FIRST)
    return portable(delimited.read_regimes(spark, path))


def read_csv_drop_index(spark, sf_dir):
    path = new_shared_path(spark, "indexed")
    rows = views.contracts(spark, sf_dir).select(
        F.col("cpf").alias("X1"), "cpf", "dt_assinatura_contrato", "fase", "tx_juros"
    )
    rows.write.option("header", True).csv(path)
    schema = "X1 bigint, cpf string, dt_assinatura_contrato date, fase string, tx_juros double"
    return portable(delimited.read_comma_drop_index(spark, path, schema))


def table_columns(spark, sf_dir):
    """A columnar read of two columns."""
    return tables.read_table(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name"])


QUERIES: dict[str, Query] = {
    "provision_all": provision_all,
    **{
        f"provision_scenario_{s}": partial(provision_scenario, scenario=s)
        for s in scenarios.SCENARIOS
    },
    "debt_projection": debt_projection,
    "regime_assign": regime_assign,
    "interval_lookup": interval_lookup,
    "interval_sweep": interval_sweep,
    "contract_lifecycle": contract_lifecycle,
    "score_attach": score_attach,
    "semester_grid": semester_grid,
    "phase_label": phase_label,
    "semester_index": semester_index,
    "two_key_join": two_key_join,
    "scenario_export": scenario_export,
    "half_years_elapsed": half_years_elapsed,
    "balance_by_state": balance_by_state,
    "balance_table": balance_table,
    "latest_state_balance": latest_state_balance,
    "monthly_series": monthly_series,
    "state_mean_series": state_mean_series,
    "cascade_filter": cascade_filter,
    "account_balance_extract": account_balance_extract,
    "date_range_filter": date_range_filter,
    "scan_phase_filter": scan_phase_filter,
    "project_columns": project_columns,
    "drop_columns": drop_columns,
    "rename_positional": rename_positional,
    "distinct_sorted": distinct_sorted,
    "outlier_filter": outlier_filter,
    "drop_null_rows": drop_null_rows,
    "masked_update": masked_update,
    "fill_nulls": fill_nulls,
    "batch_cast": batch_cast,
    "string_slice": string_slice,
    "mask_identifier": mask_identifier,
    "latin1_encode": latin1_encode,
    "parse_dates": parse_dates,
    "age_years": age_years,
    "rescale_censor": rescale_censor,
    "default_flag": default_flag,
    "region_map": region_map,
    "sponsor_join": sponsor_join,
    "course_code_join": course_code_join,
    "canonical_category": canonical_category,
    "rare_category": rare_category,
    "category_group": category_group,
    "feature_buckets": feature_buckets,
    "sample_n": sample_n,
    "bootstrap_sample": bootstrap_sample,
    "train_test_split": train_test_split,
    "roc_curve": roc_curve,
    "auc": auc,
    "ks_two_sample": ks_two_sample,
    "threshold_class": threshold_class,
    "confusion_matrix": confusion_matrix,
    "contingency_table": contingency_table,
    "percent_table": percent_table,
    "credit_model": credit_model,
    "coef_table": coef_table,
    "score_balance": score_balance,
    "score_balance_copies": score_balance_copies,
    "stepwise_aic": stepwise_aic,
    "score_contracts": score_contracts,
    "keyword_search": keyword_search,
    "keyword_matches": keyword_matches,
    "keyword_table_search": keyword_table_search,
    "keyword_no_match": keyword_no_match,
    "keyword_topn": keyword_topn,
    "keyword_digest": keyword_digest,
    "single_digest": single_digest,
    "page_fields": page_fields,
    "programme_digest": programme_digest,
    "word_digest": word_digest,
    "municipal_value_join": municipal_value_join,
    "region_filter": region_filter,
    "choropleth_join": choropleth_join,
    "polygon_vertices": polygon_vertices,
    "category_hierarchy": category_hierarchy,
    "duplicate_names": duplicate_names,
    "read_delim_ptbr": read_delim_ptbr,
    "read_delim_rejects": read_delim_rejects,
    "read_delim_accepted": read_delim_accepted,
    "read_delim_latin1": read_delim_latin1,
    "read_regimes": read_regimes,
    "read_csv_drop_index": read_csv_drop_index,
    "table_columns": table_columns,
}
