"""The library's input tables, derived from the star-schema test tables.

Each view covers its whole source table. Missing values are planted by rules
on the keys, because the source tables hold none.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The three contract regimes.
REGIMES = (
    ("2010-01-01", "2013-01-31", "I", 3.4, 3, "(3*qtd_sem_contratado)+2", 100, 80),
    ("2013-02-01", "2015-01-31", "II", 3.4, 3, "(3*qtd_sem_contratado)+2", 100, 90),
    ("2015-02-01", "2017-12-31", "III", 6.5, 3, "3*qtd_sem_contratado", 300, 90),
)

# State codes by nation number.
STATES = "ACAPAMPARORRTOALBACEMAPBPEPIRNSEDFMTMSGORSSCPRSPMG"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _shifted(day: str, months: Column | int) -> Column:
    months = F.lit(months) if isinstance(months, int) else months
    return F.add_months(F.col(day).cast("date"), months)


def _every(key: str, n: int, remainder: int = 0) -> Column:
    return F.col(key) % n == remainder


def regimes(spark: SparkSession) -> DataFrame:
    names = (
        "inicio", "fim", "tipo_regencia", "tx_juros", "carencia", "amortizacao", "pgto_juros",
        "percent_garantia",
    )
    values = ", ".join(str(row) for row in REGIMES)
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS r({', '.join(names)})")
    return rows.withColumns({c: F.col(c).cast("date") for c in ("inicio", "fim")}).withColumn(
        "tx_juros", F.col("tx_juros").cast("double")
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(_every("o_orderkey", 10), 276).otherwise(192)
    return source(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cpf"),
        _shifted("o_orderdate", late).alias("dt_assinatura_contrato"),
        F.when(F.col("o_orderstatus") == "O", "utilizacao")
        .when(F.col("o_orderstatus") == "P", "carencia")
        .otherwise("amortizacao")
        .alias("fase"),
        F.when(_every("o_orderkey", 2), 3.4).otherwise(6.5).alias("tx_juros"),
        (4 + F.col("o_orderkey") % 7).cast("double").alias("qtd_sem_contratado"),
        F.lit(0.0).alias("qtd_sem_dilatado"),
        (1 + F.col("o_orderkey") % 4).cast("double").alias("qtd_sem_cursado"),
        F.col("o_totalprice").alias("valor_divida"),
        (F.col("o_totalprice") * 0.5).alias("valor_liberado"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payer scores; a fifth of the customers has an unknown score."""
    return source(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cpf"),
        F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 100) / F.lit(100.0)).alias(
            "score"
        ),
    )


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = source(spark, sf_dir, "orders")
    customer = source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    kind = F.col("o_custkey") % 8
    names = (
        "administração de empresas", "medicina", "direito", "letras - português",
        "pedagogia", "marketing", "engenharia civil",
    )
    course = F.concat(F.lit("curso "), F.col("o_custkey").cast("string"))
    for number, name in enumerate(names):
        course = F.when(kind == number, name).otherwise(course)
    guarantee = F.col("o_orderkey") % 5
    school = F.col("o_orderkey") % 3
    unknown = F.lit(None)
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.when(
            ~_every("o_orderkey", 17), F.floor("o_totalprice").cast("bigint") % 730
        ).alias("DiasAtraso"),
        F.when(F.col("o_orderstatus") == "O", "utilizacao")
        .when(F.col("o_orderstatus") == "P", "liquidado")
        .otherwise("amortizacao")
        .alias("FaseSISFIES"),
        F.when(
            ~_every("o_orderkey", 23),
            F.substring(F.lit(STATES), 1 + 2 * F.col("c_nationkey"), F.lit(2)),
        ).alias("UfIES"),
        _shifted("o_orderdate", 192).alias("DtAssinaturaContratoAF"),
        _shifted(
            "o_orderdate", (192 - 12 * (10 + F.col("o_custkey") % 75)).cast("int")
        ).alias("DtNascimento"),
        F.lpad((F.col("o_custkey") % 120).cast("string"), 14, "0").alias("CnpjMant"),
        course.alias("NomeCurso"),
        F.floor(F.col("o_totalprice") / 20).cast("bigint").alias("RendaFamiliarMensalBruta"),
        F.floor(F.col("o_totalprice") / 25).cast("bigint").alias("RendaPessoalMensalBruta"),
        (F.col("o_totalprice") / 4).alias("ValorFinanciadoSISFIES"),
        F.when(~_every("o_orderkey", 6), (F.col("o_orderkey") % 4000).cast("double")).alias(
            "ValorRendaComprovadaFiadores"
        ),
        (4 + F.col("o_orderkey") % 9).cast("double").alias("QtdeSemestreContratado"),
        F.when(_every("o_orderkey", 3), 650.0).otherwise(340.0).alias("TaxaDeJuros"),
        F.when(_every("o_orderkey", 2), 10000.0).otherwise(7500.0).alias("PercentualFinanciado"),
        F.when(guarantee == 0, "FIANCA CONVENCIONAL+FGEDUC")
        .when(guarantee == 1, "")
        .when(guarantee == 2, "SEM FIAN?")
        .when(guarantee == 3, "FGEDUC")
        .otherwise(unknown)
        .alias("TipoGarantia"),
        F.when(school == 0, "S").when(school == 1, "N").otherwise("P").alias(
            "CursouEnsinoMedioEscolaPublica"
        ),
        F.when(_every("o_orderkey", 4), "INTEGRAL")
        .when(_every("o_orderkey", 4, 1), unknown)
        .otherwise("NOTURNO")
        .alias("NomeTurno"),
        F.when(_every("o_orderkey", 7), unknown)
        .when(_every("o_orderkey", 2), "Solteiro")
        .otherwise("Casado")
        .alias("EstadoCivil"),
        F.when(_every("o_orderkey", 11), "S         ").otherwise("N         ").alias(
            "Deficiente"
        ),
        F.lit("0").alias("CodCurso"),
    )


def sponsors(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("s_suppkey") % 3
    return source(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("CNPJ Mantenedora"),
        F.when(size == 0, "GM").when(size == 1, "P").otherwise("M").alias("Porte"),
        (10 * F.col("s_suppkey")).cast("double").alias("QTD alunos por Mantenedora"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course codes from 1 to 7 by the length of the name; one name has none."""
    names = portfolio(spark, sf_dir).select("NomeCurso").distinct()
    code = (1 + F.length("NomeCurso") % 7).cast("string")
    return names.select(
        "NomeCurso",
        F.when(F.col("NomeCurso") == "marketing", "").otherwise(code).alias("CodCurso"),
    )


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = source(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = source(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = source(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        source(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("n_name").alias("SG_UF"),
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("ME_REFERENCIA"),
            F.col("p_type").alias("DS_PROGRAMA"),
            F.col("l_extendedprice").alias("VL_SALDO_CONTA"),
            F.col("l_quantity").alias("VL_SALDO_FUNDOS"),
            F.col("l_discount").alias("VL_SALDO_POUPANCA"),
            F.col("l_tax").alias("VL_SALDO_RDB"),
        )
    )


def account_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six tables of the account extract."""
    line = source(spark, sf_dir, "lineitem")
    flags = line.select("l_returnflag").distinct()
    supplier = source(spark, sf_dir, "supplier")
    nation = source(spark, sf_dir, "nation")
    return {
        "balances": line.select(
            F.col("l_suppkey").alias("nu_cnpj"),
            F.col("l_partkey").alias("nu_agencia"),
            F.col("l_linenumber").alias("nu_banco"),
            F.col("l_orderkey").alias("nu_conta_corrente"),
            F.col("l_extendedprice").alias("vl_saldo_conta"),
            F.concat(F.lit("23400"), F.col("l_orderkey").cast("string")).alias("nu_processo"),
        ),
        "accounts": line.select(
            F.col("l_suppkey").alias("nu_identificador"),
            F.col("l_partkey").alias("nu_agencia"),
            F.col("l_linenumber").alias("nu_banco"),
            F.col("l_orderkey").alias("nu_conta_corrente"),
            F.col("l_returnflag").alias("co_programa"),
            F.col("l_linestatus").alias("co_situacao_conta"),
            F.col("l_suppkey").alias("nu_seq_entidade"),
        ).distinct(),
        "linked_programmes": flags.select(
            F.col("l_returnflag").alias("co_programa"),
            F.col("l_returnflag").alias("co_programa_vinculado"),
        ),
        "programmes": flags.select(
            F.col("l_returnflag").alias("co_programa"),
            F.concat(F.lit("Programa "), F.col("l_returnflag")).alias("ds_programa"),
        ),
        "statuses": line.select(F.col("l_linestatus").alias("co_st_conta"))
        .distinct()
        .withColumn("no_st_conta", F.concat(F.lit("Status "), F.col("co_st_conta"))),
        "entities": supplier.join(
            nation, F.col("s_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("s_suppkey").alias("nu_seq_entidade"),
            F.col("s_name").alias("no_razao_social"),
            F.col("n_name").alias("sg_uf"),
        ),
    }


def municipal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return source(spark, sf_dir, "customer").select(
        F.col("c_name").alias("municipio"),
        (F.lit(3250.0) + key % 600).alias("valor_atual"),
        (F.lit(3280.0) + key % 550).alias("valor_proposto"),
    )


def municipality_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = source(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        source(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_name").alias("Nome_Municipio"),
            (1000000 + F.col("c_custkey")).alias("Codigo_IBGE"),
            F.col("n_regionkey").cast("bigint").alias("Region"),
        )
    )


def map_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines read from the embeddings: every pair of floats is a vertex."""
    size = F.size("embedding")
    pairs = F.transform(
        F.sequence(F.lit(0), (size / 2).cast("int") - 1),
        lambda i: F.struct(
            F.get(F.col("embedding"), 2 * i).cast("double").alias("long"),
            F.get(F.col("embedding"), 2 * i + 1).cast("double").alias("lat"),
        ),
    )
    return source(spark, sf_dir, "embeddings").select(
        (1000000 + F.col("vec_id")).alias("City"),
        (F.col("vec_id") % 5).alias("Region"),
        pairs.alias("geometry"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a score with ties; every nineteenth score is unknown."""
    return source(spark, sf_dir, "documents").select(
        "doc_id",
        (F.col("doc_id") % 2).alias("y"),
        F.when(
            ~_every("doc_id", 19), F.round((F.col("n_chars") % 97) / F.lit(97.0), 2)
        ).alias("p"),
    )
