"""SQL equivalents of the catalog queries, for comparison in another engine.

Each statement restates the query from the source tables on its own; nothing is
shared with the Spark code but the fixed values of the course dictionaries.
"""

from __future__ import annotations

from parcelio.operators import dictionaries as d


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


# Contracts and their terms --------------------------------------------------

CONTRACTS = """
contracts AS (
  SELECT o_orderkey AS cpf,
         cast(cast(o_orderdate AS date)
              + to_months(CASE WHEN o_orderkey % 10 = 0 THEN 276 ELSE 192 END) AS date)
           AS dt_assinatura_contrato,
         CASE o_orderstatus WHEN 'O' THEN 'utilizacao' WHEN 'P' THEN 'carencia'
              ELSE 'amortizacao' END AS fase,
         CASE WHEN o_orderkey % 2 = 0 THEN 3.4e0 ELSE 6.5e0 END AS tx_juros,
         cast(4 + o_orderkey % 7 AS double) AS qtd_sem_contratado,
         cast(1 + o_orderkey % 4 AS double) AS qtd_sem_cursado,
         o_totalprice AS valor_divida,
         o_totalprice * 0.5e0 AS valor_liberado
  FROM orders)"""

SCORES = """
scores AS (
  SELECT o_orderkey AS cpf,
         CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 100) / 100e0 END AS score
  FROM orders)"""

REGIMES = """
regimes(inicio, fim, tipo_regencia, carencia, amortizacao, pgto_juros, percent_garantia) AS (
  VALUES (DATE '2010-01-01', DATE '2013-01-31', 'I', 3, '(3*qtd_sem_contratado)+2', 100, 80),
         (DATE '2013-02-01', DATE '2015-01-31', 'II', 3, '(3*qtd_sem_contratado)+2', 100, 90),
         (DATE '2015-02-01', DATE '2017-12-31', 'III', 3, '3*qtd_sem_contratado', 300, 90)),
assigned AS (
  SELECT n.*, t.carencia, t.amortizacao, t.pgto_juros, t.percent_garantia
  FROM (SELECT c.*, coalesce(r.tipo_regencia, 'III') AS tipo_regencia
        FROM contracts c
        LEFT JOIN regimes r ON c.dt_assinatura_contrato BETWEEN r.inicio AND r.fim) n
  LEFT JOIN regimes t ON n.tipo_regencia = t.tipo_regencia)"""

TERMS = """
used AS (
  SELECT *, CASE WHEN fase = 'utilizacao' THEN qtd_sem_contratado ELSE qtd_sem_cursado END
           AS duracao_utilizacao,
         make_date(year(dt_assinatura_contrato),
                   CASE WHEN month(dt_assinatura_contrato) <= 6 THEN 1 ELSE 7 END, 1)
           AS in_utilizacao,
         round_even(CASE WHEN fase IN ('utilizacao', 'carencia') THEN valor_divida
                         ELSE valor_liberado END / qtd_sem_cursado, 0) AS vlr_semestre
  FROM assigned),
timed AS (
  SELECT *, 3 * duracao_utilizacao
           + CASE WHEN tipo_regencia IN ('I', 'II') THEN 2 ELSE 0 END AS duracao_amortizacao,
         cast(in_utilizacao + to_months(cast(6 * (duracao_utilizacao - 1) AS integer)) AS date)
           AS fim_utilizacao,
         round_even(vlr_semestre * qtd_sem_contratado, 0) AS divida_total
  FROM used),
terms AS (
  SELECT *,
         cast(fim_utilizacao + to_months(6) AS date) AS in_carencia,
         cast(fim_utilizacao + to_months(18) AS date) AS fim_carencia,
         cast(fim_utilizacao + to_months(24) AS date) AS in_amortizacao,
         cast(fim_utilizacao + to_months(18 + cast(6 * duracao_amortizacao AS integer)) AS date)
           AS fim_amortizacao,
         round_even(divida_total / duracao_amortizacao, 0) AS vlr_abatimento
  FROM timed)"""

GRID = """
semesters AS (
  SELECT cast(i + 1 AS bigint) AS idx, cast(DATE '2018-01-01' + to_months(cast(6 * i AS integer)) AS date) AS cmpt
  FROM range(26) r(i)),
grid AS (
  SELECT t.cpf, t.tx_juros, s.idx, s.cmpt,
         CASE WHEN s.cmpt BETWEEN t.fim_amortizacao AND DATE '2030-07-01' THEN '4-sem fase'
              WHEN s.cmpt BETWEEN t.in_amortizacao AND t.fim_amortizacao THEN '3-amortizacao'
              WHEN s.cmpt BETWEEN t.in_carencia AND t.fim_carencia THEN '2-carencia'
              WHEN s.cmpt BETWEEN t.in_utilizacao AND t.fim_utilizacao THEN '1-utilizacao'
              ELSE '' END AS fase
  FROM terms t, semesters s
  WHERE s.cmpt BETWEEN (SELECT min(in_utilizacao) FROM terms)
                   AND (SELECT max(fim_amortizacao) FROM terms))"""

DEBT = """
rated AS (
  SELECT t.*, coalesce(s.score, 0.5e0) AS score, 1 + t.tx_juros / 200e0 AS g
  FROM terms t LEFT JOIN scores s ON t.cpf = s.cpf),
walk(cpf, idx, d1, d2, d4) AS (
  SELECT cpf, cast(1 AS bigint), valor_divida, valor_divida, valor_divida FROM rated
  UNION ALL
  SELECT w.cpf, g.idx,
         CASE WHEN g.fase = '1-utilizacao' THEN w.d1 * r.g + r.vlr_semestre
              WHEN g.fase = '2-carencia' OR r.score > 0.3e0 THEN w.d1 * r.g
              ELSE w.d1 * r.g - r.vlr_abatimento * r.g END,
         CASE WHEN g.fase = '1-utilizacao' THEN w.d2 * r.g + r.vlr_semestre
              WHEN g.fase = '2-carencia' OR r.score > 0.3e0 THEN w.d2 * r.g
              ELSE w.d2 * r.g - r.vlr_abatimento * r.g * (1 - r.score) END,
         CASE WHEN g.fase = '1-utilizacao' THEN w.d1 * r.g + r.vlr_semestre
              WHEN g.fase = '2-carencia' THEN w.d1 * r.g
              ELSE w.d4 * r.g - r.vlr_abatimento * r.g * (1 - r.score) END
  FROM walk w
  JOIN grid g ON g.cpf = w.cpf AND g.idx = w.idx + 1
  JOIN rated r ON r.cpf = w.cpf),
debts AS (
  SELECT g.cpf, g.idx, g.cmpt, g.fase, r.tx_juros, r.score, r.percent_garantia / 100e0 AS share,
         row_number() OVER (PARTITION BY g.cpf, g.fase ORDER BY g.cmpt) AS id_fase,
         round_even(greatest(w.d1, 0e0), 0) AS v1,
         round_even(greatest(w.d2, 0e0), 0) AS v2,
         round_even(greatest(w.d4, 0e0), 0) AS v4
  FROM grid g JOIN walk w ON w.cpf = g.cpf AND w.idx = g.idx JOIN rated r ON r.cpf = g.cpf),
lagged AS (
  SELECT *, lag(v2) OVER (PARTITION BY cpf ORDER BY idx) AS v2_before FROM debts)"""

_PROVISIONS = {
    1: "CASE WHEN fase = '3-amortizacao' THEN v1 * share ELSE 0 END",
    2: "CASE WHEN fase <> '3-amortizacao' THEN 0 WHEN score > 0.3e0 THEN v2 * share "
       "ELSE v2 * share * score END",
    3: "CASE WHEN fase <> '3-amortizacao' THEN 0 WHEN score > 0.3e0 THEN v2 * share "
       "WHEN id_fase = 1 THEN v2 * share * score ELSE v2_before * tx_juros END",
    4: "CASE WHEN fase = '3-amortizacao' THEN v2 * share * score ELSE 0 END",
}

_CONTRACT_CTES = (CONTRACTS, SCORES, REGIMES, TERMS)
_TERMS = _with(*_CONTRACT_CTES)
_GRID = _with(*_CONTRACT_CTES, GRID)
_DEBT = _with(*_CONTRACT_CTES, GRID, DEBT, recursive=True)


def _scenario(number: int) -> str:
    condition = "WHERE score > 0.3e0" if number == 1 else ""
    return _DEBT + f"""
SELECT cast(cmpt AS varchar) AS cmpt, count(*) AS qtd_contratos,
       round(sum({_PROVISIONS[number]}), 3) AS tot_prov_cen{number}
FROM lagged {condition} GROUP BY cmpt"""


PROVISIONING = {
    "provision_all": _DEBT + f"""
SELECT cast(cmpt AS varchar) AS cmpt, count(*) AS qtd_contratos,
       count(*) FILTER (score > 0.3e0) AS qtd_contratos_cen1,
       round(sum({_PROVISIONS[1]}) FILTER (score > 0.3e0), 3) AS tot_prov_cen1,
       round(sum({_PROVISIONS[2]}), 3) AS tot_prov_cen2,
       round(sum({_PROVISIONS[3]}), 3) AS tot_prov_cen3,
       round(sum({_PROVISIONS[4]}), 3) AS tot_prov_cen4
FROM lagged GROUP BY cmpt""",
    **{f"provision_scenario_{n}": _scenario(n) for n in (1, 2, 3, 4)},
    "debt_projection": _DEBT + """
SELECT cpf, cast(cmpt AS varchar) AS cmpt, fase, v1 AS valor_divida, v2 AS "valor_divida_II",
       v2 AS "valor_divida_III", v4 AS "valor_divida_IV" FROM debts""",
    "scenario_export": _DEBT + f"""
, totals AS (SELECT cmpt, count(*) AS n, round(sum({_PROVISIONS[2]}), 3) AS total
             FROM lagged GROUP BY cmpt)
SELECT cast(row_number() OVER (ORDER BY cmpt) AS varchar) AS "index",
       cast(cmpt AS varchar) AS cmpt, cast(n AS varchar) AS qtd_contratos,
       replace(rtrim(rtrim(cast(cast(total AS decimal(38, 5)) AS varchar), '0'), '.'), '.', ',')
         AS tot_prov_cen2
FROM totals""",
    "regime_assign": _TERMS + """
SELECT cpf, cast(dt_assinatura_contrato AS varchar) AS dt_assinatura_contrato, tipo_regencia,
       cast(carencia AS bigint) AS carencia, amortizacao, cast(pgto_juros AS bigint) AS pgto_juros,
       cast(percent_garantia AS bigint) AS percent_garantia FROM terms""",
    "contract_lifecycle": _TERMS + """
SELECT cpf, tipo_regencia, duracao_utilizacao, duracao_amortizacao,
       cast(in_utilizacao AS varchar) AS in_utilizacao,
       cast(fim_utilizacao AS varchar) AS fim_utilizacao,
       cast(in_carencia AS varchar) AS in_carencia,
       cast(fim_carencia AS varchar) AS fim_carencia,
       cast(in_amortizacao AS varchar) AS in_amortizacao,
       cast(fim_amortizacao AS varchar) AS fim_amortizacao,
       vlr_semestre, divida_total, vlr_abatimento,
       cast(vlr_semestre IS NULL OR vlr_abatimento IS NULL AS bigint) AS bad_terms
FROM terms""",
    "score_attach": _with(CONTRACTS, SCORES) + """
SELECT c.cpf, coalesce(s.score, 0.5e0) AS score
FROM contracts c LEFT JOIN scores s ON c.cpf = s.cpf""",
    "semester_grid": _GRID + "SELECT cpf, tx_juros, cast(cmpt AS varchar) AS cmpt FROM grid",
    "phase_label": _GRID + "SELECT cpf, cast(cmpt AS varchar) AS cmpt, fase FROM grid",
    "semester_index": _GRID + """
SELECT cpf, cast(cmpt AS varchar) AS cmpt, fase,
       row_number() OVER (PARTITION BY cpf ORDER BY cmpt) AS id_cpf,
       row_number() OVER (PARTITION BY cpf, fase ORDER BY cmpt) AS id_fase
FROM grid""",
    "two_key_join": _GRID + """
SELECT g.cpf, cast(g.cmpt AS varchar) AS cmpt, o.valor_divida, t.vlr_semestre, t.vlr_abatimento
FROM grid g
LEFT JOIN (SELECT cpf, DATE '2018-01-01' AS cmpt, valor_divida FROM terms) o
  ON o.cpf = g.cpf AND o.cmpt = g.cmpt
LEFT JOIN terms t ON t.cpf = g.cpf""",
    "half_years_elapsed": _with(CONTRACTS) + """
, halves AS (
  SELECT cpf, make_date(year(dt_assinatura_contrato),
                        CASE WHEN month(dt_assinatura_contrato) <= 6 THEN 1 ELSE 7 END, 1) AS h
  FROM contracts)
SELECT cpf,
       cast(floor(date_diff('day', h, DATE '2018-07-01') / 365e0 * 2) AS bigint) + 1
         AS half_years,
       cast((2018 * 12 + 6 - year(h) * 12 - month(h) + 1) / 6 AS bigint) + 1
         AS half_years_calendar
FROM halves""",
}

# Balances -------------------------------------------------------------------

BALANCES = """
balances AS (
  SELECT n_name AS "SG_UF", cast(date_trunc('month', l_shipdate) AS date) AS "ME_REFERENCIA",
         p_type AS "DS_PROGRAMA", l_extendedprice AS "VL_SALDO_CONTA",
         l_quantity AS "VL_SALDO_FUNDOS", l_discount AS "VL_SALDO_POUPANCA",
         l_tax AS "VL_SALDO_RDB"
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey)"""

_BALANCES = _with(BALANCES)
_BALANCE_ROW = """SELECT "SG_UF", cast("ME_REFERENCIA" AS varchar) AS "ME_REFERENCIA",
       "DS_PROGRAMA", "VL_SALDO_CONTA", "VL_SALDO_FUNDOS", "VL_SALDO_POUPANCA", "VL_SALDO_RDB"
FROM balances """

BALANCE = {
    "balance_by_state": _BALANCES + """
SELECT "SG_UF", cast("ME_REFERENCIA" AS varchar) AS "ME_REFERENCIA",
       round(sum("VL_SALDO_CONTA"), 2) AS saldo_1, round(sum("VL_SALDO_FUNDOS"), 2) AS saldo_2,
       round(sum("VL_SALDO_POUPANCA"), 2) AS saldo_3, round(sum("VL_SALDO_RDB"), 2) AS saldo_4
FROM balances GROUP BY "SG_UF", balances."ME_REFERENCIA" """,
    "balance_table": _BALANCES + """
SELECT "SG_UF" AS "UF", cast("ME_REFERENCIA" AS varchar) AS "DATA", "DS_PROGRAMA" AS "PROGRAMA",
       round(sum("VL_SALDO_CONTA"), 2) AS "SALDO_CONTA",
       round(sum("VL_SALDO_FUNDOS"), 2) AS "SALDO_FUNDOS",
       round(sum("VL_SALDO_POUPANCA"), 2) AS "SALDO_POUPANCA",
       round(sum("VL_SALDO_RDB"), 2) AS "SALDO_RDB"
FROM balances GROUP BY "SG_UF", "ME_REFERENCIA", "DS_PROGRAMA" """,
    "latest_state_balance": _BALANCES + """
, totals AS (
  SELECT "SG_UF" AS code, "ME_REFERENCIA" AS m,
         sum("VL_SALDO_CONTA" + "VL_SALDO_FUNDOS" + "VL_SALDO_POUPANCA" + "VL_SALDO_RDB") AS v
  FROM balances GROUP BY 1, 2)
SELECT t.code, round(t.v, 2) AS value FROM totals t
JOIN (SELECT code, max(m) AS m FROM totals GROUP BY code) l ON l.code = t.code AND l.m = t.m""",
    "monthly_series": _BALANCES + """
, months AS (
  SELECT cast(DATE '1995-01-01' + to_months(cast(i AS integer)) AS date) AS m
  FROM range(83) r(i))
SELECT cast(m AS varchar) AS "ME_REFERENCIA", round(s.total, 2) AS total_saldo
FROM months LEFT JOIN (
  SELECT "ME_REFERENCIA" AS k, sum("VL_SALDO_FUNDOS") AS total FROM balances
  WHERE "SG_UF" = 'NATION_7' AND "DS_PROGRAMA" = 'ECONOMY' GROUP BY 1) s ON s.k = m""",
    "state_mean_series": _BALANCES + """
SELECT cast("ME_REFERENCIA" AS varchar) AS "ME_REFERENCIA",
       round(max(media), 6) AS saldo_fundos
FROM (SELECT "ME_REFERENCIA", avg("VL_SALDO_FUNDOS") OVER (PARTITION BY "ME_REFERENCIA") AS media
      FROM balances WHERE "SG_UF" = 'NATION_7' AND "ME_REFERENCIA" >= DATE '1995-01-01') x
GROUP BY x."ME_REFERENCIA" """,
    "cascade_filter": _BALANCES + _BALANCE_ROW + """
WHERE "SG_UF" = 'NATION_7' AND "DS_PROGRAMA" IN ('ECONOMY', 'PROMO')
  AND balances."ME_REFERENCIA" BETWEEN DATE '1997-01-01' AND DATE '1999-12-01'""",
    "date_range_filter": _BALANCES + _BALANCE_ROW + """
WHERE year(balances."ME_REFERENCIA") >= 1998
  AND balances."ME_REFERENCIA" BETWEEN DATE '1998-03-01' AND DATE '2000-06-01'""",
    "project_columns": _BALANCES + """
SELECT "SG_UF", "DS_PROGRAMA", "VL_SALDO_CONTA" FROM balances""",
    "rename_positional": _BALANCES + """
SELECT "SG_UF" AS code, cast("ME_REFERENCIA" AS varchar) AS month,
       round(sum("VL_SALDO_CONTA"), 2) AS conta, round(sum("VL_SALDO_FUNDOS"), 2) AS fundos,
       round(sum("VL_SALDO_POUPANCA"), 2) AS poupanca, round(sum("VL_SALDO_RDB"), 2) AS rdb
FROM balances GROUP BY "SG_UF", "ME_REFERENCIA" """,
    "distinct_sorted": _BALANCES + """
SELECT DISTINCT "SG_UF", "DS_PROGRAMA" FROM balances ORDER BY 1, 2""",
    "account_balance_extract": """
WITH cc AS (
  SELECT DISTINCT l_suppkey, l_partkey, l_linenumber, l_orderkey, l_returnflag, l_linestatus
  FROM lineitem)
SELECT sc.l_suppkey AS nu_cnpj, sc.l_partkey AS nu_agencia,
       cast(sc.l_linenumber AS bigint) AS nu_banco, sc.l_orderkey AS nu_conta_corrente,
       sc.l_extendedprice AS vl_saldo_conta, '23400' || sc.l_orderkey AS nu_processo,
       cc.l_returnflag AS co_programa, 'Programa ' || pf.code AS ds_programa,
       e.s_name AS no_razao_social, n.n_name AS sg_uf, 'Status ' || scc.code AS no_st_conta,
       substr('23400.' || sc.l_orderkey, 1, 30) AS nu_processo_mask
FROM lineitem sc
JOIN cc ON sc.l_suppkey = cc.l_suppkey AND sc.l_partkey = cc.l_partkey
       AND sc.l_linenumber = cc.l_linenumber AND sc.l_orderkey = cc.l_orderkey
JOIN (SELECT DISTINCT l_returnflag AS code FROM lineitem) pv ON cc.l_returnflag = pv.code
JOIN (SELECT DISTINCT l_returnflag AS code FROM lineitem) pf ON cc.l_returnflag = pf.code
JOIN (SELECT DISTINCT l_linestatus AS code FROM lineitem) scc ON cc.l_linestatus = scc.code
JOIN supplier e ON cc.l_suppkey = e.s_suppkey
JOIN nation n ON e.s_nationkey = n.n_nationkey
WHERE sc.l_linenumber = 1 AND pv.code IN ('R')""",
}

# Portfolio ------------------------------------------------------------------

PORTFOLIO = """
portfolio AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 17 <> 0 THEN cast(floor(o_totalprice) AS bigint) % 730 END
           AS "DiasAtraso",
         CASE o_orderstatus WHEN 'O' THEN 'utilizacao' WHEN 'P' THEN 'liquidado'
              ELSE 'amortizacao' END AS "FaseSISFIES",
         CASE WHEN o_orderkey % 23 <> 0
              THEN substr('ACAPAMPARORRTOALBACEMAPBPEPIRNSEDFMTMSGORSSCPRSPMG',
                          1 + 2 * c_nationkey, 2) END AS "UfIES",
         cast(cast(o_orderdate AS date) + to_months(192) AS date) AS "DtAssinaturaContratoAF",
         cast(cast(o_orderdate AS date)
              + to_months(cast(192 - 12 * (10 + o_custkey % 75) AS integer)) AS date)
           AS "DtNascimento",
         lpad(cast(o_custkey % 120 AS varchar), 14, '0') AS "CnpjMant",
         CASE o_custkey % 8 WHEN 0 THEN 'administração de empresas' WHEN 1 THEN 'medicina'
              WHEN 2 THEN 'direito' WHEN 3 THEN 'letras - português' WHEN 4 THEN 'pedagogia'
              WHEN 5 THEN 'marketing' WHEN 6 THEN 'engenharia civil'
              ELSE 'curso ' || cast(o_custkey AS varchar) END AS "NomeCurso",
         cast(floor(o_totalprice / 20) AS bigint) AS "RendaFamiliarMensalBruta",
         cast(floor(o_totalprice / 25) AS bigint) AS "RendaPessoalMensalBruta",
         o_totalprice / 4 AS "ValorFinanciadoSISFIES",
         CASE WHEN o_orderkey % 6 <> 0 THEN cast(o_orderkey % 4000 AS double) END
           AS "ValorRendaComprovadaFiadores",
         cast(4 + o_orderkey % 9 AS double) AS "QtdeSemestreContratado",
         CASE WHEN o_orderkey % 3 = 0 THEN 650e0 ELSE 340e0 END AS "TaxaDeJuros",
         CASE WHEN o_orderkey % 2 = 0 THEN 10000e0 ELSE 7500e0 END AS "PercentualFinanciado",
         CASE o_orderkey % 5 WHEN 0 THEN 'FIANCA CONVENCIONAL+FGEDUC' WHEN 1 THEN ''
              WHEN 2 THEN 'SEM FIAN?' WHEN 3 THEN 'FGEDUC' END AS "TipoGarantia",
         CASE o_orderkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' ELSE 'P' END
           AS "CursouEnsinoMedioEscolaPublica",
         CASE o_orderkey % 4 WHEN 0 THEN 'INTEGRAL' WHEN 1 THEN NULL ELSE 'NOTURNO' END
           AS "NomeTurno",
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Solteiro'
              ELSE 'Casado' END AS "EstadoCivil",
         CASE WHEN o_orderkey % 11 = 0 THEN 'S         ' ELSE 'N         ' END AS "Deficiente"
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

AGED = """
aged AS (
  SELECT *, cast(floor(date_diff('day', "DtNascimento", "DtAssinaturaContratoAF") / 365.25e0)
                 AS bigint) AS idade
  FROM portfolio)"""

SPONSORS = """
sponsors AS (
  SELECT lpad(cast(s_suppkey AS varchar), 14, '0') AS cnpj,
         CASE s_suppkey % 3 WHEN 0 THEN 'GM' WHEN 1 THEN 'P' ELSE 'M' END AS "Porte",
         cast(10 * s_suppkey AS double) AS qtd_alunos
  FROM supplier)"""

COURSES = """
courses AS (
  SELECT upper("NomeCurso") AS nome, cast(1 + length("NomeCurso") % 7 AS varchar) AS "CodCurso"
  FROM (SELECT DISTINCT "NomeCurso" FROM portfolio) x
  WHERE "NomeCurso" <> 'marketing')"""


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join("'" + name + "'" for name in names)


def _lookup(column: str, groups: dict[str, tuple[str, ...]], otherwise: str) -> str:
    branches = " ".join(
        f"WHEN {column} IN ({_quoted(names)}) THEN '{group}'" for group, names in groups.items()
    )
    return f"CASE {branches} ELSE {otherwise} END"


_REGION = _lookup('"UfIES"', d.STATE_REGIONS, "'Sudeste'")
_CANONICAL = _lookup('upper("NomeCurso")', d.COURSE_ALIASES, 'upper("NomeCurso")')
_GROUP = _lookup("novo_curso", d.COURSE_GROUPS, "'grupom'")

NAMED = f"""
named AS (SELECT id, {_CANONICAL} AS nome_curso_cat FROM portfolio),
counted AS (SELECT nome_curso_cat, count(*) AS n FROM named GROUP BY 1),
pooled AS (
  SELECT nome_curso_cat, n, CASE WHEN n < 100 THEN 'OUTROS' ELSE nome_curso_cat END AS novo_curso
  FROM counted)"""

KEPT = f"""
kept AS (
  SELECT a.*, s."Porte", c."CodCurso", {_CANONICAL} AS nome_curso_cat
  FROM aged a
  LEFT JOIN sponsors s ON a."CnpjMant" = s.cnpj
  LEFT JOIN courses c ON upper(a."NomeCurso") = c.nome
  WHERE "RendaFamiliarMensalBruta" <= 20000 AND "RendaPessoalMensalBruta" <= 20000
    AND idade > 15 AND idade <= 80),
kept_counts AS (SELECT nome_curso_cat, count(*) AS n FROM kept GROUP BY 1),
grouped AS (
  SELECT k.*, CASE WHEN c.n < 100 THEN 'OUTROS' ELSE k.nome_curso_cat END AS novo_curso
  FROM kept k JOIN kept_counts c ON k.nome_curso_cat = c.nome_curso_cat)"""

_PORTFOLIO = _with(PORTFOLIO)
_AGED = _with(PORTFOLIO, AGED)
_NAMED = _with(PORTFOLIO, NAMED)

CREDIT = {
    "scan_phase_filter": _PORTFOLIO + """
SELECT id, "FaseSISFIES", "DiasAtraso" FROM portfolio
WHERE "FaseSISFIES" IN ('amortizacao', 'liquidado') AND "DiasAtraso" IS NOT NULL""",
    "drop_columns": _PORTFOLIO + """
SELECT id, "DiasAtraso", "UfIES", "NomeCurso", "RendaFamiliarMensalBruta",
       "RendaPessoalMensalBruta", "ValorFinanciadoSISFIES", "ValorRendaComprovadaFiadores",
       "QtdeSemestreContratado", "TaxaDeJuros", "PercentualFinanciado", "TipoGarantia",
       "CursouEnsinoMedioEscolaPublica", "NomeTurno", "EstadoCivil", "Deficiente"
FROM portfolio""",
    "outlier_filter": _AGED + """
SELECT id, idade, "RendaFamiliarMensalBruta", "RendaPessoalMensalBruta" FROM aged
WHERE "RendaFamiliarMensalBruta" <= 20000 AND "RendaPessoalMensalBruta" <= 20000
  AND idade > 15 AND idade <= 80""",
    "drop_null_rows": _PORTFOLIO + """
SELECT id, "DiasAtraso" FROM portfolio WHERE "DiasAtraso" IS NOT NULL""",
    "masked_update": _PORTFOLIO + """
SELECT id, CASE WHEN "CursouEnsinoMedioEscolaPublica" = 'P' THEN 'S'
                ELSE "CursouEnsinoMedioEscolaPublica" END AS "CursouEnsinoMedioEscolaPublica"
FROM portfolio""",
    "fill_nulls": _PORTFOLIO + """
SELECT id, coalesce("DiasAtraso", 0) AS "DiasAtraso",
       coalesce("ValorRendaComprovadaFiadores", 0e0) AS "ValorRendaComprovadaFiadores",
       coalesce("UfIES", '') AS "UfIES", "NomeTurno" FROM portfolio""",
    "batch_cast": _PORTFOLIO + """
SELECT id, try_cast("CnpjMant" AS double) AS "CnpjMant",
       try_cast(coalesce("UfIES", "CnpjMant") AS double) AS texto FROM portfolio""",
    "age_years": _AGED + "SELECT id, idade FROM aged",
    "default_flag": _PORTFOLIO + """
SELECT id, cast(CASE WHEN "DiasAtraso" > 365 THEN 1 WHEN "DiasAtraso" <= 365 THEN 0 END AS bigint)
         AS resposta FROM portfolio""",
    "region_map": _PORTFOLIO + f'SELECT id, {_REGION} AS "Regiao_UF" FROM portfolio',
    "sponsor_join": _with(PORTFOLIO, SPONSORS) + """
SELECT id, "CnpjMant", "Porte", qtd_alunos
FROM portfolio LEFT JOIN sponsors ON "CnpjMant" = cnpj""",
    "course_code_join": _with(PORTFOLIO, COURSES) + """
SELECT id, upper("NomeCurso") AS "NomeCurso", "CodCurso"
FROM portfolio LEFT JOIN courses ON upper("NomeCurso") = nome""",
    "canonical_category": _NAMED + "SELECT id, nome_curso_cat FROM named",
    "rare_category": _NAMED + "SELECT nome_curso_cat, n, novo_curso FROM pooled",
    "category_group": _NAMED + f"""
SELECT id, named.nome_curso_cat, novo_curso, {_GROUP} AS novo_curso2
FROM named JOIN pooled ON named.nome_curso_cat = pooled.nome_curso_cat""",
    "feature_buckets": _with(PORTFOLIO, AGED, SPONSORS, COURSES, KEPT) + f"""
SELECT id,
  cast(CASE WHEN "DiasAtraso" > 365 THEN 1 WHEN "DiasAtraso" <= 365 THEN 0 END AS bigint)
    AS resposta,
  {_GROUP} AS novo_curso2,
  CASE WHEN "QtdeSemestreContratado" BETWEEN 0 AND 9 THEN 'a' ELSE 'b' END AS qtdsemestre_cat,
  CASE WHEN "RendaFamiliarMensalBruta" <= 1000 THEN 'a'
       WHEN "RendaFamiliarMensalBruta" <= 2000 THEN 'b' ELSE 'c' END
    AS rendafamiliarmensalbruta_cat,
  CASE WHEN "RendaPessoalMensalBruta" <= 2000 THEN 'a'
       WHEN "RendaPessoalMensalBruta" <= 3000 THEN 'b' ELSE 'c' END
    AS rendapessoalmensalbruta_cat,
  CASE WHEN "ValorFinanciadoSISFIES" <= 80000 THEN 'a' ELSE 'b' END AS valorfinaciados_cat,
  CASE WHEN "ValorRendaComprovadaFiadores" IS NULL THEN 'a'
       WHEN "ValorRendaComprovadaFiadores" <= 1500 THEN 'b'
       WHEN "ValorRendaComprovadaFiadores" <= 2500 THEN 'c' ELSE 'd' END
    AS valorrendafiadoress_cat,
  CASE WHEN idade <= 20 THEN 'b' ELSE 'a' END AS idade_cat,
  CASE WHEN "TaxaDeJuros" = 650 THEN 'b' ELSE 'a' END AS taxadejuros_cat,
  CASE WHEN "TipoGarantia" IS NULL THEN NULL
       WHEN "TipoGarantia" = 'FIANCA CONVENCIONAL+FGEDUC' THEN 'd'
       WHEN "TipoGarantia" = '' THEN 'b' WHEN "TipoGarantia" = 'SEM FIAN?' THEN 'c'
       ELSE 'a' END AS garantia_cat,
  CASE WHEN "NomeTurno" = 'INTEGRAL' THEN 'b' ELSE 'a' END AS turno_cat,
  CASE {_REGION} WHEN 'Sul' THEN 'c' WHEN 'Norte' THEN 'a' ELSE 'b' END AS ufies_cat,
  CASE WHEN "EstadoCivil" = 'Solteiro' THEN 'b' WHEN "EstadoCivil" IS NOT NULL THEN 'a' END
    AS estadocivil_cat,
  CASE WHEN "CodCurso" IN ('5', '6') THEN 'c' WHEN "CodCurso" IN ('4', '7') THEN 'b'
       ELSE 'a' END AS curso_cat,
  CASE WHEN "PercentualFinanciado" = 10000 THEN 'a' ELSE 'b' END AS percentual_cat,
  CASE WHEN "Porte" = 'GM' THEN 'GM' WHEN "Porte" IS NOT NULL THEN 'PMM' END AS porte_cat,
  CASE WHEN "CursouEnsinoMedioEscolaPublica" = 'N' THEN 'b' ELSE 'a' END AS escola_cat,
  CASE WHEN rtrim("Deficiente") = 'N' THEN 'a' ELSE 'b' END AS deficiente_cat
FROM grouped""",
    "duplicate_names": _PORTFOLIO + """
SELECT "CnpjMant", count(*) AS n FROM portfolio GROUP BY 1 HAVING count(*) > 1""",
    "read_delim_ptbr": _PORTFOLIO + """
SELECT id, "CnpjMant", cast("DtNascimento" AS varchar) AS "DtNascimento", "DiasAtraso",
       round("ValorFinanciadoSISFIES", 4) AS "ValorFinanciadoSISFIES", "TipoGarantia"
FROM portfolio""",
    "read_delim_rejects": _PORTFOLIO + """
, lines AS (
  SELECT *, CASE WHEN id % 11 = 0 THEN 'n' || id ELSE cast(id AS varchar) END AS line_id
  FROM portfolio)
SELECT line_id, 'id' AS "column", line_id AS value, 'not bigint' AS reason FROM lines WHERE id % 11 = 0
UNION ALL
SELECT line_id, 'DtNascimento', '31/02/1990', 'not date' FROM lines WHERE id % 7 = 0
UNION ALL
SELECT line_id, 'ValorFinanciadoSISFIES', 'muito', 'not decimal(20,5)'
FROM lines WHERE id % 13 = 0 AND id % 5 <> 0""",
    "read_delim_accepted": _PORTFOLIO + """
SELECT id, cast("DtNascimento" AS varchar) AS "DtNascimento",
       CASE WHEN id % 5 <> 0 THEN round("ValorFinanciadoSISFIES", 4) END AS "ValorFinanciadoSISFIES",
       CASE WHEN id % 3 <> 0 THEN "TipoGarantia" END AS "TipoGarantia"
FROM portfolio
WHERE id % 11 <> 0 AND id % 7 <> 0 AND NOT (id % 13 = 0 AND id % 5 <> 0)""",
    "read_delim_latin1": _PORTFOLIO + """
SELECT id, "NomeCurso", cast("DtNascimento" AS varchar) AS "DtNascimento" FROM portfolio""",
    "bootstrap_sample": _PORTFOLIO + """
, indexed AS (
  SELECT id, "DiasAtraso", row_number() OVER (ORDER BY md5(cast(id AS varchar) || ':42'), id)
           AS row_index
  FROM portfolio),
size AS (SELECT count(*) AS n FROM portfolio),
draws AS (
  SELECT i AS draw,
         cast('0x' || substr(md5(cast(i AS varchar) || ':42'), 1, 15) AS bigint) % n + 1 AS pick
  FROM size, range(1, (SELECT n + 1 FROM size)) r(i))
SELECT draw, row_index, id, "DiasAtraso" FROM draws JOIN indexed ON pick = row_index""",
    "train_test_split": _PORTFOLIO + """
, ranked AS (
  SELECT id, row_number() OVER (ORDER BY md5(cast(id AS varchar) || ':42'), id) AS k,
         count(*) OVER () AS n
  FROM portfolio)
SELECT id, CASE WHEN k <= n * 30 // 100 THEN 'test' ELSE 'train' END AS part FROM ranked""",
}

PROVISIONING["interval_lookup"] = """
WITH periods AS (
  SELECT o_custkey, o_orderkey,
         coalesce(CASE WHEN o_orderkey % 31 <> 0 THEN cast(o_orderdate AS date) END, DATE '0001-01-01') AS begins,
         CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN DATE '9999-12-31'
              ELSE cast(o_orderdate AS date) + cast(o_orderkey * 37 % 700 - 30 AS integer) END AS ends
  FROM orders),
points AS (
  SELECT o_custkey, o_orderkey AS id, cast(o_orderdate AS date) + 45 AS asked FROM orders),
hits AS (
  SELECT p.id, q.o_orderkey,
         row_number() OVER (PARTITION BY p.id ORDER BY q.begins, q.o_orderkey) AS k
  FROM points p JOIN periods q ON p.o_custkey = q.o_custkey AND p.asked BETWEEN q.begins AND q.ends)
SELECT o_custkey, p.id, cast(asked AS varchar) AS asked, h.o_orderkey
FROM points p LEFT JOIN hits h ON h.id = p.id AND k = 1"""

PROVISIONING["interval_sweep"] = """
WITH periods AS (
  SELECT o_orderkey * 4 AS low, o_orderkey * 4 + o_custkey % 9 - 1 AS high, o_orderkey FROM orders),
points AS (
  SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber,
         l_orderkey * 4 + l_linenumber - 2 AS place
  FROM lineitem),
hits AS (
  SELECT p.l_orderkey, p.l_linenumber, min_by(q.o_orderkey, q.low) AS o_orderkey
  FROM points p JOIN periods q ON q.low BETWEEN p.place - 8 AND p.place AND p.place BETWEEN q.low AND q.high
  GROUP BY 1, 2)
SELECT p.*, h.o_orderkey FROM points p LEFT JOIN hits h USING (l_orderkey, l_linenumber)"""

# By the likelihood equations, a fit's scores add up to the observed defaults of each level.
_TRAIN = f"""
WITH buckets AS ({CREDIT["feature_buckets"]}),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(cast(id AS varchar) || ':42'), id) AS k,
         count(*) OVER () AS n
  FROM buckets),
train AS (
  SELECT *, taxadejuros_cat AS rate_copy, CASE WHEN ufies_cat = 'c' THEN 'y' ELSE 'n' END AS south
  FROM ranked
  WHERE k > n * 30 // 100 AND resposta IS NOT NULL
    AND {" AND ".join(f"{p} IS NOT NULL" for p in d.FINAL_PREDICTORS)})"""


def _balance(predictors: tuple[str, ...]) -> str:
    return _TRAIN + f"""
SELECT predictor, level, count(*) AS contracts, cast(sum(resposta) AS double) AS score_sum
FROM train, LATERAL (VALUES {", ".join(f"('{p}', {p})" for p in predictors)}) v(predictor, level)
GROUP BY 1, 2"""


CREDIT["score_balance"] = _balance(d.FINAL_PREDICTORS)
CREDIT["score_balance_copies"] = _balance((*d.FINAL_PREDICTORS, "rate_copy", "south"))

# Files, text and dates of the source tables ---------------------------------

PLAIN = {
    "read_regimes": """
SELECT cast(cast(o_orderdate AS date) AS varchar) AS inicio,
       cast(cast(cast(o_orderdate AS date) + to_months(6) AS date) AS varchar) AS fim,
       cast(o_orderkey AS varchar) AS tipo_regencia, (o_custkey % 100) / 10e0 AS tx_juros,
       cast(3 AS bigint) AS carencia, '3*qtd_sem_contratado' AS amortizacao,
       cast(100 AS bigint) AS pgto_juros, o_custkey % 100 AS percent_garantia
FROM orders""",
    "read_csv_drop_index": _with(CONTRACTS) + """
SELECT cast(cpf AS varchar) AS cpf,
       cast(dt_assinatura_contrato AS varchar) AS dt_assinatura_contrato, fase, tx_juros
FROM contracts""",
    "table_columns": "SELECT c_custkey, c_name FROM customer",
    "string_slice": """
SELECT o_orderkey, substr(o_orderpriority, 3, 3) AS piece,
       substr(o_orderpriority, length(o_orderpriority) - 1, 1) AS before_last,
       length(o_orderpriority) AS size
FROM orders""",
    "mask_identifier": """
SELECT o_orderkey,
       substr(lpad(cast(o_orderkey AS varchar), 11, '0'), 1, 5) || '.'
       || substr(lpad(cast(o_orderkey AS varchar), 11, '0'), 6, 6) || '/2018' AS masked
FROM orders""",
    "latin1_encode": r"""
SELECT doc_id, length(text) AS n_characters,
       CASE WHEN NOT regexp_matches(text, '[^\x00-\xFF]') THEN length(text) END AS n_bytes
FROM documents""",
    "parse_dates": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 13 <> 0 THEN cast(cast(o_orderdate AS date) AS varchar) END AS day
FROM orders""",
    "rescale_censor": """
SELECT c_name AS municipio,
       CASE WHEN v BETWEEN 3300 AND 3750 THEN round((v - 3300e0) / 450e0, 6) END AS fill
FROM (SELECT c_name, 3250e0 + c_custkey % 600 AS v FROM customer) x""",
    "sample_n": """
WITH sizes AS (
  SELECT replace(p_type, ' ', '-') AS category, replace(p_brand, ' ', '-') AS subcategory,
         pow(cast(count(*) AS double), 3) AS sales
  FROM part GROUP BY 1, 2)
SELECT * FROM sizes ORDER BY md5(category || '/' || subcategory || ':42') LIMIT 31""",
    "category_hierarchy": """
WITH sizes AS (
  SELECT replace(p_type, ' ', '-') AS category, replace(p_brand, ' ', '-') AS subcategory,
         pow(cast(count(*) AS double), 3) AS sales
  FROM part GROUP BY 1, 2)
SELECT category, subcategory, cast(grouping(category, subcategory) AS bigint) AS level,
       sum(sales) AS sales
FROM sizes GROUP BY ROLLUP (category, subcategory)""",
}


def _inner(pattern: str) -> str:
    """Text of what a pattern's first group takes from `page`: tags dropped, references decoded."""
    text = f"regexp_extract(page, '{pattern}', 1)"
    text = f"regexp_replace({text}, '(?i)<br\\s*/?>', ' ', 'g')"
    text = f"regexp_replace({text}, '<[/!?a-zA-Z][^>]*>', '', 'g')"
    for name, code in (("copy", 169), ("middot", 183), ("nbsp", 160), ("quot", 34), ("lt", 60), ("gt", 62), ("amp", 38)):
        text = f"replace({text}, '&{name};', chr({code}))"
    return text


_CLOSING = "p|div|ul|ol|dl|table|pre|form|hr|blockquote|article|section|aside|header|footer|nav|main|body|html|h[1-6]"
PAGE_TEXTS = rf"""
cleaned AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?s)<script[\s>].*?</script>', '', 'g'), '(?s)<style[\s>].*?</style>', '', 'g') AS page
  FROM pages),
page_texts AS (
  SELECT *, {_inner("(?is)<title[^>]*>(.*?)</title>")} AS title,
         {_inner(f"(?is)<p(?:[ \n][^>]*)?>(.*?)(?:</?(?:{_CLOSING})[ />]|$)")} AS summary
  FROM cleaned)"""

PLAIN["page_fields"] = _with(PAGE_TEXTS) + "SELECT page_id, title, summary, url AS href FROM page_texts"

# Statistics -----------------------------------------------------------------

SCORED = """
scored AS (
  SELECT doc_id, doc_id % 2 AS y,
         CASE WHEN doc_id % 19 <> 0 THEN round((n_chars % 97) / 97e0, 2) END AS p
  FROM documents),
counts AS (
  SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
  FROM scored WHERE p IS NOT NULL GROUP BY p),
sizes AS (SELECT cast(sum(pos) AS double) AS n1, cast(sum(neg) AS double) AS n0 FROM counts),
classed AS (
  SELECT *, cast(CASE WHEN p <= 0.35e0 THEN 0 WHEN p > 0.35e0 THEN 1 END AS bigint) AS p_class
  FROM scored),
cells AS (
  SELECT count(*) FILTER (p_class = 1 AND y = 1) AS tp, count(*) FILTER (p_class = 1 AND y = 0) AS fp,
         count(*) FILTER (p_class = 0 AND y = 1) AS fn, count(*) FILTER (p_class = 0 AND y = 0) AS tn
  FROM classed)"""

_SCORED = _with(SCORED)

STATISTICS = {
    "roc_curve": _SCORED + """
SELECT p AS cutoff,
       round(sum(pos) OVER (ORDER BY p DESC) / n1, 9) AS tpr,
       round(sum(neg) OVER (ORDER BY p DESC) / n0, 9) AS fpr
FROM counts, sizes
UNION ALL SELECT 9e0, 0e0, 0e0""",
    "auc": _SCORED + """
SELECT round(sum(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0e0 END)
             / max(n1 * n0), 9) AS auc
FROM (SELECT p FROM scored WHERE y = 1 AND p IS NOT NULL) a,
     (SELECT p FROM scored WHERE y = 0 AND p IS NOT NULL) b, sizes""",
    "ks_two_sample": _SCORED + """
, gaps AS (
  SELECT max(abs(f1 - f0)) AS d FROM (
    SELECT sum(pos) OVER (ORDER BY p) / n1 AS f1, sum(neg) OVER (ORDER BY p) / n0 AS f0
    FROM counts, sizes) x),
tail AS (SELECT n1, n0, d, n1 * n0 / (n1 + n0) * d * d AS z2 FROM gaps, sizes)
SELECT cast(n1 AS bigint) AS n1, cast(n0 AS bigint) AS n0, round(d, 9) AS d,
       round(CASE WHEN sqrt(z2) < 0.2 THEN 1e0 ELSE (
         SELECT least(1e0, greatest(0e0,
           sum(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * z2))))
         FROM range(1, 101) r(k)) END, 9) AS p_value
FROM tail""",
    "threshold_class": _SCORED + "SELECT doc_id, p, p_class FROM classed",
    "confusion_matrix": _SCORED.replace("WITH", "WITH RECURSIVE", 1) + """
, x AS (SELECT *, cast(tp + fp + fn + tn AS double) AS n FROM cells),
y AS (SELECT *, (tp + tn) / n AS acc, tp + tn AS hits, greatest(tp + fn, fp + tn) / n AS nir,
             pow(greatest(abs(fp - fn) - 1, 0), 2) / cast(fp + fn AS double) / 2 AS half,
             ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n) AS pe FROM x),
ways AS (
  SELECT cast(k AS double) AS k, n, hits,
         lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) AS w
  FROM y, range(0, 1 + cast(n AS bigint)) r(k)),
bounds AS (
  SELECT 0 AS i, 0e0 AS low_l, 1e0 AS low_h, 0e0 AS up_l, 1e0 AS up_h
  UNION ALL
  SELECT i + 1,
         CASE WHEN a < 0.025e0 THEN (low_l + low_h) / 2 ELSE low_l END,
         CASE WHEN a < 0.025e0 THEN low_h ELSE (low_l + low_h) / 2 END,
         CASE WHEN b > 0.025e0 THEN (up_l + up_h) / 2 ELSE up_l END,
         CASE WHEN b > 0.025e0 THEN up_h ELSE (up_l + up_h) / 2 END
  FROM (
    SELECT i, low_l, low_h, up_l, up_h,
           sum(CASE WHEN k >= hits THEN exp(w + k * ln((low_l + low_h) / 2)
             + (n - k) * ln(1 - (low_l + low_h) / 2)) ELSE 0e0 END) AS a,
           sum(CASE WHEN k <= hits THEN exp(w + k * ln((up_l + up_h) / 2)
             + (n - k) * ln(1 - (up_l + up_h) / 2)) ELSE 0e0 END) AS b
    FROM bounds, ways WHERE i < 45 GROUP BY ALL) step)
SELECT tp, fp, fn, tn, round(acc, 9) AS accuracy,
       round(CASE WHEN hits = 0 THEN 0e0 ELSE low_l END, 9) AS accuracy_lower,
       round(CASE WHEN hits = n THEN 1e0 ELSE up_l END, 9) AS accuracy_upper,
       round((SELECT sum(exp(w + k * ln(nir) + (ways.n - k) * ln(1 - nir)))
              FROM ways WHERE k >= ways.hits), 9) AS accuracy_p_value,
       round(1 - (SELECT sum(exp((m + 0.5e0) * ln(half) - half - lgamma(m + 1.5e0)))
                  FROM range(0, 2000) q(m)), 9) AS mcnemar_p_value,
       round(nir, 9) AS no_information_rate,
       round((acc - pe) / (1 - pe), 9) AS kappa,
       round(pow(greatest(abs(fp - fn) - 1, 0), 2) / cast(fp + fn AS double), 9) AS mcnemar_chi2,
       round(tp / cast(tp + fn AS double), 9) AS sensitivity,
       round(tn / cast(tn + fp AS double), 9) AS specificity,
       round(tp / cast(tp + fp AS double), 9) AS pos_pred_value,
       round(tn / cast(tn + fn AS double), 9) AS neg_pred_value,
       round((tp + fn) / n, 9) AS prevalence, round(tp / n, 9) AS detection_rate,
       round((tp + fp) / n, 9) AS detection_prevalence,
       round((tp / cast(tp + fn AS double) + tn / cast(tn + fp AS double)) / 2, 9)
         AS balanced_accuracy
FROM y, (SELECT * FROM bounds ORDER BY i DESC LIMIT 1) last""",
    "contingency_table": _SCORED + """
SELECT p_class, count(*) FILTER (y = 0) AS actual_0, count(*) FILTER (y = 1) AS actual_1
FROM classed WHERE p_class IS NOT NULL GROUP BY p_class""",
    "percent_table": _SCORED + """
SELECT p_class, round(100e0 * count(*) / sum(count(*)) OVER (), 9) AS percent
FROM classed WHERE p_class IS NOT NULL GROUP BY p_class""",
}

# Digest ---------------------------------------------------------------------

FOUND = """
keywords(k_order, keyword) AS (VALUES (1, 'the'), (2, 'que'), (3, 'und'), (4, 'zzzquux')),
found AS (
  SELECT keyword, k_order, doc_id, lang, source
  FROM documents JOIN keywords ON contains(lower(text), keyword)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY doc_id) AS position FROM found),
shown AS (SELECT * FROM ranked WHERE position <= 5)"""

PAGES = PAGE_TEXTS + """,
keywords(k_order, keyword) AS (VALUES (1, 'the'), (2, 'que'), (3, 'und'), (4, 'zzzquux')),
hits AS (
  SELECT keyword, page_id, url, title, summary,
         row_number() OVER (PARTITION BY keyword ORDER BY page_id) AS position
  FROM page_texts JOIN keywords ON contains(lower(html), keyword)),
shown AS (SELECT * FROM hits WHERE position <= 3)"""

_FOUND = _with(FOUND)
_PAGES = _with(PAGES)

DIGEST = {
    "programme_digest": _PAGES + """
, blocks AS (
  SELECT keyword, string_agg(chr(10) || keyword || ' - ' || title || chr(10) || chr(10) || '* '
                             || url || chr(10), '' ORDER BY position) AS block
  FROM shown GROUP BY keyword)
SELECT cast(k_order AS bigint) AS keyword_order, k.keyword,
       CASE WHEN k_order = 1 THEN 'Portarias, Resoluções publicadas' || chr(10) ELSE '' END
         AS header,
       coalesce(block, chr(10) || k.keyword || ' - Não foram encontrados resultados que '
                       || 'contenham as palavras-chave' || chr(10)) AS body
FROM keywords k LEFT JOIN blocks b ON b.keyword = k.keyword""",
    "word_digest": _PAGES + """
SELECT 'Diário Oficial da União - 30 November 2018' || chr(10) || chr(10)
       || 'Portarias, Resoluções publicadas' || chr(10) || chr(10)
       || string_agg(chr(10) || chr(10) || ' *' || title || chr(10) || chr(10) || summary
                     || chr(10) || chr(10) || 'Link - ' || url, '' ORDER BY position) AS body
FROM shown WHERE keyword = 'que'""",
    "keyword_search": _FOUND + """
SELECT k.keyword, count(doc_id) AS n_results
FROM keywords k LEFT JOIN found f ON f.keyword = k.keyword GROUP BY k.keyword""",
    "keyword_table_search": """
WITH keywords AS (
  SELECT DISTINCT keyword FROM (
    SELECT substr(text, 1, 14) AS keyword FROM benchmark
    UNION ALL SELECT p_brand FROM part UNION ALL SELECT lang FROM documents) x
  WHERE length(keyword) > 0)
SELECT keyword, count(doc_id) AS n_results
FROM keywords LEFT JOIN documents ON contains(lower(text), lower(keyword)) GROUP BY keyword""",
    "keyword_matches": _FOUND + "SELECT keyword, doc_id FROM found",
    "keyword_no_match": _FOUND + """
SELECT keyword, 'Não foram encontrados resultados que contenham as palavras-chave' AS message
FROM keywords WHERE keyword NOT IN (SELECT keyword FROM found)""",
    "keyword_topn": _FOUND + "SELECT keyword, position, doc_id FROM shown",
    "keyword_digest": _FOUND + """
, blocks AS (
  SELECT keyword, string_agg(chr(10) || keyword || ' - Documento ' || doc_id || chr(10) || chr(10)
                             || '* ' || source || chr(10), '' ORDER BY position) AS block
  FROM shown GROUP BY keyword)
SELECT cast(k_order AS bigint) AS keyword_order, k.keyword,
       CASE WHEN k_order = 1 THEN 'Portarias, Resoluções publicadas' || chr(10) ELSE '' END
         AS header,
       coalesce(block, chr(10) || k.keyword || ' - Não foram encontrados resultados que '
                       || 'contenham as palavras-chave' || chr(10)) AS body
FROM keywords k LEFT JOIN blocks b ON b.keyword = k.keyword""",
    "single_digest": _FOUND + """
SELECT 'Diário Oficial da União - 30 November 2018' || chr(10) || chr(10)
       || 'Portarias, Resoluções publicadas' || chr(10) || chr(10)
       || string_agg(chr(10) || chr(10) || ' *Documento ' || doc_id || chr(10) || chr(10) || lang
                     || chr(10) || chr(10) || 'Link - ' || source, '' ORDER BY position) AS body
FROM shown WHERE keyword = 'the'""",
}

# Geography ------------------------------------------------------------------

PLACES = """
amounts AS (
  SELECT c_name AS municipio, 3250e0 + c_custkey % 600 AS valor_atual,
         3280e0 + c_custkey % 550 AS valor_proposto
  FROM customer),
codes AS (
  SELECT c_name AS nome, 1000000 + c_custkey AS code, cast(n_regionkey AS bigint) AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
valued AS (SELECT a.*, c.code FROM amounts a LEFT JOIN codes c ON a.municipio = c.nome)"""

_PLACES = _with(PLACES)

GEOGRAPHY = {
    "municipal_value_join": _PLACES + """
SELECT municipio, valor_atual, valor_proposto, code AS "Codigo_IBGE" FROM valued""",
    "region_filter": _PLACES + """
SELECT nome AS "Nome_Municipio", code AS "Codigo_IBGE", region AS "Region"
FROM codes WHERE region IN (1, 2)""",
    "choropleth_join": _PLACES + """
, mapped AS (
  SELECT c.code AS "City", c.region AS "Region", v.valor_atual, v.valor_proposto
  FROM codes c LEFT JOIN valued v ON v.code = c.code WHERE c.region IN (1, 2))
SELECT "City", "Region", 'valor_atual' AS measure, valor_atual AS value FROM mapped
UNION ALL
SELECT "City", "Region", 'valor_proposto', valor_proposto FROM mapped""",
    "polygon_vertices": """
SELECT 1000000 + vec_id AS "City", vec_id % 5 AS "Region", cast(i AS bigint) AS "order",
       round(cast(embedding[2 * i - 1] AS double), 6) AS long,
       round(cast(embedding[2 * i] AS double), 6) AS lat
FROM embeddings, range(1, 33) r(i)""",
}

ORACLES: dict[str, str] = {
    **PROVISIONING,
    **BALANCE,
    **CREDIT,
    **PLAIN,
    **STATISTICS,
    **DIGEST,
    **GEOGRAPHY,
}
