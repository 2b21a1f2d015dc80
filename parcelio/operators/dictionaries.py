"""Fixed lookup values of the credit features."""

# Federal states by region; every other state is Sudeste.
STATE_REGIONS = {
    "Norte": ("AC", "AP", "AM", "PA", "RO", "RR", "TO"),
    "Nordeste": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "Centro-Oeste": ("DF", "MT", "MS", "GO"),
    "Sul": ("RS", "SC", "PR"),
}
OTHER_REGION = "Sudeste"

# Course names that are rewritten to a common name.
COURSE_ALIASES = {
    "ADMINISTRAÇÃO": ("ADMINISTRAÇÃO DE EMPRESAS",),
    "DESIGN DE MODA": ("DESIGN DE MODA - ESTILISMO",),
    "ENGENHARIA AMBIENTAL": ("ENGENHARIA AMBIENTAL E SANITÁRIA",),
    "ENGENHARIA DE PETRÓLEO": ("ENGENHARIA DE PETRÓLEO E GÁS",),
    "ENGENHARIA ELÉTRICA": ("ENGENHARIA ELÉTRICA E ELETRÔNICA",),
    "ENGENHARIA MECÂNICA": ("ENGENHARIA INDUSTRIAL MECÂNICA",),
    "ESTÉTICA": ("ESTÉTICA E COSMÉTICA", "ESTÉTICA E COSMETOLOGIA"),
    "MARKETING": ("MARKETING E PROPAGANDA",),
    "SISTEMAS DE INFORMAÇÃO": ("SISTEMA DE INFORMAÇÃO",),
    "COMUNICAÇÃO SOCIAL": (
        "COMUNICAÇÃO SOCIAL - JORNALISMO",
        "COMUNICAÇÃO SOCIAL - PUBLICIDADE E PROPAGANDA",
        "COMUNICAÇÃO SOCIAL - RADIO E TELEVISÃO",
    ),
    "LETRAS": (
        "LETRAS - LÍNGUA PORTUGUESA",
        "LETRAS - PORTUGUÊS",
        "LETRAS - PORTUGUÊS E INGLÊS",
    ),
}

# Courses below this count are pooled under one name.
RARE_LIMIT = 100
RARE_NAME = "OUTROS"

# Risk group of each course; every other course is grupom.
COURSE_GROUPS = {
    "grupoa": (
        "MEDICINA", "ENGENHARIA BIOMÉDICA", "ENGENHARIA METALÚRGICA",
        "ENGENHARIA DE TELECOMUNICAÇÕES", "ENGENHARIA ELETRÔNICA E DE TELECOMUNICAÇÕES",
    ),
    "grupoc": (
        "ODONTOLOGIA", "CIÊNCIAS ECONÔMICAS", "ENGENHARIA DE COMPUTAÇÃO",
        "DESIGN DE PRODUTO", "ENGENHARIA QUÍMICA", "QUÍMICA INDUSTRIAL",
        "ENGENHARIA DE MINAS",
    ),
    "grupod": (
        "RELAÇÕES PÚBLICAS", "ENGENHARIA AMBIENTAL", "RÁDIO, TV E INTERNET",
        "ENGENHARIA DE PRODUÇÃO MECÂNICA", "FARMÁCIA", "ENGENHARIA MECÂNICA",
        "ENGENHARIA CIVIL", "ENGENHARIA MECATRÔNICA", "ENGENHARIA AGRONÔMICA",
        "ARQUITETURA E URBANISMO", "ENGENHARIA ELÉTRICA", "ENGENHARIA DE ALIMENTOS",
        "MEDICINA VETERINÁRIA", "ENGENHARIA FLORESTAL", "FABRICAÇÃO MECÂNICA",
        "TERAPIA OCUPACIONAL", "RELAÇÕES INTERNACIONAIS", "AGRONOMIA",
        "CIÊNCIAS AERONÁUTICAS", "ENGENHARIA ELETRÔNICA", "AVIAÇÃO CIVIL",
    ),
    "grupoe": (
        "JOGOS DIGITAIS", "MANUTENÇÃO INDUSTRIAL", "PSICOLOGIA",
        "ENGENHARIA DE PRODUÇÃO", "ENGENHARIA DE CONTROLE E AUTOMAÇÃO",
        "ENGENHARIA DA COMPUTAÇÃO", "ENGENHARIA DE PETRÓLEO", "DESIGN",
        "ENGENHARIA", "DESENHO INDUSTRIAL", "ZOOTECNIA",
    ),
    "grupof": (
        "PRODUÇÃO MULTIMÍDIA", "BIOMEDICINA", "FARMÁCIA E BIOQUÍMICA",
        "CIÊNCIA DA COMPUTAÇÃO", "FÍSICA", "DIREITO", "MODA", "CIÊNCIAS SOCIAIS",
        "QUÍMICA", "FONOAUDIOLOGIA",
    ),
    "grupog": (
        "ARTES VISUAIS", "JORNALISMO", "CIÊNCIAS CONTÁBEIS", "PROCESSOS QUÍMICOS",
        "NUTRIÇÃO", "FISIOTERAPIA", "TEATRO", "SISTEMAS PARA INTERNET",
        "SECRETARIADO EXECUTIVO", "ENFERMAGEM", "COMUNICAÇÃO SOCIAL", "FILOSOFIA",
        "OUTROS", "PROPAGANDA E MARKETING", "SISTEMAS DE INFORMAÇÃO",
    ),
    "grupoh": (
        "LETRAS - INGLÊS", "TEOLOGIA", "GESTÃO PORTUÁRIA", "DESIGN GRÁFICO",
        "MATEMÁTICA", "ESTÉTICA", "ADMINISTRAÇÃO", "FOTOGRAFIA", "LETRAS - ESPANHOL",
        "CIÊNCIAS BIOLÓGICAS", "AUTOMAÇÃO INDUSTRIAL", "CINEMA E AUDIOVISUAL",
    ),
    "grupoi": (
        "PEDAGOGIA", "GESTÃO DE TURISMO", "SEGURANÇA DA INFORMAÇÃO",
        "DESIGN DE INTERIORES", "HISTÓRIA", "GESTÃO DA TECNOLOGIA DA INFORMAÇÃO",
        "GESTÃO DA PRODUÇÃO INDUSTRIAL", "GEOGRAFIA", "PUBLICIDADE E PROPAGANDA",
        "MECATRÔNICA INDUSTRIAL", "AGRONEGÓCIO", "MANUTENÇÃO DE AERONAVES",
        "SECRETARIADO", "EDUCAÇÃO FÍSICA", "GASTRONOMIA", "PRODUÇÃO FONOGRÁFICA",
        "ANÁLISE E DESENVOLVIMENTO DE SISTEMAS", "CONSTRUÇÃO DE EDIFÍCIOS",
        "LETRAS - PORTUGUÊS E ESPANHOL", "SERVIÇO SOCIAL", "COMÉRCIO EXTERIOR",
    ),
    "grupoj": (
        "PILOTAGEM PROFISSIONAL DE AERONAVES", "GESTÃO DA QUALIDADE",
        "REDES DE COMPUTADORES", "GESTÃO PÚBLICA", "GESTÃO FINANCEIRA", "COMPUTAÇÃO",
        "HOTELARIA", "DESIGN DE MODA",
    ),
    "grupok": (
        "PRODUÇÃO AUDIOVISUAL", "PETRÓLEO E GÁS", "LETRAS", "MÚSICA", "EVENTOS",
        "RADIOLOGIA", "GESTÃO COMERCIAL",
    ),
    "grupol": (
        "MARKETING", "GESTÃO DE SEGURANÇA PRIVADA", "LOGÍSTICA",
        "GESTÃO DE RECURSOS HUMANOS", "GESTÃO HOSPITALAR", "GESTÃO AMBIENTAL",
        "PROCESSOS GERENCIAIS", "PRODUÇÃO PUBLICITÁRIA", "TURISMO",
    ),
}
OTHER_GROUP = "grupom"

# Guarantee names. The source data holds some of them with a
# damaged last letter; both spellings are accepted.
GUARANTEE_D = ("FIANCA CONVENCIONAL+FGEDUC",)
GUARANTEE_B = ("", "FIAN? CONVENCIONAL", "FIANÇA CONVENCIONAL")
GUARANTEE_C = ("SEM FIAN?", "SEM FIANÇA")

# Contract phases that enter the credit model.
MODEL_PHASES = ("amortizacao", "liquidado")

# Portfolio columns the model does not use.
UNUSED_COLUMNS = (
    "CodigoBanco", "Cep", "CidadeAluno", "FaseBanco", "FaseSISFIES", "Risco",
    "NuSemestreReferencia", "SafraEntradaSISFIES", "SafraSaidaSISFIES", "SafraEntradaAF",
    "CodCurso", "CodTurno", "MunicipioIes", "CnpjIES", "CnpjMant", "Contagem",
    "DtNascimento", "DtAssinaturaContratoAF", "ValorDividaAF", "ValorLiberadoAF",
    "ValorRendaInformadaFiadores", "RendaPercapita", "ValorLiberadoSISFIES", "UfAluno",
    "ValorRendaComprometidaFiadores",
)

# Columns read as text and as numbers.
TEXT_COLUMNS = (
    "Banco", "Sexo", "CursouEnsinoMedioEscolaPublica", "Deficiente", "Prouni",
    "SituacaoInscricao", "NomeTurno", "UfIES", "TipoGarantia", "NomeCurso",
    "EstadoCivil", "resposta", "Porte",
)
NUMBER_COLUMNS = (
    "RendaFamiliarMensalBruta", "RendaPessoalMensalBruta", "ValorFinanciadoSISFIES",
    "ValorRendaComprovadaFiadores", "PercentualFinanciado", "QtdeSemestreContratado",
    "TaxaDeJuros", "idade", "QTD alunos por Mantenedora",
)

# Draws of the model sample, its test share and the cut-off.
SAMPLE_SIZE = 593_883
TEST_PERCENT = 30
CUT_OFF = 0.35

# Predictors of the full and of the final model.
FULL_PREDICTORS = (
    "qtdsemestre_cat", "rendafamiliarmensalbruta_cat", "rendapessoalmensalbruta_cat",
    "valorfinaciados_cat", "valorrendafiadoress_cat", "idade_cat", "taxadejuros_cat",
    "garantia_cat", "ufies_cat", "curso_cat", "percentual_cat", "porte_cat", "escola_cat",
    "novo_curso2",
)
FINAL_PREDICTORS = (
    "rendafamiliarmensalbruta_cat", "rendapessoalmensalbruta_cat", "valorfinaciados_cat",
    "valorrendafiadoress_cat", "taxadejuros_cat", "garantia_cat", "ufies_cat", "porte_cat",
    "escola_cat", "novo_curso2",
)
