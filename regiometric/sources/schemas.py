"""Schemas of the tables the package reads, as Spark DDL. Codes are text everywhere."""

RATES = "regiao_saude string, rate double"
HIERARCHY = (
    "cod_municipio string, cod_municipiodv string, municipio string, cod_regsaud string, regiao_saude string, "
    "cod_macrorregiao string, macrorregiao string, uf_sigla string, uf string, cod_uf string, regiao string, "
    "latitude string, longitude string"
)
POPULATION = "cod_regsaud string, populacao bigint"
ADMISSIONS = "ANO int, MUNIC_RES string, TOTAL bigint"
EDUCATION = (
    "ano int, curso string, chave_ies string, cod_regsaud string, regiao_saude string, uf_sigla string, "
    "qt_matricula_total bigint, qt_ingresso_total bigint, qt_vaga_total bigint, qt_inscrito_total bigint"
)
BEDS = "CODUFMUN string, COMPETEN string, CODLEITO string, QT_SUS int, QT_NSUS int"
BED_TOTALS = (
    "ano int, uf_sigla string, cod_regsaud string, regiao_saude string, quantidade_sus bigint, "
    "quantidade_nao_sus bigint"
)
ESTABLISHMENTS = "CODUFMUN string, COMPETEN string, TP_UNID string"
UNIT_TYPES = "`TIPO DE ESTABELECIMENTO` string, descricao_tratado string"
PROFESSIONALS = "COMPETEN string, CODUFMUN string, uf string, CPF_PROF string, CBO string, VINCULAC string"
BONDS = "CHAVE string, `DESCRIÇÃO` string"
DISTANCES = "cod_municipio string, km double, acesso_rodovia string"
DEATHS = "ano string, cod_regsaud string, obitos_ano bigint"
GDP = (
    "ano int, codigo_municipio string, produto_interno_bruto_precos_correntes_1000 double, amazonia_legal string, "
    "semiarido string"
)
DENSITY = "cod_uf string, UF string, `Razão` double"
COUNCIL = "uf_sigla string, profissionais string, qntd_profissionais bigint"
CENSUS = "UF string, populacao bigint"
