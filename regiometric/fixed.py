"""Codes, names and constants that the results depend on. Plain data, no logic."""

# The 27 states, code -> full name.
STATES = {
    "AC": "Acre",
    "AL": "Alagoas",
    "AP": "Amapá",
    "AM": "Amazonas",
    "BA": "Bahia",
    "CE": "Ceará",
    "DF": "Distrito Federal",
    "ES": "Espírito Santo",
    "GO": "Goiás",
    "MA": "Maranhão",
    "MT": "Mato Grosso",
    "MS": "Mato Grosso do Sul",
    "MG": "Minas Gerais",
    "PA": "Pará",
    "PB": "Paraíba",
    "PR": "Paraná",
    "PE": "Pernambuco",
    "PI": "Piauí",
    "RJ": "Rio de Janeiro",
    "RN": "Rio Grande do Norte",
    "RS": "Rio Grande do Sul",
    "RO": "Rondônia",
    "RR": "Roraima",
    "SC": "Santa Catarina",
    "SP": "São Paulo",
    "SE": "Sergipe",
    "TO": "Tocantins",
}
STATE_CODES = {name: code for code, name in STATES.items()}

# The state left out of some state-level statistics.
FEDERAL_DISTRICT = "Distrito Federal"
FEDERAL_DISTRICT_CODE = "DF"

# Macro-region -> position on the state charts, and the prefix cut from their labels.
MACRO_REGION_ORDER = {
    "Região Sul": 1,
    "Região Sudeste": 2,
    "Região Centro-Oeste": 3,
    "Região Norte": 4,
    "Região Nordeste": 5,
}
MACRO_REGION_PREFIX = "Região "

# 7-digit codes of the 27 capitals, ascending.
CAPITALS = (
    "1100205", "1200401", "1302603", "1400100", "1501402", "1600303", "1721000",
    "2111300", "2211001", "2304400", "2408102", "2507507", "2611606", "2704302", "2800308", "2927408",
    "3106200", "3205309", "3304557", "3550308",
    "4106902", "4205407", "4314902",
    "5002704", "5103403", "5208707", "5300108",
)

# Map viewport, coordinate system, colour limits and class width.
VIEW_LONGITUDE = (-75.0, -28.0)
VIEW_LATITUDE = (-33.0, 4.0)
SRID = 4326
COLOUR_LIMITS = (0.0, 1.0)
COLOUR_STEP = 0.25

# Municipality code standing for every Federal District code, and that district's prefix.
FEDERAL_DISTRICT_PREFIX = "53"
FEDERAL_DISTRICT_MUNICIPALITY = "530010"

# Occupation code prefix of nurses, course name, intensive-care bed codes.
NURSE_PREFIX = "2235"
NURSING_COURSE = "Enfermagem"
INTENSIVE_CARE_BEDS = ("61", "62", "63", "74", "75", "76", "77", "78", "79", "80", "81", "82", "83", "85", "86")

# Job-bond code prefix -> class; the first matching prefix wins.
BOND_PROTECTED = "Protegido"
BOND_PRECARIOUS = "Precarizado"
BOND_OTHER = "Outros"
BOND_UNKNOWN = "Sem informação"
BOND_RULES = (
    ("0101", BOND_PROTECTED),
    ("0102", BOND_PROTECTED),
    ("0105", BOND_PROTECTED),
    ("100", BOND_PROTECTED),
    ("0103", BOND_PRECARIOUS),
    ("0104", BOND_PRECARIOUS),
    ("02", BOND_PRECARIOUS),
    ("03", BOND_PRECARIOUS),
    ("0401", BOND_PRECARIOUS),
    ("0402", BOND_PRECARIOUS),
    ("07", BOND_PRECARIOUS),
    ("08", BOND_PRECARIOUS),
    ("09", BOND_PRECARIOUS),
    ("05", BOND_OTHER),
    ("06", BOND_OTHER),
    ("0403", BOND_OTHER),
)

# Regions whose access figures are set by hand, and the figures.
ACCESS_OVERRIDE_REGIONS = ("53001", "35016")
ACCESS_OVERRIDE_ROAD_SHARE = 100.0
ACCESS_OVERRIDE_DISTANCE = 0.0

# Flag spellings of the distance and GDP tables.
ROAD_YES = "sim"
TERRITORY_YES = "Sim"

# Establishment type description -> output column.
UNIT_TYPES = {
    "Unidade Móvel Terrestre": "Unidade_Movel_Terrestre",
    "Centro de Saúde/Unidade Básica": "Centro_de_Saude_Unidade_Basica",
    "Oficina Ortopédica": "Oficina_Ortopedica",
    "Central de Regulação de Serviços de Saúde": "Central_de_Regulacao_de_Servicos_de_Saude",
    "Unidade Mista": "Unidade_Mista",
    "Unidade Móvel Fluvial": "Unidade_Movel_Fluvial",
    "Unidade de Atenção à Saúde Indígena": "Unidade_de_Atencao_a_Saude_Indigena",
    "Consultório Isolado": "Consultorio_Isolado",
    "Centro de Parto Normal - Isolado": "Centro_de_Parto_Normal_Isolado",
    "Hospital Geral": "Hospital_Geral",
    "Central de Notificação, Captação e Distribuição de Órgãos Estadual":
        "Central_de_Notificacao_Captacao_e_Distribuicao_de_orgaos_Estadual",
    "Farmácia": "Farmacia",
    "Serviço de Atenção Domiciliar Isolado (Home Care)": "Servico_de_Atencao_Domiciliar_Isolado_Home_Care",
    "Telessaúde": "Telessaude",
    "Pronto-Socorro Geral": "Pronto_Socorro_Geral",
    "Clínica/Centro de Especialidade": "Clinica_Centro_de_Especialidade",
    "Central de Regulação do Acesso": "Central_de_Regulacao_do_Acesso",
    "Pronto-Socorro Especializado": "Pronto_Socorro_Especializado",
    "Posto de Saúde": "Posto_de_Saude",
    "Pronto-Socorro Traumato-Ortorpédico (Antigo)": "Pronto_Socorro_Traumato_Ortorpedico_Antigo",
    "Unidade de Apoio Diagnóstico e Terapia (Sadt Isolado)": "Unidade_de_Apoio_Diagnostico_e_Terapia_Sadt_Isolado",
    "Centro de Atenção Psicossocial": "Centro_de_Atencao_Psicossocial",
    "Policlínica": "Policlinica",
    "Laboratório Central de Saúde Pública Lacen": "Laboratorio_Central_de_Saude_Publica_Lacen",
    "Polo de Prevenção de Doenças e Agravos e Promoção da Saúde":
        "Polo_de_Prevencao_de_Doencas_e_Agravos_e_Promocao_da_Saude",
    "Unidade de Vigilância Sanitária (Antigo)": "Unidade_de_Vigilância_Sanitaria_Antigo",
    "Hospital Especializado": "Hospital_Especializado",
    "Unidade Móvel de Nivel Pré-Hospitalar na Área de Urgência":
        "Unidade_Movel_de_Nivel_Pre_Hospitalar_na_Area_de_Urgencia",
    "Unidade de Saúde da Família": "Unidade_de_Saude_da_Familia",
    "Unidade de Vigilância Em Saúde": "Unidade_de_Vigilancia_Em_Saude",
    "Pronto-Socorro de Hospital Geral (Antigo)": "Pronto_Socorro_de_Hospital_Geral_Antigo",
    "Unidade de Atenção em Regime Residencial": "Unidade_de_Atencao_em_Regime_Residencial",
    "Hospital/Dia - Isolado": "Hospital_Dia_Isolado",
    "Laboratório de Saúde Pública": "Laboratorio_de_Saude_Publica",
    "Centro de Apoio à Saúde da Família": "Centro_de_Apoio_a_Saude_da_Familia",
    "Central de Gestão em Saúde": "Central_de_Gestao_em_Saude",
    "Pronto Atendimento": "Pronto_Atendimento",
    "Polo Academia da Saúde": "Polo_Academia_da_Saude",
    "Central de Regulação Médica das Urgências": "Central_de_Regulacao_Medica_das_Urgencias",
    "Cooperativa ou Empresa de Cessão de Trabalhadores na Saúde":
        "Cooperativa_ou_Empresa_de_Cessao_de_Trabalhadores_na_Saude",
    "Centro de Atenção Hemoterapia e ou Hematológica": "Centro_de_Atencao_Hemoterapia_e_ou_Hematológica",
}

# Decimal places of the mart's rounded columns.
MART_DIGITS = 4
SHARE_DIGITS = 2
