import dataclasses

import pytest

from regiometric import fixed
from regiometric.plans import MartSettings, MartTables, mart_features, region_mart
from regiometric.operators import keys
from regiometric.sources import schemas

CODES = {"35001": ("Norte", "SP"), "35002": ("Sul", "SP"), "53001": ("Distrito", "DF")}


@pytest.fixture(scope="module")
def tables(spark):
    def make(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    def place(code, dv, region):
        name, uf = CODES[region]
        return (code, dv, f"m{code}", region, name, "1", "M", uf, uf, "1", "Região Sudeste", "0", "0")

    jan, feb = "202201", "202202"
    return MartTables(
        rates=make([("35001", 0.123456), ("35002", 0.5), ("53001", 0.7), ("99999", None)], schemas.RATES),
        population=make([("35001", 1000), ("53001", 4000)], schemas.POPULATION),
        hierarchy=make(
            [place("350010", "3500101", "35001"), place("350020", "3500202", "35001"),
             place("350030", "3500303", "35002"), place("530010", "5300108", "53001")],
            schemas.HIERARCHY,
        ),
        admissions=make([(2022, "350010", 3), (2022, "350020", 4), (2021, "350010", 9), (2022, "530010", 1)], schemas.ADMISSIONS),
        education=make(
            [(2022, "Enfermagem", "i1", "35001", "Norte", "SP", 10, 5, 7, 20),
             (2022, "Enfermagem", "i1", "35001", "Norte", "SP", 1, 1, 1, 1),
             (2022, "Medicina", "i2", "35001", "Norte", "SP", 99, 9, 9, 9),
             (2021, "Enfermagem", "i3", "35002", "Sul", "SP", 99, 9, 9, 9)],
            schemas.EDUCATION,
        ),
        beds=make([("350010", jan, "61", 2, 1), ("350010", jan, "60", 50, 50), ("350020", jan, "86", 3, 0), ("350010", feb, "61", 9, 9)], schemas.BEDS),
        bed_totals=make([(2022, "SP", "35001", "Norte", 8, 2), (2021, "SP", "35001", "Norte", 80, 20)], schemas.BED_TOTALS),
        establishments=make([("350010", jan, "05"), ("350020", jan, "05"), ("350030", jan, "99"), ("530010", jan, "39")], schemas.ESTABLISHMENTS),
        unit_types=make([("05", "Hospital Geral"), ("39", "Policlínica")], schemas.UNIT_TYPES),
        professionals=make(
            [(jan, "350010", "SP", "p1", "223505", "010100"), (jan, "350020", "SP", "p1", "223505", "020000"),
             (jan, "350020", "SP", "p2", "223510", "020000"), (jan, "3500303", "SP", "p3", "223505", "030000"),
             (jan, "350010", "SP", "p9", "322205", "020000"), (feb, "350010", "SP", "p8", "223505", "020000")],
            schemas.PROFESSIONALS,
        ),
        distances=make([("350010", 10.0, "sim"), ("350020", 21.0, "não"), ("350030", 5.0, "não"), ("530010", 77.0, "não")], schemas.DISTANCES),
        deaths=make([("2022", "35001", 2), ("2022", "35001", 3), ("2021", "35001", 50)], schemas.DEATHS),
        gdp=make(
            [(2021, "3500101", 100.5, "Sim", "Não"), (2021, "3500202", 200.25, "Não", "Não"), (2021, "3500303", 7.0, "Não", "Não"),
             (2020, "3500101", 9.0, "Sim", "Sim")],
            schemas.GDP,
        ),
    )


def test_mart_columns_and_rows(tables):
    mart = region_mart(tables)
    assert len(mart.columns) == 68 and len(set(mart.columns)) == 68
    rows = {row["rate"]: row.asDict() for row in mart.collect()}
    assert set(rows) == {0.1235, 0.5, 0.7, None}
    north = rows[0.1235]
    want = {
        "uf_sigla": "SP", "cod_regsaud": "35001", "regiao_saude": "Norte", "pop_censo22": 1000, "TOTAL_PROF": 2,
        "razao_enfermeiros_1000": 2.0, "internacoes_sensiveis_aps": 7, "total_ies_enfermagem": 1, "matriculas_ies": 11,
        "ingressos_ies": 6, "vagas_ies": 8, "inscritos_ies": 21, "Leitos_UTI_SUS": 5, "Leitos_UTI_NSUS": 1,
        "quant_leitos_sus": 8, "quant_leitos_n_sus": 2, "Hospital_Geral": 2, "Policlinica": 0,
        "percentual_precarizacao": 66.67, "percentual_rodovias": 50.0, "distancia_media_capital_km": 15.5,
        "obitos_homicidios": 5, "obitos_1000_hab": 5.0, "vinc_medio": 1.5, "PIB_1000": 300.75, "PIB_percapita": 300.75,
        "percentual_amazonia_legal_corrigido": 50.0, "percentual_semiarido_corrigido": 0.0,
    }
    assert {name: north[name] for name in want} == want
    south = rows[0.5]
    # no population, no admissions; a code with check digit counts for bonds only
    assert south["cod_regsaud"] is None and south["uf_sigla"] is None and south["regiao_saude"] == "Sul"
    assert south["TOTAL_PROF"] is None and south["vinc_medio"] is None and south["percentual_precarizacao"] == 100.0
    assert south["Hospital_Geral"] == 0 and south["percentual_rodovias"] is None
    district = rows[0.7]
    assert (district["percentual_rodovias"], district["distancia_media_capital_km"]) == (100.0, 0.0)
    assert district["percentual_precarizacao"] is None and district["Policlinica"] == 1
    unknown = rows[None]
    assert unknown["Hospital_Geral"] is None and unknown["percentual_amazonia_legal_corrigido"] == 0.0


def test_settings_change_periods_and_overrides(tables):
    settings = MartSettings(month=2, override_regions=["35002"])
    rows = {row["rate"]: row for row in region_mart(tables, settings).collect()}
    assert rows[0.1235]["TOTAL_PROF"] == 1 and rows[0.1235]["Leitos_UTI_SUS"] == 9
    assert rows[0.5]["percentual_rodovias"] == 100.0 and rows[0.7]["percentual_rodovias"] is None


def test_two_spellings_multiply_rows_and_are_reported(spark, tables):
    twice = tables.bed_totals.union(spark.createDataFrame([(2022, "SP", "35001", "NORTE", 1, 1)], tables.bed_totals.schema))
    spelled = dataclasses.replace(tables, bed_totals=twice)
    assert region_mart(spelled).count() == 5
    report = {r["table_name"]: r["n_repeated"] for r in keys.key_report(mart_features(spelled), "cod_regsaud").collect()}
    assert report["beds"] == 1 and sum(report.values()) == 1


def test_two_spellings_can_be_refused(spark, tables):
    twice = tables.bed_totals.union(spark.createDataFrame([(2022, "SP", "35001", "NORTE", 1, 1)], tables.bed_totals.schema))
    assert region_mart(tables, MartSettings(unique_regions=True)).collect() == region_mart(tables).collect()
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    refused = region_mart(dataclasses.replace(tables, bed_totals=twice), MartSettings(unique_regions=True))
    assert len(tracker.getJobIdsForGroup(None)) == before
    with pytest.raises(Exception, match="beds: cod_regsaud repeats, e.g. 35001"):
        refused.collect()


def test_plan_stays_in_spark_and_reads_the_registry_twice(spark, tables, tmp_path, plan):
    path = str(tmp_path / "registry")
    tables.professionals.write.parquet(path)
    stored = dataclasses.replace(tables, professionals=spark.read.parquet(path))
    mart = region_mart(stored)
    mart.collect()
    text = plan(mart).split("== Initial Plan ==")[0]
    # one read for head count and jobs per person together, one for bonds
    assert text.count("FileScan parquet") == 2
    assert "EqualTo(COMPETEN,202201)" in text and "StringStartsWith(CBO,2235)" in text
    for absent in ("Python", "CartesianProduct", "NestedLoop"):
        assert absent not in text


def test_unit_types_are_the_listed_columns():
    assert len(fixed.UNIT_TYPES) == 41 == len(set(fixed.UNIT_TYPES.values()))
