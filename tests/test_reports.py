import pytest

from regiometric.plans import cross_report, occupation_report
from regiometric.sources import parse_features, schemas, write_report


def place(code, region, name, uf, code_uf, macro):
    return (code, f"{code}1", f"m{code}", region, name, "1", "M", uf[:2], uf, code_uf, macro, "-10", "-50")


@pytest.fixture(scope="module")
def hierarchy(spark):
    places = []
    for i in range(12):
        uf, code_uf, macro = [("São Paulo", "35", "Região Sudeste"), ("Paraná", "41", "Região Sul"),
                              ("Bahia", "29", "Região Nordeste"), ("Acre", "12", "Região Norte")][i % 4]
        for j in range(2):
            places.append(place(f"35{i:02d}0{j}", f"35{i:03d}", f"R{i}", uf, code_uf, macro))
    places.append(place("530010", "53001", "Distrito Federal", "Distrito Federal", "53", "Região Centro-Oeste"))
    return spark.createDataFrame(places, schemas.HIERARCHY)


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([(f"35{i:03d}", 0.3 + 0.05 * i) for i in range(12)] + [("53001", 0.99)], schemas.RATES)


def test_occupation_report(spark, hierarchy, rates, tmp_path):
    density = spark.createDataFrame([("35", "SP", 2.0), ("41", "PR", 1.5), ("29", "BA", 1.7), ("12", "AC", 2.4), ("53", "DF", 9.0)], schemas.DENSITY)
    polygons = parse_features(spark.createDataFrame(
        [('{"properties": {"reg_id": 35003}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}}',)], "value string"
    ))
    report = occupation_report(rates, hierarchy, density, polygons, n=3)
    assert report["enriched"].count() == 13
    assert {r["nome_regiao_saude"] for r in report["top"].collect()} == {"Distrito Federal", "R11", "R10"}
    assert {r["rate_percent"] for r in report["bottom"].collect()} == {30.0, 35.0, 40.0}
    assert {r["macro"]: r["rotulo"] for r in report["macro_medians"].collect()}["Centro-Oeste"] == "99%"
    assert {r["macro"]: r["ord"] for r in report["macro_order"].collect()}["Norte"] == 2
    assert report["overall_of_states"].first()["n"] == 12
    assert "Distrito Federal" not in {r["uf"] for r in report["state_medians"].collect()}
    assert {r["uf"]: r["ord"] for r in report["state_box"].collect()} == {"Bahia": 1, "Acre": 2, "São Paulo": 3, "Paraná": 4}
    assert report["density_points"].count() == 4
    line, test = report["density_line"].first(), report["density_test"].first()
    assert line["n"] == test["n"] == 4 and line["r2"] == pytest.approx(test["r"] ** 2)
    ranking = {r["Ranking"]: r["nome_regiao_saude"] for r in report["ranking"].collect()}
    assert ranking[1] == "Distrito Federal" and ranking[13] == "R0"
    assert report["map"].first()["colour_class"] == 1
    write_report({"ranking": report["ranking"], "map": report["map"]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "map")).count() == 1
    lines = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "ranking_csv"))
    assert lines.columns == ["Ranking", "uf", "nome_regiao_saude", "rate"] and lines.count() == 13
    assert report["macro_box"].count() == report["macro_summary"].count() == 5
    assert report["state_means"].count() == 5 and report["capitals"].count() == 0


def test_occupation_report_without_jobs_and_optional_tables(hierarchy, rates):
    report = occupation_report(rates, hierarchy, test=False, excluded_state=None)
    assert report["state_medians"].count() == 5 and report["overall_of_states"].first()["n"] == 13
    assert {"density_points", "map", "ranking"}.isdisjoint(report)


def test_cross_report(spark, hierarchy, rates):
    def shifted(expression):
        return rates.selectExpr("regiao_saude", f"{expression} AS rate")

    tables = {"a": rates, "b": shifted("1 - rate * rate"), "c": shifted("rate / 2 + pmod(hash(regiao_saude), 7) / 50")}
    states = [("SP", 30), ("PR", 20), ("BA", 10), ("AC", 5), ("DF", 50)]
    council = spark.createDataFrame([(s, p, n * k) for s, n in states for p, k in (("A", 1), ("B", 2))], schemas.COUNCIL)
    census = spark.createDataFrame([("São Paulo", 9000), ("Paraná", 8000), ("Bahia", 7000), ("Acre", 1000), ("Distrito Federal", 2000)], schemas.CENSUS)
    report = cross_report(
        tables, hierarchy, council, census, {"A": "razao_a", "B": "razao_b"}, models={"m": ("a", ["b", "a", "c"])},
        panels={"a": "razao_a", "c": "razao_b"}, exclude_state="DF",
    )
    states_table = {r["uf"]: r for r in report["states"].collect()}
    assert set(states_table) == {"SP", "PR", "BA", "AC"}
    assert states_table["SP"]["razao_a"] == pytest.approx(30 / 9000 * 1000)
    assert states_table["SP"]["a"] == pytest.approx(0.5)
    assert report["pairs"].filter("level = 'all'").count() == 3 and report["pair_points"].count() == 39
    assert report["line_a"].first()["n"] == 4 and "line_b" not in report
    assert report["model_m"].first()["dropped_terms"] == ["a"]
