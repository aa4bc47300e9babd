import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.operators import indicators as ind
from regiometric.operators import keys
from regiometric.operators.territory import attach_dictionary, attach_region, enrich_rates, region_dimension

slow = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
HIERARCHY = "cod_municipio string, cod_municipiodv string, cod_regsaud string, regiao_saude string"


@pytest.fixture(scope="module")
def hierarchy(spark):
    return spark.createDataFrame(
        [
            ("350010", "3500101", "35001", "Norte"),
            ("350020", "3500202", "35001", "Norte"),
            ("350030", "3500303", "35002", "Sul"),
            ("530010", "5300108", "53001", "Distrito"),
        ],
        HIERARCHY,
    )


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        ("350010", "p1", "010100"),
        ("350010", "p1", "020000"),  # second job of the same person
        ("350020", "p1", "010200"),  # same person, same region, other municipality
        ("350030", "p1", "050000"),  # same person, other region
        ("350030", "p2", None),
        ("3500303", "p3", "020000"),  # code with check digit
        ("999999", "p4", "030000"),  # unknown municipality
        ("999999", None, "040300"),
    ]
    return spark.createDataFrame(rows, "CODUFMUN string, CPF_PROF string, VINCULAC string")


def test_exact_and_prefix_codes(spark, hierarchy, registry):
    exact = attach_region(registry, hierarchy, "CODUFMUN")
    assert exact.count() == 8 and exact.filter("cod_regsaud IS NULL").count() == 3
    prefix = attach_region(registry, hierarchy, "CODUFMUN", prefix=6)
    assert prefix.filter("cod_regsaud IS NULL").count() == 2


def test_head_count_is_distinct_per_region_and_null_region_counts(hierarchy, registry, rows):
    jobs = ind.jobs_per_professional(registry, hierarchy)
    # the NULL region holds p3, p4 and an unnamed person, who is no distinct name but has a job count
    assert rows(ind.headcount(jobs)) == [(None, 2), ("35001", 1), ("35002", 2)]
    assert rows(ind.mean_jobs(jobs)) == [(None, None, 1.0), ("35001", "Norte", 3.0), ("35002", "Sul", 1.0)]


def test_class_shares(hierarchy, registry, rows):
    shares = ind.class_share(registry, hierarchy).select("cod_regsaud", "categorias_vinculos", "n", "percentual")
    assert rows(shares) == [
        (None, fixed.BOND_OTHER, 1, 50.0),
        (None, fixed.BOND_PRECARIOUS, 1, 50.0),
        ("35001", fixed.BOND_PRECARIOUS, 1, 33.33),
        ("35001", fixed.BOND_PROTECTED, 2, 66.67),
        ("35002", fixed.BOND_OTHER, 1, 33.33),
        ("35002", fixed.BOND_PRECARIOUS, 1, 33.33),
        ("35002", fixed.BOND_UNKNOWN, 1, 33.33),
    ]


def test_repeated_dictionary_keys_inflate_counts(spark, hierarchy, registry):
    dictionary = spark.createDataFrame([("020000", "a"), ("020000", "b"), ("010100", "c")], "CHAVE string, d string")
    shares = ind.class_share(registry, hierarchy, dictionary=(dictionary, "CHAVE"))
    joined = registry.join(dictionary, registry.VINCULAC == dictionary.CHAVE, "left")
    assert shares.agg(F.sum("n")).first()[0] == joined.count() == 10
    assert keys.duplicate_keys(dictionary, ["CHAVE"]).collect()[0]["n_rows"] == 2
    with pytest.raises(ValueError, match="020000"):
        keys.require_unique(dictionary, ["CHAVE"], "bonds")


def test_one_class_keeps_regions_without_it(hierarchy, registry, rows):
    counts = ind.count_by_region(registry, hierarchy, "CODUFMUN", extra_keys=["VINCULAC"], prefix=6)
    kept = F.col("VINCULAC").startswith("01")
    share = ind.one_class_share(counts, ["cod_regsaud"], kept, "p")
    assert rows(share) == [(None, None), ("35001", 66.67), ("35002", None)]
    assert rows(ind.fill_missing(share, {"p": 0.0}))[2] == ("35002", 0.0)


@slow
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from("xyz"), st.integers(1, 999)), min_size=1))
def test_shares_of_a_group_sum_to_hundred(spark, cells):
    counts = spark.createDataFrame(cells, "g string, c string, n int").groupBy("g", "c").agg(F.sum("n").alias("n"))
    sums = ind.share_within(counts, ["g"]).groupBy("g").agg(F.sum("percentual").alias("s")).collect()
    assert all(row["s"] == pytest.approx(100.0, abs=0.02) for row in sums)


@slow
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.sampled_from(["x.1", "yz", "w"])), min_size=1))
def test_wide_row_sums_equal_long_counts(spark, pairs):
    long = spark.createDataFrame(pairs, "g string, c string").groupBy("g", "c").agg(F.count("*").alias("n"))
    columns = {"x.1": "x_1", "yz": "yz", "w": "w", "absent": "absent"}
    wide = ind.wide_counts(long, ["g"], "c", columns)
    total = wide.select(F.sum(sum((F.col(name) for name in columns.values()), F.lit(0)))).first()[0]
    assert total == len(pairs) and wide.agg(F.sum("absent")).first()[0] == 0


def test_types_wide_keeps_regions_of_undescribed_types(spark, hierarchy, rows):
    facts = spark.createDataFrame(
        [("350010", "05"), ("350020", "05"), ("350030", "77")], "CODUFMUN string, TP_UNID string"
    )
    dictionary = spark.createDataFrame([("05", "Hospital Geral")], "`TIPO DE ESTABELECIMENTO` string, descricao_tratado string")
    wide = ind.types_wide(facts, hierarchy, dictionary, {"Hospital Geral": "hg", "Farmácia": "f"})
    assert rows(wide) == [("35001", "Norte", 2, 0), ("35002", "Sul", 0, 0)]


def test_sums_use_repeated_hierarchy_rows_as_a_join_does(spark, hierarchy):
    doubled = hierarchy.union(hierarchy.filter("cod_municipio = '350010'"))
    facts = spark.createDataFrame([("350010", 5), ("350010", 7), ("350020", 1)], "m string, v int")
    total = ind.sum_by_region(facts, doubled, "m", {"s": "v"}).filter("cod_regsaud = '35001'").first()["s"]
    assert total == attach_region(facts, doubled, "m").agg(F.sum("v")).first()[0] == 25


def test_access_overrides_and_missing_road(spark, hierarchy, rows):
    distances = spark.createDataFrame(
        [("350010", 10.0, "sim"), ("350020", 20.0, "não"), ("350030", 7.0, "não"), ("530010", 99.0, "não")],
        "cod_municipio string, km double, acesso_rodovia string",
    )
    table = ind.access(distances, hierarchy).drop("regiao_saude")
    assert rows(table) == [("35001", 15.0, 50.0), ("35002", 7.0, None), ("53001", 99.0, None)]
    fixed_up = ind.with_overrides(
        table, "cod_regsaud", ["53001"], {"percentual_rodovias": 100.0, "dist_media_capital_km": 0.0}
    )
    assert rows(fixed_up)[2] == ("53001", 0.0, 100.0)


def test_mean_ignores_missing_values(spark, hierarchy, rows):
    facts = spark.createDataFrame([("350010", 1.0), ("350010", None), ("350020", 2.0)], "m string, v double")
    assert rows(ind.mean_by_region(facts, hierarchy, "m", "v", "mean")) == [("35001", "Norte", 1.5)]


def test_flag_share_and_gross_product(spark, hierarchy, rows):
    gdp = spark.createDataFrame(
        [("3500101", 1.5, "Sim", "Não"), ("3500202", 2.5, "Não", "Não"), ("3500303", 4.0, "Não", "Não")],
        "m string, v double, a string, s string",
    )
    product = ind.gross_product(gdp, hierarchy, "m", "v", {"a": "pa", "s": "ps"}, "pib").drop("regiao_saude")
    assert rows(product) == [("35001", 4.0, 50.0, None), ("35002", 4.0, None, None)]
    share = ind.flag_share(gdp, hierarchy, "m", "a", "pa", hierarchy_code="cod_municipiodv").drop("regiao_saude")
    assert rows(share) == [("35001", 50.0), ("35002", 0.0)]


def test_density_without_population_is_null(spark, rows):
    counts = spark.createDataFrame([("1", 3), ("2", 4)], "r string, n bigint")
    people = spark.createDataFrame([("1", 2000)], "r string, p bigint")
    assert rows(ind.density(counts, people, "r", "r", "n", "p", "d")) == [("1", 3, 2000, 1.5), ("2", 4, None, None)]


def test_training_supply(spark, rows):
    education = spark.createDataFrame(
        [("1", "a", 2022, "SP", "E", "i1", 5), ("1", "a", 2022, "SP", "E", "i1", 6), ("1", "a", 2022, "SP", "E", "i2", 1)],
        "cod_regsaud string, regiao_saude string, ano int, uf_sigla string, curso string, chave_ies string, q bigint",
    )
    institutions, places = ind.training_supply(education, {"q_sum": "q"})
    assert rows(institutions) == [("1", "a", 2)]
    assert rows(places) == [("1", "a", 2022, "SP", "E", 12)]


def test_dictionary_and_dimension(spark, hierarchy, rows):
    facts = spark.createDataFrame([("05",), ("77",)], "t string")
    dictionary = spark.createDataFrame([("05", "x")], "k string, l string")
    assert rows(attach_dictionary(facts, dictionary, "t", "k", "l", "label")) == [("05", "x"), ("77", None)]
    assert region_dimension(hierarchy, ["cod_regsaud", "regiao_saude"]).count() == 3


def test_enriched_rates_keep_unknown_regions(spark, hierarchy, rows):
    rates = spark.createDataFrame([("35001", 0.5), ("99999", 0.4)], "regiao_saude string, rate double")
    table = enrich_rates(rates, hierarchy, ["cod_regsaud", "regiao_saude"])
    assert table.columns == ["cod_regiao_saude", "rate", "nome_regiao_saude"]
    assert rows(table) == [("35001", 0.5, "Norte"), ("99999", 0.4, None)]


def test_key_report(spark, rows):
    a = spark.createDataFrame([("1",), ("1",), (None,)], "k string")
    assert rows(keys.key_report({"a": a, "none": a.filter("false")}, "k")) == [("a", 3, 1, 1, 1), ("none", 0, 0, 0, 0)]


def test_pivot_of_unique_cells(spark, rows):
    long = spark.createDataFrame([("SP", "Médicos", 1.5), ("SP", "Enf", 2.0), ("RJ", "Enf", 3.0)], "u string, p string, v double")
    wide = ind.pivot_first(long, ["u"], "p", "v", {"Médicos": "razao_medicos", "Enf": "razao_enf"})
    assert rows(wide) == [("RJ", None, 3.0), ("SP", 1.5, 2.0)]


def test_numeric_codes_are_compared_as_text(spark, hierarchy):
    facts = spark.createDataFrame([(350010, 1), (3500303, 2)], "m int, v int")
    assert attach_region(facts, hierarchy, "m").filter("cod_regsaud IS NULL").count() == 1
    assert attach_region(facts, hierarchy, "m", prefix=6).filter("cod_regsaud IS NULL").count() == 0
    numbered = hierarchy.withColumn("cod_regsaud", F.col("cod_regsaud").cast("int"))
    rates = spark.createDataFrame([(35001, 0.5)], "regiao_saude int, rate double")
    assert enrich_rates(rates, numbered, ["cod_regsaud", "regiao_saude"]).first()["nome_regiao_saude"] == "Norte"
