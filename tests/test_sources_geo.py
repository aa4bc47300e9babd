import json

import pytest

from regiometric import fixed, sources
from regiometric.functions import period_equals
from regiometric.operators import geo
from regiometric.session import cut_lineage, shared_dir
from regiometric.sources import schemas

SQUARE = [[[0, 0], [1, 0], [1, 1.5], [0, 0]]]


def features():
    return [
        {"type": "Feature", "properties": {"reg_id": 35001, "name": "x"}, "geometry": {"type": "Polygon", "coordinates": SQUARE}},
        {"type": "Feature", "properties": {"reg_id": "35002"}, "geometry": {"type": "MultiPolygon", "coordinates": [SQUARE, SQUARE]}},
    ]


@pytest.fixture()
def polygon_files(tmp_path):
    lines, collection = tmp_path / "lines.json", tmp_path / "collection.json"
    lines.write_text("\n".join(json.dumps(feature) for feature in features()), encoding="utf-8")
    collection.write_text(json.dumps({"type": "FeatureCollection", "features": features()}, indent=1), encoding="utf-8")
    return str(lines), str(collection)


def test_both_geojson_layouts_give_the_same_rows(spark, polygon_files, rows):
    lines, collection = polygon_files
    got = rows(sources.read_geojson(spark, lines))
    assert got == rows(sources.read_geojson(spark, collection, layout="collection"))
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.5], [0.0, 0.0]]]
    assert got == [("35001", "Polygon", [square]), ("35002", "MultiPolygon", [square, square])]
    with pytest.raises(ValueError):
        sources.read_geojson(spark, lines, layout="other")


def test_map_layer_keeps_all_polygons(spark, polygon_files, rows):
    rates = spark.createDataFrame([("035001", 0.5), ("7", 0.1)], "cod_regiao_saude string, rate double")
    layer = geo.map_layer(sources.read_geojson(spark, polygon_files[0]), rates)
    assert rows(layer.select("reg_id", "rate", "srid", "colour_position", "colour_class")) == [
        ("35001", 0.5, 4326, 0.5, 2), ("35002", None, 4326, None, None)
    ]


def test_colour_scale(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.24, 0.25, 1.0, 1.2, None)], "v double")
    got = [(r["colour_position"], r["colour_class"]) for r in geo.with_colour(df, "v").collect()]
    assert got == [(0.0, 0), (0.24, 0), (0.25, 1), (1.0, 3), (None, None), (None, None)]
    own = [r["colour_position"] for r in geo.with_colour(df, "v", limits=None).collect()]
    assert own[0] == 0.0 and own[4] == 1.0


def test_capital_points(spark, rows):
    hierarchy = spark.createDataFrame(
        [("355030", 3550308, "São Paulo", "-23.5", "-46.6"), ("350000", 3500001, "x", "0", "0"), ("530010", 5300108, "Brasília", "bad", "-80")],
        "cod_municipio string, cod_municipiodv int, municipio string, latitude string, longitude string",
    )
    assert rows(geo.capital_points(hierarchy)) == [
        ("355030", "São Paulo", -46.6, -23.5, True), ("530010", "Brasília", -80.0, None, False)
    ]
    assert len(set(fixed.CAPITALS)) == 27 == len(fixed.STATES)


def test_rate_files_with_index_column(spark, tmp_path, rows):
    path = tmp_path / "rates.csv"
    path.write_text(";regiao_saude;rate\n0; 35001 ;0.5\n0;35002;\n0;05001;x\n", encoding="utf-8")
    df = sources.read_rates_csv(spark, str(path))
    assert df.columns == ["regiao_saude", "rate"]
    assert rows(df) == [("05001", None), ("35001", 0.5), ("35002", None)]


def test_comma_files_and_rejected_codes(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("nome,populacao,cod_regsaud\na,10,35001\nb,20,x1\nc,30,\n", encoding="utf-8")
    df = sources.read_csv(spark, str(path), schemas.POPULATION)
    assert df.schema["populacao"].dataType.simpleString() == "bigint"
    assert tuple(sources.rejected_codes(df, "cod_regsaud").first()) == (3, 1, 1)
    coded = sources.with_text_codes(spark.createDataFrame([(35001,)], "c int"), ["c"])
    assert coded.first()["c"] == "35001"


def test_writers(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    sources.write_parquet(df, str(tmp_path / "p"), partition_by=["k"])
    assert rows(sources.read_parquet(spark, str(tmp_path / "p"), ["n", "k"])) == [(1, "a"), (2, "b")]
    assert (tmp_path / "p" / "k=a").is_dir()
    sources.write_csv(df, str(tmp_path / "c"))
    assert rows(sources.read_csv(spark, str(tmp_path / "c"), "k string, n int", ";")) == [("a", 1), ("b", 2)]


def test_registry_partitioned_by_period(spark, tmp_path, plan):
    path = str(tmp_path / "registry")
    people = [("202201", "350010", "SP", "p1", "223505", "0101"), ("202202", "350010", "SP", "p2", "223505", "0101")]
    sources.write_parquet(spark.createDataFrame(people, schemas.PROFESSIONALS), path, partition_by=["COMPETEN"])
    df = sources.read_parquet(spark, path, schema=schemas.PROFESSIONALS).filter(period_equals("COMPETEN", 2022, 2))
    assert [r["CPF_PROF"] for r in df.collect()] == ["p2"]
    assert df.schema["COMPETEN"].dataType.simpleString() == "string"
    filters = plan(df).split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "= 202202" in filters and "cast" not in filters


def test_every_schema_parses(spark):
    for name, ddl in vars(schemas).items():
        if name.isupper():
            assert spark.createDataFrame([], ddl).count() == 0


def test_lineage_is_cut_in_the_shared_folder(spark, plan):
    df = cut_lineage(spark.range(10).filter("id > 4"))
    assert df.count() == 5 and "FileScan parquet" in plan(df)
    assert shared_dir(spark)


def test_rejects_are_counted_in_the_one_pass_of_the_load(spark, tmp_path, plan):
    from pyspark.sql import Observation

    (tmp_path / "in.csv").write_text("b;a;extra\n1;x;q\n2,5;7;q\n;8;q\nz; 9 ;q\n4.5;;q\n")
    table = sources.load_csv(spark, str(tmp_path / "in.csv"), "a bigint, b double", str(tmp_path / "out"), sep=";")
    assert [tuple(r) for r in table.collect()] == [("a", 5, 1, 1), ("b", 5, 1, 2)]
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, 1.0), (7, None), (8, None), (9, None), (None, 4.5)], key=str)
    seen = Observation()
    text = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "in.csv"))
    df = sources.observed(text, "a bigint", seen)
    df.collect()
    assert seen.get["malformed_0"] == 1 and plan(df).count("FileScan csv") == 1 and "CollectMetrics" in plan(df)
