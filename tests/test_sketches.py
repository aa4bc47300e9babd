import random

from pyspark.sql import functions as F

from regiometric.operators import describe, sketches


def test_months_and_regions_combine_like_sets(spark):
    rng = random.Random(1)
    seen = [(f"20220{rng.randint(1, 3)}", rng.choice(["350010", "350020", "350030", "999999", None]), f"p{rng.randint(1, 900)}") for _ in range(6000)]
    registry = spark.createDataFrame(seen, "COMPETEN string, CODUFMUN string, CPF_PROF string")
    places = {"350010": "35001", "350020": "35001", "350030": "35002"}
    hierarchy = spark.createDataFrame(list(places.items()), "cod_municipio string, cod_regsaud string")
    stored = sketches.headcount_sketches(registry, hierarchy)
    people = {}
    for _, code, person in seen:
        people.setdefault(places.get(code), set()).add(person)
    got = {r.cod_regsaud: (r.TOTAL_PROF, r.relative_error) for r in sketches.combined_headcount(stored).collect()}
    assert got == {region: (len(found), 0.0) for region, found in people.items()}
    pairs = spark.createDataFrame([("35001", "35002"), ("35001", "1")], "first string, second string")
    assert [tuple(r) for r in sketches.shared_people(stored, pairs).collect()] == [("35001", "35002", len(people["35001"] & people["35002"]))]


def test_large_head_counts_are_within_the_error(spark):
    registry = spark.range(300_000).select(
        F.lit("202201").alias("COMPETEN"), F.lit("350010").alias("CODUFMUN"), (F.col("id") % 100_000).cast("string").alias("CPF_PROF")
    )
    hierarchy = spark.createDataFrame([("350010", "35001")], "cod_municipio string, cod_regsaud string")
    row = sketches.combined_headcount(sketches.headcount_sketches(registry, hierarchy)).first()
    assert 0 < row.relative_error < 0.02 and abs(row.TOTAL_PROF - 100_000) < 4 * row.relative_error * 100_000


def test_approximate_medians(spark):
    df = spark.range(100_001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(2, None), (0, None)], "g long, v double"))
    lenient = {r.g: r.mediana for r in describe.group_medians(df, ["g"], "v", approximate=True).collect()}
    assert abs(lenient[0] - 50_000) / 100_001 < 2 * sketches.rank_error() and lenient[2] is None
    strict = {r.g: r.mediana for r in describe.group_medians(df, ["g"], "v", strict=True, approximate=True).collect()}
    assert strict[0] is None and abs(strict[1] - 50_000) / 100_001 < 2 * sketches.rank_error()
