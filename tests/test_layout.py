import uuid

import pytest
from pyspark.sql import functions as F

from regiometric import sources
from regiometric.functions import period_equals


def test_stored_registry_joins_without_a_shuffle_and_reads_one_month(spark, tmp_path, plan, rows):
    data = [(f"2022{m:02d}", f"35{k:04d}" + ("7" if k % 3 else ""), k * m) for m in (1, 2, 3) for k in range(40)]
    registry = spark.createDataFrame(data, "COMPETEN string, CODUFMUN string, n int")
    places = spark.createDataFrame([(f"35{k:04d}", f"r{k % 5}") for k in range(30)], "cod_municipio string, cod_regsaud string")
    run = uuid.uuid4().hex
    stored = sources.write_bucketed(registry, f"r_{run}", str(tmp_path / "r"), "CODUFMUN", 4, ["COMPETEN"])
    where = sources.write_bucketed(places, f"h_{run}", str(tmp_path / "h"), "cod_municipio", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = sources.attach_stored(stored.filter(period_equals("COMPETEN", 2022, 2)), where, ["cod_regsaud"])
        got = rows(joined.select("CODUFMUN", "n", "cod_regsaud"))
        text = plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and "SortMergeJoin" in text and "(COMPETEN" in text.split("PartitionFilters")[1][:80]
    wanted = [(c, n, f"r{int(c[2:6]) % 5}" if int(c[2:6]) < 30 else None) for m, c, n in data if m == "202202"]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_writing_tasks_stay_small_however_few_the_buckets(spark, tmp_path):
    codes = F.format_string("%06d", F.col("id") % 3000)
    registry = spark.range(0, 120_000, numPartitions=12).select(
        F.when(F.col("id") % 50 != 0, codes).alias("CODUFMUN"), F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") % 2 == 0, "202201").otherwise("202202").alias("COMPETEN"),
    )
    for by in ([], ["COMPETEN"]):
        name, path = f"w_{uuid.uuid4().hex}", str(tmp_path / f"w{len(by)}")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
        try:
            stored = sources.write_bucketed(registry, name, path, "CODUFMUN", 2, by)
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        # the task's number in a file's name: what one task wrote
        task = F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)
        written = [row["count"] for row in spark.read.parquet(path).groupBy(task.alias("task")).count().collect()]
        assert sum(written) == 120_000 and max(written) <= 30_000
        kept = ["CODUFMUN", "text", "COMPETEN"]
        assert stored.select(kept).exceptAll(registry.select(kept)).isEmpty()
        code = stored.filter(F.col("cod6") == "000007").select("CODUFMUN").distinct().collect()
        assert [row.CODUFMUN for row in code] == ["000007"]


def test_a_report_is_replaced_as_a_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(Exception):
        sources.read_published(spark, path, "a")
    first = {"a": spark.range(3), "b": spark.range(2)}
    sources.publish_report(first, path)
    broken = {"a": spark.range(9), "b": spark.range(2).select(F.raise_error(F.lit("dies")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="dies"):
        sources.publish_report(broken, path)
    assert sources.read_published(spark, path, "a").count() == 3
    sources.publish_report({"a": spark.range(5), "b": spark.range(4)}, path)
    assert [sources.read_published(spark, path, part).count() for part in "ab"] == [5, 4]
    with pytest.raises(Exception, match="no complete run with c"):
        sources.read_published(spark, path, "c")
