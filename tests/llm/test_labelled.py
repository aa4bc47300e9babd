from pyspark.sql import functions as F

from regiometric.llm.labelled import labelled_sample


def test_a_repeated_labelled_id_gives_one_row(spark):
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    more = [(2, None), (3, "c"), (3, "c"), (None, "d"), (4, "e")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", F.lit(True), ["text"], 100).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 1), (2, 0), (3, 1)]
    again = labelled_sample(docs, labels, "quality", F.lit(True), ["text"], 100).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert len(labelled_sample(docs, labels, "quality", F.lit(True), ["text"], 2).collect()) == 2
