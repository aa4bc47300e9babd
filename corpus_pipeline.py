"""From raw documents to packed training sequences, in five stages that are written and read back one after the other.

Every stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``. Rows may
repeat, ids may be null or repeated, and further columns of the input are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regiometric.llm import decontaminate, packing, quality, simhash, substrings
from regiometric.llm.queries import TOKENIZER, table
from regiometric.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express the fitted classifier, the XXH64 fingerprints or the tokenizer; tested against plain Python.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; it learns from the labels of the given documents."""
    scored = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.filter("predicted = 1").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null ids last; of equal ids, one of them.

    Groups are those of the operator: fingerprints over three-word shingles, linked within three bits.
    """
    keyed = docs.select(*COLUMNS).withColumns({
        "k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit("|"), "doc_id"),
    })
    keyed = keyed.withColumn("key", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2"))
    groups = simhash.near_duplicates(keyed, id_column="key", shingle=simhash.SHINGLE)
    groups = groups.filter(F.col("key") == F.col("component_id"))
    # written, so that the join has plain sides and rows that repeat very often can be split
    first = stage(groups.select("key.k1", "key.k2").distinct(), "first")
    kept = keyed.drop("key").join(first, ["k1", "k2"])
    copy = F.row_number().over(W.partitionBy("k1", "k2").orderBy("source", "lang"))
    return kept.withColumn("copy", copy).filter("copy = 1").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of long repeated runs; ``n_chars`` follows the text. A null text gets empty."""
    cut = substrings.remove_repeated(docs, carry=["lang", "source", "n_chars"], with_text=True)
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids, one sequence each."""
    return packing.pack_power_of_two(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
