"""The registered queries of this subpackage: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometric.llm import (
    chat, decontaminate, hard_negatives, language_model, lexical, lines, neighbours, packing, quality, simhash, substrings,
    toxicity, warc,
)
from regiometric.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
TOKENIZER = "word_bpe_49k.json"


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register
def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's fingerprint and the smallest document it is linked to."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@register
def op2_recurrent_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's log-likelihood under the recurrent model and the base model."""
    return language_model.score_documents(table(spark, sf, "documents"))


@register
def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's word counts and the digest of what is kept of it."""
    return substrings.remove_repeated(table(spark, sf, "documents"))


@register
def op4_qgram_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the place and the number of edits."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register
def op5_toxicity_wfst(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity by the finite-state grammar."""
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register
def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the formatted text and its segments."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    chats = chat.format_chats(turns.unionByName(extra))
    said = F.transform(chat.read_chats(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"]))
    read = chats.withColumns({"_said": said, "_trained": F.array_join(trained, "")})
    return read.select(
        "conv_id",
        F.size("_said").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_said", ""), 256).alias("turns_sha256"),
        F.length("_trained").cast("long").alias("loss_chars"),
        F.sha2("_trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
    )


@register
def op7_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    folder = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, folder)


@register
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pieces, one sequence each."""
    path = public_tokenizers.path(TOKENIZER)
    packed = packing.pack_power_of_two(table(spark, sf, "documents"), path, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@register
def op9_permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    return neighbours.nearest(table(spark, sf, "embeddings"))


@register
def op10_quality_fm(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality score by a factorisation machine."""
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty documents that rank highest for every benchmark item."""
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's line counts and the digest of the lines that stay."""
    cut = lines.remove_repeated_lines(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives for every hundredth vector and its positives; every seventh row has the next label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings").withColumn("label", shifted))
