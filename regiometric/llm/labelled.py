"""Bounded samples of labelled documents, and the fold of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometric.session import stage

SAMPLE_ROWS = 12_000


def fold(id_column: str | Column, folds: int) -> Column:
    """CRC-32 of the id as text modulo ``folds``; a null id counts as the empty text."""
    given = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(given.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    columns: list[str],
    most_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """At most ``most_rows`` rows with their 0/1 ``label``, one per id, picked by a hash of the id, written once.

    ``learn`` is a condition on ``doc_id``. Labels that are null or whose id is null are left out; of several labels of
    one id the largest counts, and of several rows of one id that with the smallest hash of its columns. The picked ids
    are so few that they may be broadcast; of the documents, only rows of picked ids are shuffled, combined before.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().filter(learn)
    picked = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = docs.select("doc_id", *columns).join(F.broadcast(picked), "doc_id")
    row = F.struct(*[F.col(name).alias(f"c{i}") for i, name in enumerate(columns)])
    one = found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by(row, F.xxhash64(*columns)).alias("row"))
    given = [F.col(f"row.c{i}").alias(name) for i, name in enumerate(columns)]
    return stage(one.select("doc_id", "label", *given), "labelled")
