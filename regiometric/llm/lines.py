"""Repeated lines, found through levelled sorted runs of line hashes; built-in expressions only.

``LineRuns`` keeps what it has seen as runs: tables of (key, documents, largest document id), bucketed and sorted by key.
A new batch is reduced to its own keys, merge-anti-joined with the runs, so that keys on which nothing can change any
more stay out, and added as a run of the lowest level. A level that has ``fan`` runs is merged into one run of the next
level, so each key is rewritten once a level and the number of runs grows with the logarithm of the batches.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometric.session import scratch_dir, stage

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
BATCHES = 4
FAN = 3
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    """The lines of a text, the empty ones too; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def document_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``id``, ``mark`` (a hash of the text), ``pos`` and the key (``h1``, ``h2``: 128 bits) of every line that is long enough.

    A key is that of the line without blanks at both ends and with A to Z in lower case.
    """
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.select("id", F.xxhash64("text").alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    bare = F.btrim("line", F.lit(BLANKS))
    plain = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return source.filter(F.char_length(bare) >= least_chars).select(
        "id", "mark", "pos", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit("line"), plain).alias("h2")
    )


class LineRuns:
    """Levelled runs below the shared folder. ``least``: in how many documents a line has to be to count as repeated.

    All rows of a document have to come in one batch; batches may come in any order. An empty batch adds an empty run.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCUMENTS, fan: int = FAN, buckets: int | None = None):
        self.spark, self.least, self.fan = spark, least, max(fan, 2)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch of ``document_lines``: its keys that are new, or on which it can change something."""
        own = lines.groupBy(*KEY, "id").agg(F.lit(1).alias("one"))  # a document counts once, however often it holds a line
        own = own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("largest"))
        for run in [run for level in self.levels for run in level]:
            settled = run.filter(F.col("documents") >= self.least).select(*KEY, F.col("largest").alias("_largest"))
            same = [own[k] == settled[k] for k in KEY]
            own = own.join(settled, [*same, F.col("_largest") >= F.col("largest")], "left_anti")
        self._write(own, 0)

    def _write(self, rows: DataFrame, level: int) -> None:
        """Write a run, one sorted file a bucket, so that later merges neither move nor shuffle it; compact a full level."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select(*KEY, "documents", "largest").repartition(self.buckets, *KEY)
        writer = dealt.write.format("parquet").option("path", scratch_dir(self.spark, "line-run"))
        writer.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.spark.table(name))
        if len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One row per key of several runs, by merge joins of their sorted buckets."""
        rows = runs[0]
        for run in runs[1:]:
            other = run.select(*KEY, F.col("documents").alias("_documents"), F.col("largest").alias("_largest"))
            none = F.lit(0)
            rows = rows.join(other, KEY, "full").select(
                *KEY,
                (F.coalesce("documents", none) + F.coalesce("_documents", none)).alias("documents"),
                F.greatest("largest", "_largest").alias("largest"),
            )
        return rows

    def repeated(self) -> DataFrame:
        """``h1``, ``h2``, ``largest`` of the keys that are in ``least`` documents or more."""
        rows = self._merged([run for level in self.levels for run in level])
        return rows.filter(F.col("documents") >= self.least).select(*KEY, "largest")


def _mask(places: Column) -> Column:
    """An array of booleans that is true at the ascending ``places`` and ends with the last of them."""
    steps = F.arrays_zip(places.alias("at"), F.concat(F.array(F.lit(-1)), places).alias("before"))
    steps = F.filter(steps, lambda s: s["at"].isNotNull())
    gaps = F.transform(
        steps, lambda s: F.concat(F.array_repeat(F.lit(False), s["at"] - s["before"] - 1), F.array(F.lit(True)))
    )
    return F.flatten(gaps)


def remove_repeated_lines(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES,
    fan: int = FAN,
    carry: list[str] | None = None,
) -> DataFrame:
    """``id_column``, ``n_lines``, ``n_dropped`` and ``kept_text`` of every row, with the columns of ``carry``.

    Lines whose key has ``least_chars`` code points or more and is in ``least_documents`` documents or more are dropped,
    except in the document with the largest id that holds it, which keeps all of its own. Rows of one id are one document,
    kept and cut one by one; a null id is one document too, smaller than any other. A null or empty text is one empty
    line, which is never dropped. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "lines")
    lines = document_lines(docs, text, id_column, least_chars)
    dealt = lines.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    dealt.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema(dealt.schema).parquet(folder)
    runs = LineRuns(spark, least_documents, fan)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch))
    repeated = stage(runs.repeated(), "repeated")
    gone = lines.join(repeated, KEY).filter(~F.col("id").eqNullSafe(F.col("largest")))
    places = F.sort_array(F.collect_set("pos"))
    gone = gone.groupBy("id", "mark").agg(_mask(places).alias("gone"), F.size(F.collect_set("pos")).alias("n"))
    # written, so that both sides of the next join are plain shuffles, which adaptive execution can split
    gone = stage(gone, "gone").select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "gone", "n")
    extra = [F.col(name).alias(f"_carried_{name}") for name in carry or []]
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)
    source = source.withColumn("mark", F.xxhash64("text"))
    joined = source.join(gone, source["id"].eqNullSafe(gone["_id"]) & (source["mark"] == gone["_mark"]), "left")
    stays = F.filter(split_lines(F.col("text")), lambda line, at: ~F.coalesce(F.get("gone", at), F.lit(False)))
    return joined.select(
        F.col("id").alias(id_column),
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
        *[F.col(f"_carried_{name}").alias(name) for name in carry or []],
    )
