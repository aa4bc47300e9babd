"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. The index is cut into blocks of rows; each block posts its
rows in the inverted files of their nearest pivots, with the pivot's place in the row's order. A query walks through the
files of its own nearest pivots and adds up by how many places the two orders differ (the footrule distance; a row that
a file lacks counts as the place after the last one posted). The best share of each block is reranked by true distance,
with all rows that tie with the last of them. Equal vectors are indexed once, with the ids that may be answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regiometric.llm.words import tidy
from regiometric.session import stage

PIVOTS = 128
POSTED = 96
SEARCHED = 48
SHARE = 0.2
LEAST_RERANKED = 256
BLOCK_ROWS = 2048
NEIGHBOURS = 10


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part.

    Null vectors, zero vectors and those with a null or non-finite component are left out, as are rows without an id
    and rows of another length than the most frequent one (the smallest, if several are).
    """
    whole = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    infinite = float("inf")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    some = F.exists("vector", lambda x: x != 0)
    whole = whole.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine & some)
    top = whole.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return whole.filter(F.size("vector") == (top[0]["n"] if top else 0))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` distinct vectors, picked by a hash of their components."""
    marked = vectors.withColumn("h", F.xxhash64("vector"))
    hashes = [row.h for row in marked.select("h").distinct().orderBy("h").limit(pivots).collect()]
    if not hashes:
        return np.zeros((0, 0))
    picked = marked.filter(F.col("h").isin(hashes)).groupBy("h").agg(F.min("vector").alias("vector"))
    return np.array([row.vector for row in picked.orderBy("h").collect()])


def orders(vectors: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest pivots of each vector, nearest first."""
    scale = np.abs(pivots).max()
    v, p = vectors / scale, pivots / scale
    return np.argsort((p**2).sum(1)[None] - 2 * v @ p.T, axis=1, kind="stable")[:, :most]


class Block:
    """The inverted files of some distinct vectors; vector i has the ids ``ids[first_id[i]:first_id[i + 1]]``."""

    def __init__(
        self, ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, posted: int
    ):
        self.ids, self.vectors, self.posted = ids, vectors, min(posted, len(pivots))
        self.sizes, self.first_id = sizes, np.concatenate([[0], np.cumsum(sizes)])
        order = orders(vectors, pivots, self.posted)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = by_pivot // self.posted
        self.places = (by_pivot % self.posted).astype(np.int32)
        self.first = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, share: float, k: int) -> tuple:
        footrule = np.zeros(len(self.vectors), dtype=np.int64)
        for place, pivot in enumerate(order.tolist()):
            span = slice(self.first[pivot], self.first[pivot + 1])
            absent = abs(self.posted - place)
            footrule[self.rows[span]] += np.abs(self.places[span] - place) - absent
        most = min(len(footrule), max(LEAST_RERANKED, int(np.ceil(share * len(footrule)))))
        best = np.flatnonzero(footrule <= np.partition(footrule, most - 1)[most - 1])
        distance = np.sqrt(((self.vectors[best] - query) ** 2).sum(axis=1))
        sizes = self.sizes[best]
        at = np.arange(int(sizes.sum())) + np.repeat(self.first_id[best] - np.cumsum(sizes) + sizes, sizes)
        ids, distance = self.ids[at], np.repeat(distance, sizes)
        other = ids != query_id
        ids, distance = ids[other], distance[other]
        top = np.lexsort((ids, distance))[:k]
        return ids[top], distance[top]


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``vector`` and ``ids`` of every distinct vector: the smallest ids, repeats included, of which ``k`` or all are
    left when any one id is taken out."""
    counted = rows.groupBy("vector", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    place = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    first = counted.withColumn("place", place).filter(F.col("place") <= k + 1)
    ids = F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(id, times)"))))
    return first.groupBy("vector").agg(ids.alias("ids"))


def nearest(
    vectors: DataFrame,
    is_query: Column | None = None,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    share: float = SHARE,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows found for every query.

    ``is_query`` is a condition on ``id``; without it the queries are the ids divisible by 100. A row is no neighbour of
    queries of its own id. Nearness is the Euclidean distance of the given vectors; ties go to the smaller id.
    ``usable`` says which rows take part. Repeated rows are neighbours once each, and a repeated query id is answered
    once, for the row with the smallest vector. An empty table, or one without queries, gives no rows.
    """
    rows = usable(vectors, id_column, vector)
    points = choose_pivots(rows, pivots)
    wanted = F.col("id") % 100 == 0 if is_query is None else is_query
    once = stage(distinct_vectors(rows, k), "vectors")
    blocks = max(1, -(-once.count() // block_rows))
    spread = F.pmod(F.xxhash64("vector", F.lit("block")), F.lit(blocks)).cast("int")
    index = once.select(spread.alias("block"), F.lit(False).alias("query"), "ids", "vector")
    asked = rows.filter(wanted).groupBy("id").agg(F.min("vector").alias("vector"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = asked.select(every.alias("block"), F.lit(True).alias("query"), F.array("id").alias("ids"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            number = batch.column("block").to_numpy()
            query = batch.column("query").to_numpy(zero_copy_only=False)
            lists = batch.column("ids")
            ids, sizes_of = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            begin = np.concatenate([[0], np.cumsum(sizes_of)])
            matrix = batch.column("vector").flatten().to_numpy().reshape(len(number), -1)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for at in np.split(np.arange(len(number)), edges):
                if not len(at):
                    continue
                if current != number[at[0]]:
                    current, parts, block = number[at[0]], [], None
                if not query[at[0]]:
                    parts.append((ids[begin[at[0]] : begin[at[-1] + 1]], sizes_of[at], matrix[at]))
                    continue
                if block is None:
                    if not parts:
                        continue  # a block without rows
                    block = Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), points, POSTED)
                order = orders(matrix[at], points, min(SEARCHED, len(points)))
                found = [block.search(ids[begin[i]], matrix[i], order[j], share, k) for j, i in enumerate(at)]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[begin[at]], sizes)),
                        pa.array(np.concatenate([f[0] for f in found])),
                        pa.array(np.concatenate([f[1] for f in found])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    dealt = index.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "query")
    found = dealt.mapInArrow(tidy(run), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
