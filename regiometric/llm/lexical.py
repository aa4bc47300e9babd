"""Ranked lexical search, a term at a time with a limited set of accumulators.

A block is some megabytes of documents with the inverted lists of the query terms in them. A query goes through its terms
from the rarest to the most frequent, adding to one accumulator per document. The most that the remaining terms can add
is known from the largest entry of each list; once that is below the score of the k-th best accumulator, no document
without an accumulator can be an answer, so none is created any more, and those that exist are brought up to their exact
scores. The k-th best score of a task's earlier blocks counts too. Scores need numbers of the whole collection, so that a
first pass writes the blocks and counts, and a second one searches them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regiometric.llm.words import LOWER, find_words, hash_words, slices, tidy
from regiometric.session import stage

ANSWERS = 20
BLOCK_BYTES = 8 << 20
PART_TERMS = 200_000
FILTER_BITS = 16
#: Bytes of terms as they are, A to Z in lower case, and a space for every separator: ASCII signs and blanks.
TERM_BYTES = LOWER.copy()
TERM_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 32


def query_terms(items: DataFrame, item_column: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``term`` (a 64-bit hash) and ``times`` of every item; of several texts of one id, the smallest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = find_words(batch.column("text"), through=TERM_BYTES)
                pairs = np.stack([words.text_of().astype(np.uint64), hash_words(words)])
                (row, term), times = np.unique(pairs, axis=1, return_counts=True) if pairs.size else (pairs, pairs[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array(row.astype(np.int64))), pa.array(term.view(np.int64)),
                     pa.array(times.astype(np.int64))], ["item", "term", "times"],
                )

    given = items.select(F.col(item_column).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = given.schema["item"].dataType.simpleString()
    one = given.groupBy("item").agg(F.min("text").alias("text"))
    return one.mapInArrow(tidy(run), f"item {kind}, term long, times long")


class Queries:
    """Items with their terms. ``vocabulary``: the distinct terms in ascending order; item i has the terms
    ``term[first[i]:first[i + 1]]`` (places in the vocabulary) so many ``times`` each."""

    def __init__(self, rows: pa.Table):
        codes = rows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        self.items = codes.dictionary
        item = codes.indices.to_numpy()
        self.vocabulary, term = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
        order = np.lexsort((term, item))
        self.term, self.times = term[order], rows.column("times").to_numpy()[order]
        self.first = np.searchsorted(item[order], np.arange(len(self.items) + 1))
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.vocabulary >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``hashes`` that are query terms, and their places in the vocabulary."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes[at]
        return at[same], place[same]


def query_parts(terms: DataFrame, part_terms: int = PART_TERMS) -> Iterator[Queries]:
    """All items in parts of about ``part_terms`` terms, which is what goes to all tasks at a time."""
    parts = max(1, -(-terms.count() // part_terms))
    for part in range(parts):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow()
        if rows.num_rows:
            yield Queries(rows)


def blocks(docs: DataFrame, queries: Queries, text: str, id_column: str) -> DataFrame:
    """One row per block: how many documents and terms it has in all, ids and lengths of the documents with query terms,
    and the inverted lists: ``term``, ``size`` and, one list after the other, ``doc`` (its place in ``ids``) and ``tf``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                words = find_words(batch.column("text"), through=TERM_BYTES)
                lengths = np.diff(words.first)
                at, place = queries.find(hash_words(words))
                row = np.searchsorted(words.first, at, side="right") - 1
                codes, tf = np.unique(place * np.int64(batch.num_rows) + row, return_counts=True)
                term, row = codes // batch.num_rows, codes % batch.num_rows
                used, doc = np.unique(row, return_inverse=True)
                terms, size = np.unique(term, return_counts=True)
                ids = batch.column("id").take(pa.array(used))
                lists = [ids, *map(pa.array, (lengths[used], terms, size, doc, tf))]
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                counts = [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])]
                yield pa.RecordBatch.from_arrays(
                    [*counts, *one], ["n_docs", "n_terms", "ids", "lengths", "term", "size", "doc", "tf"]
                )

    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    lists = ", ".join(f"{name} array<long>" for name in ("lengths", "term", "size", "doc", "tf"))
    return source.mapInArrow(tidy(run), f"n_docs long, n_terms long, ids array<{kind}>, {lists}")


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """The weight of a term that is in ``df`` of ``documents`` documents."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term of weight one adds to the score of a document of each length in which it occurs ``tf`` times."""
    if 25 * int(lengths.max(initial=0)) * documents >= 1 << 63:
        lengths = lengths.astype(object)
    m = (75 + (25 * lengths * documents) // max(terms, 1)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def rank_block(
    lists: list[tuple[np.ndarray, np.ndarray, int]], documents: int, k: int, threshold: int
) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block and their scores: all that have ``threshold`` or more and may be among the ``k`` best.

    ``lists``: documents, what the term adds to each, and the most that it adds, from the rarest term to the most frequent.
    """
    left = np.cumsum([most for _, _, most in lists][::-1])[::-1].tolist()
    scores, held, creating = np.zeros(documents, dtype=np.int64), np.zeros(documents, dtype=bool), True
    for (docs, adds, _), remaining in zip(lists, left, strict=True):
        creating = creating and remaining >= threshold
        if creating:
            held[docs] = True
            scores[docs] += adds
            if int(held.sum()) >= k:
                threshold = max(threshold, int(np.partition(scores, documents - k)[documents - k]))
        else:
            known = held[docs]
            scores[docs[known]] += adds[known]
    found = np.flatnonzero(held & (scores > 0) & (scores >= threshold))
    return found, scores[found]


def search_blocks(
    staged: DataFrame, queries: Queries, df: np.ndarray, documents: int, terms: int, k: int, schema: str
) -> DataFrame:
    """``item``, ``id``, ``score``: the ``k`` best documents of every block for every item, less those that are too low."""
    weights = term_weights(df, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(queries.items), k), dtype=np.int64)  # the k best scores of earlier blocks, ascending
        for batch in batches:
            for row in range(batch.num_rows):
                lists = {name: batch.column(name).slice(row, 1).flatten() for name in batch.schema.names[2:]}
                ids = lists["ids"]
                length, term, size, doc, tf = (lists[x].to_numpy() for x in ("lengths", "term", "size", "doc", "tf"))
                if not len(doc):
                    continue
                adds = impacts(tf, length[doc], documents, terms)
                begin = np.concatenate([[0], np.cumsum(size)])
                most = np.maximum.reduceat(adds, begin[:-1])
                place = np.full(len(queries.vocabulary), -1)
                place[term] = np.arange(len(term))
                order_of = np.empty(len(ids), dtype=np.int64)  # ties go to the smaller id, null ids last
                order_of[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                who, docs, scores = [], [], []
                for item in range(len(queries.items)):
                    mine = slice(queries.first[item], queries.first[item + 1])
                    at, times = queries.term[mine], queries.times[mine]
                    here = place[at] >= 0
                    at, times = at[here], times[here]
                    rarest = np.lexsort((at, df[at]))
                    plan = []
                    for t, q in zip(at[rarest].tolist(), times[rarest].tolist(), strict=True):
                        p, w = place[t], int(weights[t]) * q
                        span = slice(begin[p], begin[p + 1])
                        plan.append((doc[span], w * adds[span], w * int(most[p])))
                    found, score = rank_block(plan, len(ids), k, int(best[item, 0]))
                    first = np.lexsort((order_of[found], -score))[:k]
                    found, score = found[first], score[first]
                    best[item] = np.sort(np.concatenate([best[item], score]))[-k:]
                    who.append(np.full(len(found), item))
                    docs.append(found)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays(
                    [queries.items.take(pa.array(np.concatenate(who))), ids.take(pa.array(np.concatenate(docs))),
                     pa.array(np.concatenate(scores))], ["item", "id", "score"],
                )

    return staged.mapInArrow(tidy(run), schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = ANSWERS,
    text: str = "text",
    id_column: str = "doc_id",
    item_column: str = "item_id",
    item_text: str = "text",
    part_terms: int = PART_TERMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` documents with the highest scores above 0 for every item.

    Terms are runs of letters and digits, non-ASCII characters included, with A to Z in lower case; a null text has none.
    Equal scores go to the smaller id, null ids last. Every document row counts and ranks by itself, repeated rows too. An
    item is an id, null as well; its smallest text counts if it has several. Items without terms and an empty
    table give no rows. Other columns are ignored. Terms are told apart by 64-bit hashes. The items go to the tasks in
    parts of ``part_terms`` terms, each of which reads the documents once.
    """
    terms = stage(query_terms(items, item_column, item_text), "terms")
    kinds = docs.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    schema = "item {1}, id {0}, score long".format(*kinds)
    found = docs.sparkSession.createDataFrame([], schema)
    for queries in query_parts(terms, part_terms):
        staged = stage(blocks(docs, queries, text, id_column), "blocks")
        total = staged.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).collect()[0]
        sizes = staged.select(F.explode(F.arrays_zip("term", "size")).alias("p")).groupBy("p.term")
        df = np.zeros(len(queries.vocabulary), dtype=np.int64)
        for row in sizes.agg(F.sum("p.size").alias("n")).collect():
            df[row.term] = row.n
        if df.any():
            lists = staged.select("n_docs", "n_terms", "ids", "lengths", "term", "size", "doc", "tf")
            found = found.unionByName(search_blocks(lists, queries, df, total.docs, total.terms, k, schema))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
