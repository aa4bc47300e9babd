"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors that lie near each other form a minimum spanning tree. The root is scored against all candidates of a stripe. The
score of a child differs from that of its parent by the inner product of the edge with the candidate, so by no more than
the length of the edge times the norm of the candidate; the interval that the parent knows, widened by that, holds the
child's score. Only candidates whose interval reaches into the child's window are scored again, and hand exact scores on;
the others hand on what is known. A first pass finds every anchor's positives, a second one the negatives in the windows
that their scores open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regiometric.llm.words import tidy
from regiometric.session import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
STRIPE_ROWS = 8192
TREE_ANCHORS = 64
PIVOTS = 64
SALTED_ANCHORS = 4096
WANTED = "array<struct<id:long,score:long>>"


def usable(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE
) -> DataFrame:
    """``id``, ``label`` and ``vector`` (whole numbers: ``scale`` times each component, rounded down) of the rows that take
    part, one per id: that with the smallest label, then vector.

    Rows without id, label or components, with a null or non-finite component, and of another length than the most frequent
    one (the smallest, if several are) are left out. Inner products have to fit in 64 bits.
    """
    whole = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    infinite = float("inf")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    whole = whole.dropna(subset=["id", "label", "vector"]).filter((F.size("vector") > 0) & fine)
    whole = whole.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))
    top = whole.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    whole = whole.filter(F.size("vector") == (top[0]["n"] if top else 0))
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("id", "row.label", "row.vector")


def matrix_of(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which parents come before children, and each one's parent's place in it (-1: the root)."""
    rest = np.arange(1, len(points))
    distance = np.linalg.norm((points[rest] - points[0]).astype(float), axis=1)
    nearest = np.zeros(len(rest), dtype=np.int64)
    order, parents = [0], [-1]
    while len(rest):
        k = int(np.argmin(distance))
        new = int(rest[k])
        order.append(new)
        parents.append(int(nearest[k]))
        keep = np.arange(len(rest)) != k
        rest, distance, nearest = rest[keep], distance[keep], nearest[keep]
        to_new = np.linalg.norm((points[rest] - points[new]).astype(float), axis=1)
        closer = to_new < distance
        distance[closer], nearest[closer] = to_new[closer], len(order) - 1
    return np.array(order), np.array(parents)


def anchor_trees(anchors: DataFrame, pivots: int = PIVOTS, tree_anchors: int = TREE_ANCHORS) -> DataFrame:
    """``tree``, ``place``, ``parent`` (a place), ``id``, ``label``, ``vector`` of every anchor.

    Anchors with the same nearest pivot are dealt to trees of at most ``tree_anchors``; crowded pivots are salted first.
    ``pivots`` distinct anchors, picked by a hash, are all that goes to the driver.
    """
    hashes = [r.h for r in anchors.select(F.xxhash64("vector").alias("h")).distinct().orderBy("h").limit(pivots).collect()]
    marked = anchors.withColumn("h", F.xxhash64("vector")).filter(F.col("h").isin(hashes or [0]))
    points = [r.vector for r in marked.groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").collect()]
    points = np.array(points, dtype=float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix_of(batch).astype(float)
                near = np.argmin((points**2).sum(1)[None] - 2 * v @ points.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near), *batch.columns], ["pivot", *batch.schema.names])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def tree() -> pa.RecordBatch:
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            order, parents = spanning_tree(vectors)
            flat = pa.array(vectors[order].ravel())
            cuts = pa.array(np.arange(len(order) + 1, dtype=np.int32) * vectors.shape[1], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(order), ids[0])), pa.array(np.arange(len(order), dtype=np.int32)),
                 pa.array(parents.astype(np.int32)), pa.array(ids[order]), pa.array(labels[order]),
                 pa.ListArray.from_arrays(cuts, flat)],
                ["tree", "place", "parent", "id", "label", "vector"],
            )

        for batch in batches:
            pivot, salt = batch.column("pivot").to_numpy(), batch.column("salt").to_numpy()
            ids, labels, vectors = batch.column("id").to_numpy(), batch.column("label").to_numpy(), matrix_of(batch)
            for at in range(batch.num_rows):
                if held and (key != (pivot[at], salt[at]) or len(held) >= tree_anchors):
                    yield tree()
                    held = []
                key = (pivot[at], salt[at])
                held.append((ids[at : at + 1], labels[at : at + 1], vectors[at : at + 1]))
        if held:
            yield tree()

    near = stage(anchors.mapInArrow(tidy(place), "pivot long, id long, label int, vector array<long>"), "near")
    salts = F.ceil(F.count(F.lit(1)) / SALTED_ANCHORS)
    crowded = near.groupBy("pivot").agg(salts.alias("salts"))  # at most one row per pivot
    salted = near.join(F.broadcast(crowded), "pivot").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    dealt = salted.select("pivot", "salt", "id", "label", "vector").repartition("pivot", "salt")
    ordered = dealt.sortWithinPartitions("pivot", "salt", "id")
    return ordered.mapInArrow(tidy(build), "tree long, place int, parent int, id long, label int, vector array<long>")


class Stripe:
    """Candidates of one stripe, and what is known of their scores with the anchors of the current tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norms = np.linalg.norm(vectors.astype(float), axis=1) * (1 + 1e-9)
        self.known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scored = 0

    def visit(
        self, anchor: np.ndarray, parent: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates that ``wanted`` picks by the bounds (low, high) of all scores.

        Anchors come in the order of their tree; a root has ``parent`` -1.
        """
        if parent < 0:
            self.known = []
            low = high = (self.vectors @ anchor).astype(float)
            self.scored += len(self.ids)
        else:
            before, low, high = self.known[parent]
            edge = np.linalg.norm((anchor - before).astype(float))
            slack = edge * self.norms + 1e-15 * np.maximum(np.abs(low), np.abs(high)) if edge else 0.0
            low, high = low - slack, high + slack
        at = np.flatnonzero(wanted(low, high))
        scores = self.vectors[at] @ anchor
        if parent >= 0:
            self.scored += len(at)
            low[at] = high[at] = scores
        self.known.append((anchor, low, high))
        return at, scores


def reach(low: np.ndarray, high: np.ndarray, sure: np.ndarray, possible: np.ndarray, k: int) -> np.ndarray:
    """Those of ``possible`` that may be among the ``k`` highest; ``sure`` are known to take part."""
    floor = low[sure]
    if len(floor) < k:
        return possible
    return possible & (high >= np.partition(floor, len(floor) - k)[len(floor) - k])


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def find_positives(stripe: Stripe, row: dict, k: int) -> list[tuple]:
    same = (stripe.labels == row["label"]) & (stripe.ids != row["id"])
    at, scores = stripe.visit(row["vector"], row["parent"], lambda low, high: reach(low, high, same, same, k))
    ids = stripe.ids[at]
    return [(row["id"], int(ids[i]), int(scores[i]), None) for i in first_of(ids, scores, k)]


def find_negatives(stripe: Stripe, row: dict, k: int, lowest: int, highest: int) -> list[tuple]:
    other = stripe.labels != row["label"]
    windows = {p["score"] for p in row["wanted"] or [] if lowest * p["score"] <= highest * p["score"]}

    def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        picked = np.zeros(len(low), dtype=bool)
        for score in windows:
            bottom, top = lowest * score / 100, highest * score / 100
            edge = 1 + 1e-15 * abs(score)
            possible = other & (high >= bottom - edge) & (low <= top + edge)
            sure = possible & (low >= bottom + edge) & (high <= top - edge)
            picked |= reach(low, high, sure, possible, k)
        return picked

    at, scores = stripe.visit(row["vector"], row["parent"], wanted)
    out = []
    for positive in row["wanted"] or []:
        score = positive["score"]
        inside = (lowest * score <= 100 * scores) & (100 * scores <= highest * score)
        ids, found = stripe.ids[at[inside]], scores[inside]
        out += [(row["id"], positive["id"], int(found[i]), int(ids[i])) for i in first_of(ids, found, k)]
    return out


def through_stripes(
    rows: DataFrame, anchors: DataFrame, stripes: int, find: Callable[[Stripe, dict], list[tuple]]
) -> DataFrame:
    """``anchor``, ``positive``, ``score``, ``negative`` as ``find`` gives them for every anchor in every stripe."""
    spread = F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int")
    no = F.lit(None)
    candidates = rows.select(
        spread.alias("stripe"), F.lit(False).alias("anchor"), no.cast("long").alias("tree"), no.cast("int").alias("place"),
        no.cast("int").alias("parent"), "id", "label", "vector", no.cast(WANTED).alias("wanted"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")
    asked = anchors.select(every, F.lit(True).alias("anchor"), "tree", "place", "parent", "id", "label", "vector", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, stripe = None, [], None
        for batch in batches:
            of, anchor = batch.column("stripe").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            parent = batch.column("parent").fill_null(-1).to_numpy()
            ids, labels, vectors = batch.column("id").to_numpy(), batch.column("label").to_numpy(), matrix_of(batch)
            edges = np.flatnonzero((np.diff(of) != 0) | (np.diff(anchor.astype(np.int8)) != 0)) + 1
            for at in np.split(np.arange(batch.num_rows), edges):
                if not len(at):
                    continue
                if number != of[at[0]]:
                    number, parts, stripe = of[at[0]], [], None
                if not anchor[at[0]]:
                    parts.append((ids[at], labels[at], vectors[at]))
                    continue
                if stripe is None:
                    if not parts:
                        continue  # a stripe without rows
                    stripe = Stripe(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                found = []
                for i, windows in zip(at.tolist(), batch.column("wanted").slice(at[0], len(at)).to_pylist(), strict=True):
                    row = {"id": int(ids[i]), "label": labels[i], "vector": vectors[i], "parent": int(parent[i])}
                    found += find(stripe, row | {"wanted": windows})
                if found:
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], ["anchor", "positive", "score", "negative"]
                    )

    dealt = candidates.unionByName(asked).repartition(stripes, "stripe")
    ordered = dealt.sortWithinPartitions("stripe", "anchor", "tree", "place")
    return ordered.mapInArrow(tidy(run), "anchor long, positive long, score long, negative long")


def mine(
    vectors: DataFrame,
    is_anchor: Column | None = None,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    stripe_rows: int = STRIPE_ROWS,
    tree_anchors: int = TREE_ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on ``id``; without it the anchors are the ids divisible by 100. An anchor's positives are
    the ``positives`` other rows of its label with the highest inner product, ties to the smaller id. For each, the
    ``negatives`` rows of other labels with the highest inner product among those from ``low`` to ``high`` per cent of the
    positive's; none qualifies for a negative positive score. ``usable`` says which rows take part. An empty table, or one
    without anchors, gives no rows. Other columns are ignored. Every anchor meets every stripe of ``stripe_rows`` rows.
    """
    rows = stage(usable(vectors, id_column, vector, label, scale), "vectors")
    stripes = max(1, -(-rows.count() // stripe_rows))
    chosen = rows.filter(F.col("id") % 100 == 0 if is_anchor is None else is_anchor)
    trees = stage(anchor_trees(chosen, tree_anchors=tree_anchors), "trees")
    nothing = trees.withColumn("wanted", F.lit(None).cast(WANTED))
    found = through_stripes(rows, nothing, stripes, lambda stripe, row: find_positives(stripe, row, positives))
    order = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "positive"))
    best = found.withColumn("rank", order).filter(F.col("rank") <= positives)
    best = stage(best.select("anchor", F.struct(F.col("positive").alias("id"), "score").alias("positive")), "positives")
    listed = best.groupBy("anchor").agg(F.sort_array(F.collect_list("positive")).alias("wanted"))  # few each
    asked = trees.join(listed.withColumnRenamed("anchor", "id"), "id", "left")
    pairs = through_stripes(rows, asked, stripes, lambda stripe, row: find_negatives(stripe, row, negatives, low, high))
    order = F.row_number().over(W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "negative"))
    pairs = pairs.withColumn("rank", order).filter(F.col("rank") <= negatives)
    scores = best.select("anchor", F.col("positive.id").alias("positive"), F.col("positive.score").alias("positive_score"))
    return pairs.join(scores, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
