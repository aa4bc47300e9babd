"""Removal of long repeated word runs by a compacted de Bruijn graph.

An edge of the graph is a window of ``window`` words; it joins the node of its first words to that of its last. Windows
in a row that share their minimiser (the smallest hash among their 8-word runs, leftmost if equal) form a piece of a
path. A repeated window is a repeated minimiser too, so a join by minimiser finds every piece that can hold one:

* pieces of a minimiser that has one context only do not branch. They stand for all their edges: repeated as a whole
  if the minimiser occurs twice, and never opened;
* pieces of a minimiser with several contexts branch. Each distinct one is opened into single edges once, and edges are
  counted by content.

Repeated pieces and edges go back to their source coordinates, where they merge into spans. Edges are compared by
128-bit hashes of their words, pieces by 64 bits of their minimiser and 64 of their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometric.llm.words import SECOND_BASE, Runs, Words, find_words, hash_words, slices, tidy
from regiometric.session import stage

WINDOW = 35
SEED_WORDS = 8
KEYS = ["k1", "k2"]


def sliding_minimum(hashes: np.ndarray, size: int) -> np.ndarray:
    """Position of the smallest value among ``size`` in a row, the leftmost if equal, for every start."""
    places = np.arange(len(hashes))
    width = 1

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] < hashes[a], b, a)

    while 2 * width <= size:
        places = smaller(places[: len(places) - width], places[width:])
        width *= 2
    if width < size:
        places = smaller(places[: len(places) - (size - width)], places[size - width :])
    return places


def _seed_hashes(words: Words, hashes: np.ndarray, seed: int) -> tuple[np.ndarray, Runs]:
    runs = Runs.of(hashes)
    starts = np.arange(max(len(hashes) - seed + 1, 0))
    return runs.hash(starts, seed), runs


def path_pieces(words: Words, window: int = WINDOW, seed: int = SEED_WORDS) -> dict[str, np.ndarray]:
    """Pieces of every text: text number, first window, number of windows, and hashes of minimiser and content."""
    hashes = hash_words(words)
    counts = np.diff(words.first)
    none = {k: np.zeros(0, dtype=np.int64) for k in ("text", "start", "windows", "seed", "c1")}
    if not (counts >= window).any():
        return none
    seeds, runs = _seed_hashes(words, hashes, seed)
    place = sliding_minimum(seeds, window - seed + 1)
    text_of = words.text_of()
    starts = np.arange(len(place))
    inside = starts + window <= words.first[text_of[starts] + 1]
    starts = starts[inside]
    place = place[inside]
    text = text_of[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(starts))
    begin = starts[first]
    span = size + window - 1
    return {
        "text": text[first],
        "start": begin - words.first[text[first]],
        "windows": size,
        "seed": seeds[place[first]].view(np.int64),
        "c1": runs.hash(begin, span).view(np.int64),
    }


def kept_mask(count: int, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Words of a text that lie in none of the given windows."""
    change = np.zeros(count + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + windows + window - 1, -1)
    return np.cumsum(change[:-1]) == 0


def _keyed(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """Rows with a 128-bit key of id and text; rows that agree in both share their key and their result."""
    value = F.col(text)
    given = F.col(id_column).cast("string")
    return docs.withColumns({"k1": F.xxhash64(given, value), "k2": F.xxhash64(value, F.lit("|"), given)})


def repeated_windows(base: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """Windows whose word sequence starts in two places or more, as ``k1``, ``k2``, ``start``, ``windows`` in a row.

    ``base`` has the keys ``k1``, ``k2`` and ``text``. A row may be listed more than once. The opened texts are found by
    a join with ``base`` as it is, so that a caller's own join of it by the keys can use the same exchange.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = path_pieces(find_words(batch.column("text")), window, seed)
                rows = pa.array(found.pop("text"))
                keys = [batch.column(key).take(rows) for key in KEYS]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, found.values())], [*KEYS, *found])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = find_words(batch.column("text"))
                hashes = hash_words(words)
                runs, second = Runs.of(hashes), Runs.of(hashes, SECOND_BASE)
                opened = batch.column("opened")
                lists = opened.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), lists)
                flat = opened.flatten()
                start, size, copies = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                row, copies = np.repeat(row, size), np.repeat(copies, size)
                local = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                at = words.first[row] + local
                keys = [batch.column(key).take(pa.array(row)) for key in KEYS]
                values = [local, copies, runs.hash(at, window).view(np.int64), second.hash(at, window).view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *map(pa.array, values)], [*KEYS, "start", "copies", "c1", "c2"]
                )

    found = base.select(*KEYS, "text").mapInArrow(tidy(pieces), "k1 long, k2 long, start long, windows long, seed long, c1 long")
    seeds = (
        found.groupBy("seed")
        .agg(F.count(F.lit(1)).alias("n"), F.min("c1").alias("low"), F.max("c1").alias("high"))
        .filter("n > 1")
        .select("seed", (F.col("low") != F.col("high")).alias("branches"))
    )
    seeds = stage(seeds, "seeds")  # so that the join's sides are plain and a crowded seed can be split
    placed = stage(found.join(seeds, "seed"), "pieces")
    whole = placed.filter("not branches").select(*KEYS, "start", "windows")
    branching = placed.filter("branches")
    content = ["seed", "c1"]
    distinct = branching.groupBy(*content).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEYS, "start", "windows")).alias("at")
    )
    distinct = stage(distinct, "contents")
    # every branching piece finds the one row of its content, so the join makes a row per piece whatever repeats; those
    # whose content is held by one piece are left out after it
    several = F.when(F.col("copies") > 1, F.col("windows"))
    counted = branching.join(distinct.select(*content, "copies"), content, "left")
    copied = counted.select(*KEYS, "start", several.alias("windows")).filter("windows > 0")
    opened = distinct.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.collect_list(F.struct("at.start", "at.windows", "copies")).alias("opened")
    )
    schema = "k1 long, k2 long, start long, copies long, c1 long, c2 long"
    single = base.join(opened, KEYS).mapInArrow(tidy(edges), schema)
    again = single.groupBy("c1", "c2").agg(F.sum("copies").alias("n")).filter("n > 1").select("c1", "c2")
    lone = single.filter("copies = 1").join(again, ["c1", "c2"])
    return whole.unionByName(copied).unionByName(lone.select(*KEYS, "start", F.lit(1).cast("long").alias("windows")))


def _results(batch: pa.RecordBatch, window: int, with_text: bool) -> pa.RecordBatch:
    words = find_words(batch.column("text"))
    spans = batch.column("spans")
    lists = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists)
    flat = spans.flatten()
    start, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    data = words.data.tobytes()
    total, removed, digests, texts = [], [], [], []
    for row in range(batch.num_rows):
        low, high = int(words.first[row]), int(words.first[row + 1])
        begin, end = words.starts[low:high], words.ends[low:high]
        own = slice(ends[row] - lists[row], ends[row])
        keep = kept_mask(high - low, start[own], size[own], window)
        pairs = zip(begin[keep].tolist(), end[keep].tolist(), strict=True)
        joined = b" ".join([data[s:e] for s, e in pairs])
        total.append(high - low)
        removed.append(int(high - low - keep.sum()))
        digests.append(hashlib.sha256(joined).hexdigest())
        if with_text:
            value = data[words.offsets[row] : words.offsets[row + 1]]
            texts.append(_cut(value, begin - words.offsets[row], end - words.offsets[row], keep).decode())
    columns = [batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
    names = ["row", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        columns.append(pa.array(texts, pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(columns, names)


def _cut(value: bytes, begin: np.ndarray, end: np.ndarray, keep: np.ndarray) -> bytes:
    """The text without the removed words: each run of them goes with the white space before it."""
    if keep.all():
        return value
    parts, at = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[1], keep.astype(np.int8), [1]])))
    for first, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        parts.append(value[at : end[first - 1] if first else 0])
        at = int(end[stop - 1])
    parts.append(value[at:])
    return b"".join(parts)


def remove_repeated(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    window: int = WINDOW,
    carry: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked, ``kept_text``.

    A word goes if a window of ``window`` words of its text covers it whose sequence also starts elsewhere in the
    table, the same text included. ``kept_sha256`` is over the kept words joined by one space; ``kept_text`` keeps the
    white space between them, and is the text itself where nothing goes. Columns in ``carry`` are passed on. A null text
    has no words. Repeated rows count as further places, so their long runs go. Rows of a null id are treated like
    others. Other columns are ignored, whatever their names.
    """
    carried = list(dict.fromkeys([id_column, *(carry or [])]))
    row = F.struct(*[F.col(name).alias(f"f{i}") for i, name in enumerate(carried)])
    base = _keyed(docs.select(F.col(text).alias("text"), F.col(id_column).alias("id"), row.alias("row")), "text", "id")
    base = base.select(*KEYS, "row", "text")
    spans = repeated_windows(base, window).groupBy(*KEYS).agg(
        F.collect_set(F.struct("start", "windows")).alias("spans")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield _results(batch, window, with_text)

    kind = base.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    joined = base.join(spans, KEYS, "left").select("row", "text", "spans")
    done = joined.mapInArrow(tidy(finish), schema)
    fields: list[Column] = [F.col("row")[f"f{i}"].alias(name) for i, name in enumerate(carried)]
    return done.select(*fields, *[name for name in done.columns if name != "row"])
