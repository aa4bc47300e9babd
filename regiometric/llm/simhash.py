"""Near duplicates by SimHash fingerprints and a covering code of anchor points.

The 64 bits are taken as two halves. Two fingerprints that differ in at most three bits differ in at most one bit in
one of the halves. Each half is 31 bits, covered with radius 1 by the words of the perfect Hamming code of length 31,
and one bit that stands for itself. A fingerprint lives at its nearest anchor and is replicated to every anchor within
the covering radius plus one bit, which are at most 17 a half: the anchor where the one lives gets a copy of the other.
Fingerprints are compared only with those that live at the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric.llm.components import connected_components
from regiometric.llm.words import slices, tidy
from regiometric.session import stage

SEED = 42
SHINGLE = 3
MOST_BITS = 3
BLOCK_HOMES = 2048
BLOCK_PAIRS = 1 << 20
_PLACES = np.arange(1, 32, dtype=np.uint64)


def fingerprint_batch(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text over the XXH64 hashes of its lower-cased word shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(line, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes.extend([digest(line[s:e], SEED) for s, e in spans])
        counts[i] = len(words) - shingle + 1
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        values = np.array(hashes, dtype="<u8")
        firsts = (np.cumsum(counts) - counts)[full]
        sums = np.zeros((len(full), 64), dtype=np.int64)
        block = 1 << 16  # hashes unpacked at a time
        for at in range(0, len(values), block):
            bits = np.unpackbits(values[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            low = int(np.searchsorted(firsts, at, side="right")) - 1
            high = int(np.searchsorted(firsts, at + len(bits), side="left"))
            cuts = np.maximum(firsts[low:high] - at, 0)
            sums[low:high] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        major = (2 * sums > counts[full, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``id_column`` and ``fp`` (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values = fingerprint_batch(batch.column("text").to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values)], ["id", "fp"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"id {kind}, fp long").withColumnRenamed("id", id_column)


def _syndromes(halves: np.ndarray) -> np.ndarray:
    """XOR of the places of the set bits among bits 0 to 30; place p is bit p - 1. Zero for words of the code."""
    out = np.zeros_like(halves)
    for place in _PLACES:
        out ^= ((halves >> (place - np.uint64(1))) & np.uint64(1)) * place
    return out


def _bit(places: np.ndarray) -> np.ndarray:
    """Mask of the bit at a place; none for place 0."""
    return np.where(places > 0, np.uint64(1) << (np.maximum(places, 1) - np.uint64(1)), np.uint64(0))


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row number and whether the row lives there, for every anchor that a row is sent to."""
    out, rows, homes = [], [], []
    everyone = np.arange(len(fps))
    for half in (0, 1):
        value = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half) << np.uint64(32)
        places = _syndromes(value)
        home = value ^ _bit(places)

        def add(anchor: np.ndarray, who: np.ndarray, lives: bool, tag: np.uint64 = tag) -> None:
            out.append(anchor | tag)
            rows.append(who)
            homes.append(np.full(len(who), lives))

        add(home, everyone, True)
        add(home ^ np.uint64(1 << 31), everyone, False)
        for place in _PLACES:
            partner = places ^ place
            use = (places > 0) & (place < partner)  # each pair of places once, and no pair with place 0
            add((value ^ _bit(np.full_like(places, place)) ^ _bit(partner))[use], everyone[use], False)
    return np.concatenate(out), np.concatenate(rows), np.concatenate(homes)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            fps = whole.column("fp").slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            anchor, row, home = anchors(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(home)],
                ["anchor", "fp", "home"],
            )


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each pair one label, the smallest of those reachable."""
    while len(a):
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        open_ = low < high
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(labels, high[open_], low[open_])
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between rows of one anchor and salt, which come in order with those that live there first.

    Only the rows that live at the current anchor are held. Links are reduced to a forest: each row is linked to one
    row that lives there, and those among each other to one of theirs.
    """
    kept_key, kept = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
        salt = batch.column("salt").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
        if not len(fps):
            continue
        carried = len(kept) if kept_key == (anchor[0], salt[0]) else 0
        if carried:
            anchor = np.concatenate([np.full(carried, anchor[0]), anchor])
            salt = np.concatenate([np.full(carried, salt[0]), salt])
            fps = np.concatenate([kept, fps])
            home = np.concatenate([np.full(carried, True), home])
        new = np.ones(len(fps), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        at_home = np.add.reduceat(home.astype(np.int64), first)
        want = at_home[run]
        want[:carried] = 0
        labels = np.arange(len(fps))
        rows = np.flatnonzero(want)
        linked_rows, linked_homes = [], []
        sums = np.cumsum(want[rows])
        done = 0
        while done < len(rows):
            base = sums[done - 1] if done else 0
            stop = max(int(np.searchsorted(sums, base + BLOCK_PAIRS, side="right")), done + 1)
            part = rows[done:stop]
            left = np.repeat(part, want[part])
            begin = np.repeat(np.cumsum(want[part]) - want[part], want[part])
            right = first[run[left]] + np.arange(len(left)) - begin
            close = (np.bitwise_count(fps[left] ^ fps[right]) <= MOST_BITS) & (left != right)
            left, right = left[close], right[close]
            if len(left):
                lead = np.ones(len(left), dtype=bool)
                lead[1:] = left[1:] != left[:-1]
                leader = right[lead][np.cumsum(lead) - 1]
                _merge(labels, leader, right)
                linked_rows.append(left[lead])
                linked_homes.append(right[lead])
            done = stop
        moved = np.flatnonzero(labels != np.arange(len(fps)))
        a = np.concatenate([*linked_rows, moved])
        b = np.concatenate([*linked_homes, labels[moved]])
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[a.astype(int)].view(np.int64)), pa.array(fps[b.astype(int)].view(np.int64))], ["a", "b"]
            )
        kept_key = (anchor[-1], salt[-1])
        kept = fps[first[-1] :][home[first[-1] :]]


def links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of the fingerprints of ``fps`` (distinct, column ``fp``) within three
    bits; the ends of one link may be joined by way of others.

    An anchor where more than ``BLOCK_HOMES`` fingerprints live is split into salts: each of those fingerprints goes to
    one salt, and the anchor's other rows to all of them.
    """
    posts = fps.select("fp").mapInArrow(tidy(_post), "anchor long, fp long, home boolean")
    crowded = posts.filter("home").groupBy("anchor").count().filter(F.col("count") > BLOCK_HOMES)
    salts = crowded.select("anchor", F.ceil(F.col("count") / BLOCK_HOMES).cast("int").alias("salts"))
    spread = posts.join(salts, "anchor", "left").withColumn(
        "salt",
        F.explode(
            F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
        ),
    )
    own = F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")
    spread = spread.withColumn("home", F.col("home") & (F.col("salt") == own))
    dealt = spread.repartition("anchor", "salt").select("anchor", "salt", "fp", "home")
    ordered = dealt.sortWithinPartitions("anchor", "salt", F.desc("home"))
    return ordered.mapInArrow(tidy(_compare), "a long, b long")


def near_duplicates(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = SHINGLE
) -> DataFrame:
    """``id_column``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id that is reachable over links, null ids aside; it is null where all are null. A
    null or blank text has fingerprint zero and is linked like any other. Repeated rows are kept. Rows of one
    fingerprint are compared as one. Other columns are ignored. An empty table gives an empty one.
    """
    marked = stage(fingerprints(docs, text, id_column, shingle), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min(id_column).alias("smallest")), "classes")
    roots = connected_components(links(classes)).withColumnRenamed("node", "fp")
    grouped = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
