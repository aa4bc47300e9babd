"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into overlapping probes. If a text holds a probe of m characters with at most e edits, the two
share at least m - q + 1 - q * e of the probe's q-grams, on diagonals (place in the text less place in the probe) that
lie at most e apart. q is ``Q``, or less for short probes, so that this bound is always 1 or more. Shared q-grams are
counted in overlapping bands of diagonals, each 2 (e + 1) wide; bands that reach the bound are kept and verified by
alignment within the band. No probe within the edit budget is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regiometric.llm.words import Runs, mix, slices, tidy

Q = 10
EDITS = 0.06
PROBE = 160
STRIDE = 80
INDEX_CHARS = 4 << 20
FILTER_BITS = 22
LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(1 << 16))], dtype=np.uint32)
_WHITE = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)


@dataclass
class Plain:
    """``chars`` of normal form: lower case where that is one character, white space runs as one space. ``place``: where each stood in the
    joined texts; text d has the characters ``first[d]:first[d + 1]`` and stood at ``offset[d]``."""

    chars: np.ndarray
    place: np.ndarray
    first: np.ndarray
    offset: np.ndarray


def normalise(texts: list[str | None]) -> Plain:
    given = [text or "" for text in texts]
    sizes = np.array([len(text) for text in given], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    chars = np.frombuffer("".join(given).encode("utf-32-le"), dtype=np.uint32).copy()
    low = chars < len(LOWER)
    chars[low] = LOWER[chars[low]]
    white = (chars <= 32) & np.isin(chars, _WHITE)
    chars[white] = 32
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = ~(white[1:] & white[:-1])
    borders = offset[1:-1]
    keep[borders[borders < len(chars)]] = True
    place = np.flatnonzero(keep)
    return Plain(chars[place], place, np.searchsorted(place, offset), offset)


def gram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    starts = np.arange(max(len(chars) - q + 1, 0))
    return Runs.of(mix(chars.astype(np.uint64) + np.uint64(1))).hash(starts, q)


class Grams:
    """The q-grams, of one q, of some probes: where each stands."""

    def __init__(self, q: int, chars: np.ndarray, first: np.ndarray, size: np.ndarray, mine: np.ndarray):
        self.q = q
        probe = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(chars)) - np.repeat(first[:-1], size)
        grams = gram_hashes(chars, q)
        probe, place = probe[: len(grams)], place[: len(grams)]
        inside = np.flatnonzero(mine[probe] & (place + q <= size[probe]))
        order = inside[np.argsort(grams[inside], kind="stable")]
        self.probe, self.place = probe[order], place[order]
        self.grams, runs = np.unique(grams[order], return_index=True)
        self.runs = np.append(runs, len(order))
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.grams >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, plain: Plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, probe and diagonal (from the start of the joined texts) of every shared q-gram."""
        grams = gram_hashes(plain.chars, self.q)
        at = np.flatnonzero(self.filter[grams >> np.uint64(64 - FILTER_BITS)])
        found = np.searchsorted(self.grams, grams[at])
        same = found < len(self.grams)
        same[same] = self.grams[found[same]] == grams[at[same]]
        at, found = at[same], found[same]
        text = np.searchsorted(plain.first, at, side="right") - 1
        whole = at + self.q <= plain.first[text + 1]
        at, found, text = at[whole], found[whole], text[whole]
        times = self.runs[found + 1] - self.runs[found]
        index = np.repeat(self.runs[found] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        return np.repeat(text, times), self.probe[index], np.repeat(at, times) - self.place[index]


class Probes:
    """Probes with the edits each may have, their q-grams, and how many of them a region must share with each."""

    def __init__(self, items: list, texts: list[str], numbers: list[int] | None = None, q: int = Q, edits: float = EDITS):
        plain = normalise(texts)
        self.items, self.numbers = items, np.array(numbers or [0] * len(items), dtype=np.int64)
        self.chars, self.first = plain.chars, plain.first
        self.size = np.diff(plain.first)
        self.edits = np.floor(self.size * edits).astype(np.int64)
        of_probe = np.minimum(q, self.size // (self.edits + 1))
        self.bound = self.size - of_probe + 1 - of_probe * self.edits
        used = np.unique(of_probe[self.size > 0]).tolist()
        self.grams = [Grams(n, self.chars, self.first, self.size, of_probe == n) for n in used]
        self.alone = self.size < q  # found as whole words only

    def hits(self, plain: Plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, probe and diagonal (from the start of the joined texts) of every shared q-gram."""
        found = [grams.hits(plain) for grams in self.grams]
        none = (np.zeros(0, dtype=np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else none

    def regions(self, plain: Plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, probe and lowest diagonal of the bands that reach the bound."""
        text, probe, diagonal = self.hits(plain)
        if not len(text):
            return text, probe, diagonal
        step = self.edits[probe] + 1
        shift = diagonal + int(self.size.max())  # diagonals may be negative
        upper = shift // step
        bands = np.concatenate([upper, upper - 1])
        key = np.stack([np.tile(text, 2), np.tile(probe, 2), bands])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        new = np.ones(key.shape[1], dtype=bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        enough = np.diff(first, append=key.shape[1]) >= self.bound[key[1, first]]
        text, probe, bands = key[:, first[enough]]
        return text, probe, bands * (self.edits[probe] + 1) - int(self.size.max())


def align(
    chars: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray, width: int, patterns: np.ndarray,
    sizes: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each pattern and a part of ``chars[low:high]`` on ``width`` diagonals, and the part's end.

    ``patterns`` is a row per pattern, padded to one length. Row i, diagonal d stands for place ``diagonal + i + d``.
    """
    count = len(low)
    lanes = np.arange(width)
    costs = np.zeros((count, width), dtype=np.int32)
    best, ends = np.full(count, 1 << 30, dtype=np.int32), np.zeros(count, dtype=np.int64)
    far = np.int32(1 << 20)
    base = diagonal[:, None] + lanes[None]
    costs[(base < low[:, None]) | (base > high[:, None])] = far
    for i in range(patterns.shape[1]):
        at = base + i
        inside = (at >= low[:, None]) & (at < high[:, None])
        here = chars[np.clip(at, 0, max(len(chars) - 1, 0))]
        across = np.where(inside, costs + (here != patterns[:, i : i + 1]), far)
        down = np.full_like(costs, far)
        down[:, :-1] = costs[:, 1:] + 1
        either = np.minimum(across, down).astype(np.int32)
        costs = np.minimum.accumulate(either - lanes, axis=1) + lanes
        costs = np.where(at + 1 > high[:, None], far, costs).astype(np.int32)
        done = np.flatnonzero(sizes == i + 1)
        if len(done):
            pick = costs[done].argmin(axis=1)
            best[done] = costs[done, pick]
            ends[done] = at[done, pick] + 1
    return best, ends


def _stands_alone(chars: np.ndarray, low: int, high: int, start: int, stop: int) -> bool:
    """Whether ``chars[start:stop]``, within a text that is ``chars[low:high]``, continues no letter or digit."""
    return not (start > low and chr(chars[start - 1]).isalnum()) and not (stop < high and chr(chars[stop]).isalnum())


def find_leaks(texts: list[str | None], probes: Probes) -> dict[str, np.ndarray]:
    """Text number, probe number, start and stop in the text, and edits of every probe found in a text."""
    plain = normalise(texts)
    text, probe, diagonal = probes.regions(plain)
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("text", "probe", "start", "stop", "edits")}
    for at in range(0, len(text), 2048):
        t, p, d = text[at : at + 2048], probe[at : at + 2048], diagonal[at : at + 2048]
        size, most = probes.size[p], probes.edits[p]
        patterns = np.zeros((len(t), int(size.max())), dtype=np.uint32)
        fill = np.arange(patterns.shape[1])[None] < size[:, None]
        patterns[fill] = probes.chars[np.repeat(probes.first[p] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        low, high = plain.first[t], plain.first[t + 1]
        width = 2 * (int(most.max()) + 1)
        edits, ends = align(plain.chars, low, high, d, width, patterns, size)
        fine = np.flatnonzero(edits <= most)
        if not len(fine):
            continue
        t, p, size, most, ends, edits, low = (x[fine] for x in (t, p, size, most, ends, edits, low))
        turned = np.zeros((len(t), int(size.max())), dtype=np.uint32)
        for row, n in enumerate(size.tolist()):
            turned[row, :n] = patterns[fine[row], :n][::-1]
        total = len(plain.chars)
        _, begins = align(
            plain.chars[::-1], total - ends, total - low, total - ends - most, 2 * (int(most.max()) + 1), turned, size
        )
        if probes.alone[p].any():
            given = zip(probes.alone[p].tolist(), low, plain.first[t + 1], total - begins, ends, strict=True)
            kept = np.array([not alone or _stands_alone(plain.chars, *rest) for alone, *rest in given])
            t, p, begins, ends, edits = (x[kept] for x in (t, p, begins, ends, edits))
        start = plain.place[total - begins] - plain.offset[t]
        stop = plain.place[ends - 1] + 1 - plain.offset[t]
        for name, value in zip(out, (t, p, start, stop, edits), strict=True):
            out[name].append(value)
    return {name: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64) for name, parts in out.items()}


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, numbers, texts = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            whole = "".join(map(chr, normalise([text]).chars.tolist())).strip(" ")
            starts = [0] if len(whole) <= PROBE else [*range(0, len(whole) - PROBE, STRIDE), len(whole) - PROBE]
            for number, start in enumerate(starts):
                rows.append(row)
                numbers.append(number)
                texts.append(whole[start : start + PROBE])
        yield pa.RecordBatch.from_arrays(
            [batch.column("item").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64()), pa.array(texts)],
            ["item", "number", "probe"],
        )


def probe_table(benchmark: DataFrame, item_column: str = "item_id") -> DataFrame:
    """``item``, ``number``, ``probe``: the distinct probes of all items that hold more than white space."""
    items = benchmark.select(F.col(item_column).alias("item"), F.col("text").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    probes = items.mapInArrow(tidy(_probe_rows), f"item {kind}, number long, probe string")
    return probes.filter("probe <> ''").distinct()


def index_parts(probes: DataFrame) -> Iterator[tuple[list, list[str], list[int]]]:
    """Items, probes and their numbers in parts of about ``INDEX_CHARS`` characters, which is what goes to all tasks at a time."""
    chars = probes.agg(F.sum(F.length("probe")).alias("n")).collect()[0].n or 0
    parts = max(1, -(-chars // INDEX_CHARS))
    for part in range(parts):
        mine = probes.filter(F.pmod(F.xxhash64("probe"), F.lit(parts)) == part).orderBy("item", "number", "probe")
        rows = mine.collect()
        if rows:
            yield [row.item for row in rows], [row.probe for row in rows], [row.number for row in rows]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """One row per document row, benchmark item and region that holds it: ids, ``start`` and ``stop`` in the text,
    ``probes`` (how many of the item's probes were found there) and ``edits`` of the best of them.

    A probe counts as found within ``EDITS`` of its length, case and white space aside; longer items are found if one
    of their probes is. Found places of one item that overlap are one region. Items of fewer than ``Q`` characters are
    found exactly and as whole words: no letter or digit may go before or after. Null or blank items match nothing;
    repeated items are found as one if their ids agree. A null text holds nothing. Repeated documents give rows each.
    Other columns are ignored. The index of the probes goes to all tasks; a benchmark of more than ``INDEX_CHARS``
    characters is searched in parts of that size.
    """
    probes = probe_table(benchmark, item_column)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).alias("text")
    )
    item_type = probes.select("item").limit(0).toArrow().schema.field("item").type
    kinds = [frame.schema[name].dataType.simpleString() for frame, name in ((source, "id"), (probes, "item"))]
    schema = "row long, id {}, item {}, probe long, start long, stop long, edits long".format(*kinds)
    found = docs.sparkSession.createDataFrame([], schema)
    for part in index_parts(probes):

        def search(batches: Iterator[pa.RecordBatch], given: tuple = part) -> Iterator[pa.RecordBatch]:
            index = Probes(*given)
            for whole in batches:
                for batch in slices(whole, "text", 2 << 20):
                    hit = find_leaks(batch.column("text").to_pylist(), index)
                    at = pa.array(hit["text"])
                    item = pa.array([index.items[k] for k in hit["probe"].tolist()], item_type)
                    number = index.numbers[hit["probe"]]
                    values = [pa.array(x.astype(np.int64)) for x in (number, hit["start"], hit["stop"], hit["edits"])]
                    columns = [batch.column("row").take(at), batch.column("id").take(at), item, *values]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "id", "item", "probe", "start", "stop", "edits"])

        found = found.unionByName(source.mapInArrow(tidy(search), schema))
    places = W.partitionBy("row", "item").orderBy("start", "stop", "probe")
    reached = F.max("stop").over(places.rowsBetween(W.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("start") >= reached)).cast("int")
    regions = found.withColumn("opens", opens).withColumn("region", F.sum("opens").over(places))
    merged = regions.groupBy("row", "item", "region").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.min("edits").alias("edits"), F.count_distinct("probe").alias("probes"),
    )
    return merged.select(
        F.col("id").alias(id_column), F.col("item").alias(item_column), "start", "stop", "edits", "probes"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that hold no benchmark item in the sense of ``leaks``; nothing is shuffled."""
    for part in index_parts(probe_table(benchmark)):

        def keep(batches: Iterator[pa.RecordBatch], given: tuple = part) -> Iterator[pa.RecordBatch]:
            index = Probes(*given)
            for whole in batches:
                for batch in slices(whole, text, 2 << 20):
                    clean = np.ones(batch.num_rows, dtype=bool)
                    clean[find_leaks(batch.column(text).to_pylist(), index)["text"]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs
