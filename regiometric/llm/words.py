"""Words of whole Arrow batches as arrays: positions, 64-bit hashes and hashes of word runs.

A word is a run of bytes other than space and the five control characters from tab to carriage return. All functions
work on the UTF-8 bytes of a string column without making Python strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK_BYTES = 1 << 20
ADDED = 1 << 16
_PRIME = 0x9E3779B97F4A7C15
_PRIME_2 = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # as in malloc.h


def mix(values: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one, so that every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME)) | np.uint64(1)
    codes[SPACES] = 0
    return codes


BYTE_CODES = _byte_codes()


def powers(base: int, count: int) -> np.ndarray:
    """``base`` to the powers 0 to ``count`` - 1 modulo 2**64."""
    table = np.full(max(count, 1), base, dtype=np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


@dataclass
class Words:
    """``data``: bytes of all texts; word i is ``data[starts[i]:ends[i]]``; text d has the words ``first[d]:first[d + 1]``
    and the bytes ``offsets[d]:offsets[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its texts; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], steady: bool = False):
    """``run`` for ``mapInArrow``, with the memory it has freed given back to the system at its end.

    Python workers outlive their tasks, so what the allocators keep for later would add up over stages and workers.
    With ``steady`` up to 64 MB of freed memory are kept meanwhile, for tasks that take and free arrays of some megabytes
    again and again: given back each time, they would be cleared by the system page by page for each new array. The worker
    keeps the setting.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        library = ctypes.CDLL(None)
        if steady and hasattr(library, "mallopt"):
            library.mallopt(_MMAP_THRESHOLD, 32 << 20)
            library.mallopt(_TRIM_THRESHOLD, 64 << 20)  # the highest that the C library would choose by itself
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(library, "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most_bytes`` of text, or of one row if that is longer."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def find_words(
    column: pa.Array, lower: bool = False, through: np.ndarray | None = None, spaces: np.ndarray = SPACES
) -> Words:
    """The words of every text, in order; ``lower`` lower-cases the letters A to Z.

    ``through`` gives another byte for each byte before words are looked for, such as a space for every separator;
    ``spaces`` marks other bytes than usual as separators.
    """
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    if through is not None:
        data = through[data]
    inside = ~spaces[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] = inside[borders]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of every word, made in blocks of bounded size."""
    starts, ends = words.starts, words.ends
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")), at + 1)
        base = starts[at]
        block = words.data[base : ends[stop - 1]]
        relative = starts[at:stop] - base
        spans = np.diff(relative, append=len(block))
        place = np.arange(len(block)) - np.repeat(relative, spans)
        table = powers(_PRIME, int(spans.max()) + 1)
        sums = np.add.reduceat(BYTE_CODES[block] * table[place], relative)
        out[at:stop] = mix(sums + (ends[at:stop] - starts[at:stop]).astype(np.uint64) * np.uint64(_PRIME_2))
        at = stop
    return out


class WordTable:
    """Numbers of words from 0 on, in the order in which they were added; open addressing on whole arrays.

    A word is two unsigned 64-bit numbers of the caller's choice, by which words are told apart exactly.
    """

    def __init__(self):
        self.slots, self.used = np.full(1 << 12, -1, dtype=np.int32), 0
        self.left, self.right = (np.zeros(1 << 11, dtype=np.uint64) for _ in range(2))

    def __len__(self) -> int:
        return self.used

    def _home(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * np.uint64(_PRIME)
        code ^= code >> np.uint64(29)
        code += right
        code *= np.uint64(_PRIME_2)
        code ^= code >> np.uint64(32)
        code *= np.uint64(_PRIME)
        code >>= np.uint64(65 - len(self.slots).bit_length())
        return code.astype(np.int64)

    def _room(self, more: int) -> None:
        """At most half of the slots are taken once ``more`` words have been added."""
        need = self.used + more
        if need > len(self.left):
            more = np.zeros(max(need, 2 * len(self.left)) - len(self.left), dtype=np.uint64)
            self.left, self.right = np.concatenate([self.left, more]), np.concatenate([self.right, more])
        if 2 * need > len(self.slots):
            self.slots = np.full(1 << (2 * need).bit_length(), -1, dtype=np.int32)
            numbers = np.arange(self.used, dtype=np.int32)
            at = self._home(self.left[: self.used], self.right[: self.used])
            while len(numbers):
                free = self.slots[at] < 0
                self.slots[at[free]] = numbers[free]
                going = self.slots[at] != numbers
                numbers, at = numbers[going], (at[going] + 1) & (len(self.slots) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those that the table does not hold."""
        out, going, at = np.full(len(left), -1, dtype=np.int64), np.arange(len(left)), self._home(left, right)
        while len(going):
            entry = self.slots[at]
            same = (entry >= 0) & (self.left[entry] == left[going]) & (self.right[entry] == right[going])
            out[going[same]] = entry[same]
            on = (entry >= 0) & ~same
            going, at = going[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def add(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and where those stand that were not held before, in the order of their numbers."""
        out, fresh = np.empty(len(left), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
        for begin in range(0, len(left), ADDED):
            part = slice(begin, begin + ADDED)
            out[part], found = self._add(left[part], right[part])
            fresh.append(found + begin)
        return out, np.concatenate(fresh)

    def _add(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._room(len(left))
        out, fresh = np.empty(len(left), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
        going, at = np.arange(len(left)), self._home(left, right)
        while len(going):
            entry = self.slots[at]
            free = np.flatnonzero(entry < 0)
            if len(free):  # of the words that want a free slot, the one that is written last gets it
                self.slots[at[free]] = going[free]
                free = free[self.slots[at[free]] == going[free]]
                won, numbers = going[free], self.used + np.arange(len(free))
                self.slots[at[free]] = numbers
                self.left[numbers], self.right[numbers] = left[won], right[won]
                self.used += len(won)
                fresh.append(won)
                entry = self.slots[at]
            same = self.left[entry] == left[going]
            same &= self.right[entry] == right[going]
            out[going[same]] = entry[same]
            on = ~same
            going, at = going[on], (at[on] + 1) & (len(self.slots) - 1)
        return out, np.concatenate(fresh)


@dataclass
class Runs:
    """Hashes of any run of consecutive words in constant time."""

    sums: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, base: int = _PRIME) -> Runs:
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(base, len(hashes))[: len(hashes)], out=sums[1:], dtype=np.uint64)
        return cls(sums, powers(pow(base, -1, 1 << 64), len(hashes) + 1))

    def hash(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        total = (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]
        size = np.asarray(lengths, dtype=np.uint64) * np.uint64(_PRIME_2)
        return mix(total + size)


SECOND_BASE = _PRIME_2 | 1
