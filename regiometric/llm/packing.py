"""Packing token sequences by powers of two, so that no sequence holds more than one document and none is padded.

A document of n tokens is cut into pieces whose lengths are the powers of two that n is made of, largest first; lengths
above the largest sequence are cut into that many whole sequences. Pieces of one length form a bucket, and each piece is
a sequence of its own. A training job draws each batch from one bucket.
"""

from __future__ import annotations

import gc
import string
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric.llm.words import Words, WordTable, find_words, slices, tidy

MAX_LENGTH = 2048
END_ID = 1
CACHED_WORDS = 300_000
MOST_SIGNS = 8
SIGMA = "\u03a3"  # its lower case depends on its place in a word
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


BYTE_LETTERS = _byte_letters()
WORD_ENDS, IS_SIGN, IS_LETTER = (np.zeros(256, dtype=bool) for _ in range(3))
WORD_ENDS[[10, 32]] = True
IS_SIGN[[*(string.punctuation + string.digits).encode()]] = True
IS_LETTER[[*string.ascii_letters.encode()]] = True
LATIN, TIMES, DIVIDED = 0xC3, 0x97, 0xB7  # after the first, bytes above 127 are letters but for the other two
BYTES_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the first n of eight bytes
_HIGH, _FROM_A, _BEYOND_Z = (np.uint64(0x0101010101010101 * n) for n in (0x80, 0x80 - ord("A"), 0x7F - ord("Z")))
_NONE, _NO_IDS = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)


def binary_pieces(total: int, most: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of the pieces of a document of ``total`` tokens, in order; ``most`` is a power of two."""
    whole, rest = divmod(total, most)
    bits = [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]
    return np.array([most] * whole + bits, dtype=np.int64)


def _gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts ``flat[begin:begin + length]`` one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(begins - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _lower(codes: np.ndarray) -> np.ndarray:
    """Eight ASCII bytes in each number, A to Z in lower case."""
    capital = ((codes + _FROM_A) ^ (codes + _BEYOND_Z)) & _HIGH
    return codes + (capital >> np.uint64(2))


class WordEncoder:
    """Token ids of texts, with the ids of the words and word parts that were seen lately kept.

    Spaces and line feeds always end a token, so a text is encoded word by word with the same result. So does a letter
    before signs, which therefore are looked up as a word of their own, and ASCII words are looked up in lower case. A
    new word goes through the tokenizer's own normaliser, pre-tokenizer and model. Words are found by their bytes, many
    at a time; the ids of word number n of ``known`` stand in ``flat`` from ``begins[n]`` on. A full store becomes the
    older one, from which words that turn up again are taken over, and what was not used for a whole turn is forgotten;
    this changes nothing in the results.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = [str(token.content) for token in added]
        if any("|" not in mark for mark in self.marks):
            raise ValueError("added tokens are expected to hold a vertical bar")
        self.known, self.parts = WordTable(), {}
        self.flat, self.begins, self.sizes = _NO_IDS, _NONE, _NONE
        self.serial = count()
        self._begin()

    def _begin(self) -> None:
        self.older, self.older_parts = self.known, self.parts
        self.older_flat, self.older_begins, self.older_sizes = self.flat, self.begins, self.sizes
        self.known, self.parts = WordTable(), {}
        self.flat, self.begins, self.sizes = _NO_IDS, _NONE, _NONE
        self.long: dict[bytes, int] = defaultdict(self.serial.__next__)

    def _part(self, piece: str) -> tuple[int, ...]:
        found = self.parts.get(piece)
        if found is None:
            found = self.older_parts.get(piece)
            if found is None:
                found = tuple([token.id for token in self.model.tokenize(piece)])
            self.parts[piece] = found
        return found

    def _other(self, word: str) -> tuple[int, ...]:
        """Ids of any word, by what the normaliser and the pre-tokenizer make of it."""
        normal = self.tokenizer.normalizer.normalize_str(word)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return tuple(chain.from_iterable([self._part(piece) for piece, _ in pieces]))

    def _word(self, word: str) -> tuple[int, ...]:
        if "|" in word and any(mark in word for mark in self.marks):
            return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        plain = word.lower()
        if not word.isalpha() or not plain.isalpha() or SIGMA in word or not unicodedata.is_normalized("NFC", word):
            return self._other(word)
        # letters only: one piece, as bytes in the tokenizer's alphabet
        return self._part("".join(map(BYTE_LETTERS.__getitem__, plain.encode())))

    def _words(self, words: list[str]) -> list[tuple[int, ...] | list[int]]:
        """Ids of words that no store has; what ``_word`` gives, with the usual case, letters of ASCII, in line."""
        tokenize = self.model.tokenize
        return [
            [token.id for token in tokenize(word.lower())] if word.isascii() and word.isalpha() else self._word(word)
            for word in words
        ]

    def _split(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of all words, signs after a last letter apart; which of them hold a vertical bar; and the n + 1
        places at which the texts begin."""
        data, starts, ends = words.data, words.starts, words.ends
        barred = np.zeros(len(starts), dtype=bool)
        barred[np.searchsorted(starts, np.flatnonzero(data == ord("|")), side="right") - 1] = True
        stems, going = ends.copy(), np.flatnonzero(IS_SIGN[data[ends - 1]] & ~barred)
        for _ in range(MOST_SIGNS):  # words that end in more signs stay whole
            stems[going] -= 1
            going = going[stems[going] > starts[going]]
            going = going[IS_SIGN[data[stems[going] - 1]]]
        cut = np.flatnonzero((stems < ends) & (stems > starts))
        last, before = data[stems[cut] - 1], data[np.maximum(stems[cut] - 2, starts[cut])]
        cut = cut[IS_LETTER[last] | ((before == LATIN) & (last != TIMES) & (last != DIVIDED) & (last >= 128))]
        extra = np.zeros(len(starts), dtype=np.int64)
        extra[cut] = 1
        place = np.arange(len(starts)) + np.cumsum(extra) - extra
        begins, stops = (np.empty(len(starts) + len(cut), dtype=np.int64) for _ in range(2))
        begins[place], stops[place] = starts, ends
        begins[place[cut] + 1], stops[place[cut] + 1], stops[place[cut]] = stems[cut], ends[cut], stems[cut]
        held = np.zeros(len(begins), dtype=bool)
        held[place[barred]] = True
        return begins, stops, held, np.append(place, len(begins))[words.first]

    def _keys(
        self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, barred: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two numbers of each word, and which words are long ones.

        Words of at most 16 bytes, none of them 0, are their bytes, those of ASCII in lower case unless they hold a bar. Any
        others are a number of their own beside eight bytes that UTF-8 does not have.
        """
        padded = np.zeros(len(data) + 16, dtype=np.uint8)
        padded[: len(data)] = data
        eights = np.ndarray(len(data) + 9, dtype="<u8", buffer=padded, strides=(1,))
        sizes = ends - begins
        long = sizes > 16
        long[np.searchsorted(begins, np.flatnonzero(data == 0), side="right") - 1] = True
        left, right = eights[begins], np.zeros(len(begins), dtype=np.uint64)
        left &= BYTES_KEPT[np.minimum(sizes, 8)]
        more = np.flatnonzero(sizes > 8)
        right[more] = eights[begins[more] + 8] & BYTES_KEPT[np.minimum(sizes[more] - 8, 8)]
        ascii_ = ((left | right) & _HIGH) == 0
        ascii_ &= ~(barred | long)
        left, right = np.where(ascii_, _lower(left), left), np.where(ascii_, _lower(right), right)
        long = np.flatnonzero(long)
        whole = [data[b:e].tobytes() for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True)]
        left[long] = np.fromiter(map(self.long.__getitem__, whole), dtype=np.uint64, count=len(whole))
        right[long] = BYTES_KEPT[8]
        return left, right, long

    def _learn(self, left: np.ndarray, right: np.ndarray, long: dict[int, bytes]) -> None:
        """Adds words, in the order of their numbers; the older store's ids are copied, others are made."""
        before = self.older.find(left, right)
        fresh = np.flatnonzero(before < 0)
        held = before >= 0
        words = np.stack([left[fresh], right[fresh]], axis=1).astype("<u8").view("S16").ravel().tolist()
        for at in np.flatnonzero(right[fresh] == BYTES_KEPT[8]).tolist():
            words[at] = long[int(left[fresh[at]])]
        made = self._words([word.decode() for word in words])
        sizes, begins = np.empty_like(before), np.empty_like(before)
        sizes[held], begins[held] = self.older_sizes[before[held]], self.older_begins[before[held]]
        made_sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        sizes[fresh], begins[fresh] = made_sizes, len(self.older_flat) + np.cumsum(made_sizes) - made_sizes
        made_ids = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(made_sizes.sum()))
        ids = _gather(np.concatenate([self.older_flat, made_ids]), begins, sizes)
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, as unsigned 32-bit numbers, and how many each text has."""
        if len(self.known) > CACHED_WORDS:
            self._begin()
        words = find_words(column, spaces=WORD_ENDS)
        if not len(words.starts):
            return _NO_IDS, np.zeros(len(column), dtype=np.int64)
        begins, ends, barred, first = self._split(words)
        left, right, long = self._keys(words.data, begins, ends, barred)
        word, fresh = self.known.add(left, right)
        if len(fresh):
            pairs = zip(left[long].tolist(), begins[long].tolist(), ends[long].tolist(), strict=True)
            self._learn(left[fresh], right[fresh], {key: words.data[b:e].tobytes() for key, b, e in pairs})
        lengths = self.sizes[word]
        totals = np.append(0, np.cumsum(lengths))[first]
        return _gather(self.flat, self.begins[word], lengths), np.diff(totals)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts as unsigned 32-bit numbers."""
        ids, sizes = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(sizes)[:-1])


def pack_power_of_two(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    id_column: str = "doc_id",
    most: int = MAX_LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the document's id, the piece's place in it, its checksum, its sequence and its ids.

    A null or empty text has the end id only, so it gives one piece of length 1. Repeated rows are packed once each, a
    null id stays null, and other columns are ignored. ``bucket`` is the logarithm of the length. ``sequence_id`` is
    unique and follows the order of the rows; ``offset`` is 0 because no sequence is shared.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        gc.disable()  # the stores hold millions of objects and no cycles; ``tidy`` collects at the end of the task
        try:
            yield from packed_pieces(encoder, batches)
        finally:
            gc.enable()

    def packed_pieces(encoder: WordEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows, starts, lengths, checks, totals, parts = [], [], [], [], [], []
                found, counts = encoder.encode_column(batch.column("text"))
                stops = np.cumsum(counts)
                found = np.insert(found, stops, np.uint32(end_id)).astype("<u4", copy=False)
                for row, stop in enumerate((stops + np.arange(1, len(stops) + 1)).tolist()):
                    ids = found[stop - 1 - int(counts[row]) : stop]
                    sizes = binary_pieces(len(ids), most)
                    begin = 0
                    for size in sizes.tolist():
                        part = ids[begin : begin + size]
                        rows.append(row)
                        starts.append(begin)
                        checks.append(zlib.crc32(part))
                        parts.append(part)
                        begin += size
                    lengths.extend(sizes.tolist())
                    totals.extend([len(ids)] * len(sizes))
                columns = [
                    batch.column("id").take(pa.array(rows, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(checks, pa.int64()),
                    pa.array(totals, pa.int64()),
                ]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    flat = np.concatenate(parts).astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + (PIECES if with_ids else PIECES.removesuffix(", ids array<int>"))
    packed = source.mapInArrow(tidy(pieces), schema).withColumnRenamed("id", id_column)
    return packed.withColumns({
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
        "bucket": F.log2(F.col("length")).cast("int"),
    })
