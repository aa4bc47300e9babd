import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regiometric.llm import chat, decontaminate, neighbours, packing, warc
from regiometric.session import scratch_dir

from .conftest import prose

TOKENS = public_tokenizers.path("word_bpe_49k.json")
HARD = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "<", "<<", "[OUT", "<\\/s>", "[ROLE]x[/ROLE]", "", "\n<<SYS>>\n", "日本 é"]


# -- decontamination ---------------------------------------------------------------------------------------------


def fewest_edits(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    costs = list(range(len(pattern) + 1))
    best = costs[-1]
    for c in text:
        before, costs[0] = costs[0], 0
        for i, p in enumerate(pattern, 1):
            before, costs[i] = costs[i], min(costs[i] + 1, costs[i - 1] + 1, before + (p != c))
        best = min(best, costs[-1])
    return best


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000), st.integers(0, 12), st.integers(20, 150))
def test_leaks_against_whole_alignment(seed, changes, size):
    rng = np.random.default_rng(seed)
    probe = prose(seed, 80).lower()[:size].strip()
    part = list(probe)
    for _ in range(changes):
        at = int(rng.integers(len(part)))
        part[at : at + 1] = [[], ["q"], [part[at], "z"]][int(rng.integers(3))]
    texts = [prose(seed + 1, 20) + " " + "".join(part) + " " + prose(seed + 2, 20), "".join(part), None, prose(seed + 3, 30)]
    index = decontaminate.Probes([7], [probe])
    found = decontaminate.find_leaks(texts, index)
    got = defaultdict(lambda: 1 << 30)
    for text, edits in zip(found["text"].tolist(), found["edits"].tolist(), strict=True):
        got[text] = min(got[text], edits)
    for number, text in enumerate(texts):
        wanted = fewest_edits(probe, re.sub(r"[ \t\n\v\f\r]+", " ", text or "").lower())
        if wanted <= int(len(probe) * decontaminate.EDITS):
            assert got[number] == wanted
        else:
            assert number not in got


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10_000), st.integers(0, 2), st.integers(1, 24))
def test_short_items_against_whole_alignment(seed, changes, size):
    """Probes of any size: exact whole words below ten characters, within the edit budget from there."""
    rng = np.random.default_rng(seed)
    probe = prose(seed, 20).lower()[:size].strip()
    part = list(probe)
    for _ in range(min(changes, len(part) - 1)):
        at = int(rng.integers(len(part)))
        part[at : at + 1] = [[], ["q"], [part[at], "z"]][int(rng.integers(3))]
    around = prose(seed + 1, 6)
    texts = [f"{around} {''.join(part)} {around}", f"x{''.join(part)}", f"({probe}).", probe, None, around]
    found = decontaminate.find_leaks(texts, decontaminate.Probes([7], [probe]))
    got = defaultdict(lambda: 1 << 30)
    for text, edits in zip(found["text"].tolist(), found["edits"].tolist(), strict=True):
        got[text] = min(got[text], edits)
    for number, text in enumerate(texts):
        plain = re.sub(r"[ \t\n\v\f\r]+", " ", text or "").lower()
        if len(probe) < decontaminate.Q:
            edge = r"[^\W_]"  # a letter or digit
            assert (number in got) == bool(re.search(f"(?<!{edge}){re.escape(probe)}(?!{edge})", plain))
            continue
        wanted = fewest_edits(probe, plain)
        assert got[number] == (wanted if wanted <= int(len(probe) * decontaminate.EDITS) else 1 << 30)


def test_every_region_is_returned(spark):
    item, other = prose(5, 70), prose(6, 40)
    near = item[:100] + "#" + item[101:]
    text = f"{other} {item} {other} {near}\n{item} {other}"
    docs = spark.createDataFrame([(1, text), (1, text), (2, item), (3, other)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, "one"), (7, " \n")], "item_id long, text string")
    rows = decontaminate.leaks(docs, items).collect()
    assert Counter(r.doc_id for r in rows) == Counter({1: 6, 2: 1}) and {r.item_id for r in rows} == {9}
    places = sorted({(r.start, r.stop) for r in rows if r.doc_id == 1})
    assert [text[a:b] for a, b in places] == [item, near, item]
    assert len({r.probes for r in rows}) == 1 and rows[0].probes > 2
    one = spark.createDataFrame([(4, "so One, two"), (5, "someone")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.leaks(one, items).collect()] == [(4, 8, 3, 6, 0, 1)]


def test_leaks(spark, odd_docs, no_docs):
    inside = prose(2, 300).split()
    items = [(1, " ".join(inside[20:60])), (2, prose(77, 60)), (3, None), (4, ""), (5, "one"), (None, prose(3, 120)),
             (1, " ".join(inside[20:60])), (6, prose(1, 30_000)[5000:6000])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    rows = decontaminate.leaks(odd_docs, benchmark).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == Counter(
        [(k, 1) for k in (1, 2, 3, 4, 200)] + [(None, None), (11, 6)] + [(k, 5) for k in (8, 9, 10)]
    )
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    place = next(r for r in rows if r.doc_id == 1)
    assert texts[1][place.start : place.stop] in texts[1] and place.edits == 0
    clean = decontaminate.without_leaks(odd_docs, benchmark)
    assert clean.schema == odd_docs.schema
    leaking = {(r.doc_id) for r in rows if r.doc_id is not None}
    wanted = Counter(tuple(r) for r in odd_docs.collect() if r.doc_id not in leaking and r.text != prose(3))
    assert Counter(tuple(r) for r in clean.collect()) == wanted
    assert decontaminate.leaks(no_docs, benchmark).collect() == []
    assert decontaminate.leaks(odd_docs, benchmark.limit(0)).collect() == []


def test_a_large_benchmark_is_searched_in_parts(spark, odd_docs, monkeypatch):
    items = spark.createDataFrame([(k, prose(k, 40)) for k in range(30)], "item_id long, text string")
    whole = Counter(tuple(r) for r in decontaminate.leaks(odd_docs, items).collect())
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 500)
    assert Counter(tuple(r) for r in decontaminate.leaks(odd_docs, items).collect()) == whole and whole


# -- chat --------------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=25)
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["system", "user", "assistant", "tool", None]),
            st.one_of(st.none(), st.sampled_from(HARD), st.text(alphabet="a<>/s[]INST\\ \n", max_size=20)),
        ),
        min_size=1, max_size=6,
    )
)
def test_chat_round_trip(spark, turns):
    rows = [(5, k, role, text, "x") for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    done = chat.format_chats(df).withColumn("read", chat.read_chats(F.col("formatted"))).collect()
    assert len(done) == 1
    clean = [(role or "", text or "") for role, text in turns]
    assert [tuple(t) for t in done[0].read] == clean
    assert "".join(s.text for s in done[0].segments) == done[0].formatted
    trained = [text for role, text in clean if role == "assistant"]
    assert len([s for s in done[0].segments if s.loss]) == len(trained)
    path = [*zip(["start", *[r for r, _ in clean]], [r for r, _ in clean])]
    fine = all(b in chat.INSTRUCTION.moves.get(a, ()) for a, b in path) and clean[-1][0] in chat.INSTRUCTION.final
    assert done[0].valid_order == fine


def test_chat_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (None, 1, "user", "n"), (2, 1, "user", "x"), (2, 1, "user", "x")]
    done = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert done[1].formatted == "<s>[INST] a [/INST][OUT]b</s>" and done[1].valid_order
    assert done[2].n_turns == 2 and not done[2].valid_order and None in done
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_chat_stays_on_built_in_expressions(spark, plan):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(df).withColumn("read", chat.read_chats(F.col("formatted")))
    assert not re.search("Python|Arrow|Pandas", plan(done))


# -- WARC --------------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sampled_from(["WARC/1.1", "WARC/", "1.1", "\r\n", "é", "x" * 5]), max_size=12).map("".join))
def test_chunks(payload):
    parts = [part.decode() for part in warc.chunks(memoryview(payload.encode()), most=7)]
    assert "".join(parts) == payload and parts
    assert all(len(p.encode()) <= 7 and warc.VERSION not in p for p in parts)


def test_chunk_rows_hold_running_digests_and_little_memory():
    """A payload of 60 MB beside a small one: the rows put together again, and the peak of what is held."""
    import tracemalloc

    html = ["é" * (30 << 20), "small", None]
    given = pa.RecordBatch.from_arrays(
        [pa.array([0, 1, 2]), pa.array([5, 6, 7]), pa.array(["u"] * 3), pa.array(html)], ["row_id", "page_id", "url", "html"]
    )
    wanted = [hashlib.sha256((text or "").encode()) for text in html]
    tracemalloc.start()
    again, ends, arrow = [hashlib.sha256() for _ in html], {}, 0
    for batch in warc._chunk_rows(iter([given])):
        arrow = max(arrow, batch.nbytes)
        for row in batch.to_pylist():
            again[row["row_id"]].update(row["chunk"].encode())
            assert row["digest"] == again[row["row_id"]].hexdigest() and len(row["chunk"].encode()) <= warc.CHUNK
            if row["last"]:
                ends[row["page_id"]] = (row["so_far"], row["digest"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ends == {5 + k: (len((html[k] or "").encode()), wanted[k].hexdigest()) for k in range(3)}
    assert peak < 40 << 20 and arrow < 8 << 20


def test_records_are_decided_without_payloads_and_shuffled_once(spark, plan):
    rows = [(k, "u", "x" * 150 if k % 3 == 0 else f"{k}" * 100) for k in range(50)]
    chunked = warc.chunk_table(spark.createDataFrame(rows, "page_id long, url string, html string"))
    heads = warc.record_heads(chunked)
    assert {r.page_id: r.refers_to for r in heads.collect()} == {k: 0 if k % 3 == 0 else None for k, _, _ in rows}
    assert not re.search(r"\bchunk#", plan(heads))
    whole = plan(warc.archive_rows(chunked, heads))
    assert len(re.findall(r"hashpartitioning\(row_id", whole)) >= 1 and not re.search(r"Join.*row_id", whole)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 50)
    same, fake = "<p>" + "z" * 200, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc WARC/1.1"
    pages = [(3, "u", same), (1, "u\r\nX: y", same), (2, None, same), (4, "u", "é" * 99), (5, "u", None), (6, "u", ""),
             (7, "u", fake), (8, "u", fake * 20), (9, "WARC/1.1", "short"), (10, "u", "short"), (None, "u", same),
             (11, "u", "é" * 99), (1, "u", same), (12, "u", "q" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    folder = scratch_dir(spark, "warc")
    warc.write_archives(df, folder)
    rows = warc.read_archives(spark, folder).collect()
    first = defaultdict(list)
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= 100:
            first[html].append(page)
    wanted = Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        target = min(first[html]) if html in first else page
        again = target != page and len(raw) >= 100
        kind, refers = ("revisit", target) if again else ("response", None)
        wanted[(page, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers)] += 1
    assert Counter(tuple(r) for r in rows) == wanted
    empty = scratch_dir(spark, "warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).collect() == []


# -- packing -----------------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet=" \n\t\r\x1c\x85\xa0aAbé\u0301ßİΣσ'sStT.,!?3日—ﬁ|<>", max_size=40))
def test_words_are_encoded_as_the_whole(text):
    whole = Tokenizer.from_file(TOKENS).encode(text, add_special_tokens=False).ids
    encoder = packing.WordEncoder(TOKENS)
    assert encoder.encode([text, "", text])[2].tolist() == whole


def test_full_stores_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder, plain = packing.WordEncoder(TOKENS), Tokenizer.from_file(TOKENS)
    for text in ["<|endoftext|> it's", prose(1), prose(2), "", prose(1)]:
        assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("total", [1, 2, 3, 2047, 2048, 2049, 6000])
def test_pieces(total):
    pieces = packing.binary_pieces(total).tolist()
    assert sum(pieces) == total and all(p & (p - 1) == 0 and p <= 2048 for p in pieces)
    assert pieces == sorted(pieces, reverse=True) and all(pieces.count(p) == 1 for p in pieces if p < 2048)


def test_usual_words_are_encoded_in_line_and_kept_by_number(monkeypatch):
    plain = Tokenizer.from_file(TOKENS)
    encoder, calls, whole = packing.WordEncoder(TOKENS), [], packing.WordEncoder._word
    monkeypatch.setattr(packing.WordEncoder, "_word", lambda self, word: calls.append(word) or whole(self, word))
    monkeypatch.setattr(packing, "CACHED_WORDS", 150)
    for seed in (*range(6), 2, 0):
        texts = [prose(seed, 120), "", prose(seed + 50, 60).upper() + " Ab, cd, ab| <|x|>\n\u00c9t\u00e9 3a \u03a3\u03a3"]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder.begins) == len(encoder.sizes) == len(encoder.known)
    # only words of other signs, and the first with each kind of tail, go through the slower way
    assert not [word for word in calls if word.isascii() and word.isalpha()]
    assert encoder.older and encoder.known


def test_words_are_looked_up_by_their_bytes(monkeypatch):
    monkeypatch.setattr("regiometric.llm.words.ADDED", 3)
    monkeypatch.setattr(packing, "CACHED_WORDS", 60)
    encoder, plain = packing.WordEncoder(TOKENS), Tokenizer.from_file(TOKENS)
    encoder.encode(["Word word, WORD!\nword, \u00e9t\u00e9 \u00e9t\u00e9."])
    assert len(encoder.known) == 5  # two words and three signs, in every case and before any sign
    odd = ["a", "a\0", "\0", "a\0b", "A\0,", "x" * 8, "x" * 9, "X" * 16, "x" * 17, "Y" * 17 + "...", "z!" * 30, "1" * 9]
    odd += ["ab" + "9" * 12, "\u00d7.", "\u00f7,", "\u00e9" * 8, "\u00c9" * 8 + "x", "\u00c9,", "don't,", "'s.", "a'S!", "e\u0301."]
    odd += ["<|endoftext|>", "<|ENDOFTEXT|>,", "A|B", "\u65e5,", "\u03a3.", "\u0391\u03a3\u0301'", "\x01A.", "\tB,", "", "|"]
    texts = [" ".join(odd), *odd, " ".join(odd[::-1]).upper(), prose(1, 90), *odd]
    for begin in (0, 1, 5):
        column = pa.array([None, *texts, ""])[begin:]
        ids, sizes = encoder.encode_column(column)
        wanted = [plain.encode(text or "", add_special_tokens=False).ids for text in column.to_pylist()]
        assert ids.tolist() == [x for found in wanted for x in found] and sizes.tolist() == [len(x) for x in wanted]


def test_packing(spark, odd_docs, no_docs):
    rows = packing.pack_power_of_two(odd_docs, TOKENS).collect()
    plain = Tokenizer.from_file(TOKENS)
    wanted = Counter()
    for r in odd_docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for size in packing.binary_pieces(len(ids)).tolist():
            part = np.array(ids[at : at + size], dtype="<u4")
            wanted[(r.doc_id, at, size, zlib.crc32(part.tobytes()), len(ids), tuple(part.tolist()))] += 1
            at += size
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in rows) == wanted
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(1 << r.bucket == r.length for r in rows)
    assert packing.pack_power_of_two(no_docs, TOKENS).collect() == []


# -- neighbours --------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, id long, vector string, block int, query string"
    return spark.createDataFrame([(i, v, 1, "v", 2, "q") for i, v in rows], schema)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(700)]
    rows += [(700 + k, rows[100][1]) for k in range(30)]  # ties
    bad = [(800, None), (900, [0.0] * 8), (1000, [None] + [1.0] * 7), (1100, [float("nan")] * 8), (None, [1.0] * 8),
           (1200, [float("inf")] + [1.0] * 7), (1300, [1.0] * 7), (1400, [])]
    got = defaultdict(list)
    for r in neighbours.nearest(vectors(spark, rows + bad), share=1.0, block_rows=100).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for query, found in got.items():
        d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != query][:10]
        assert sorted(found) == [(n, int(ids[k]), d[k]) for n, k in enumerate(order, 1)]


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    got = defaultdict(set)
    for r in neighbours.nearest(vectors(spark, [(k, v.tolist()) for k, v in enumerate(x)])).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for query, found in got.items():
        d = ((x - x[query]) ** 2).sum(1)
        d[query] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_neighbours_of_few(spark):
    assert neighbours.nearest(vectors(spark, [])).collect() == []
    assert neighbours.nearest(vectors(spark, [(0, [1.0, 2.0])])).collect() == []
    few = neighbours.nearest(vectors(spark, [(0, [1.0, 2.0]), (3, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [4.0, 6.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(few)] == [(0, 1, 3, 0.0), (0, 2, 7, 5.0)]


def test_arrow_slices_cover_all_rows():
    from regiometric.llm.words import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 100, 1, 1, 30)] + [None])], ["text"])
    parts = list(slices(batch, "text", 20))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 2
