from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from regiometric.llm import packing, quality
from regiometric.llm.oracle import ORACLE
from regiometric.llm.queries import REGISTRY
from workloads import check

from .conftest import SCHEMA, prose, row
from .test_dedup import groups, plain_fingerprint, plain_removal

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are absent")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables in which every stage has something to do, with odd rows among them."""
    where = str(tmp_path_factory.mktemp("tables"))
    item, shared = prose(900, 40), prose(901, 60)
    docs = [row(k, prose(2000 + k, 150)) for k in range(150)]
    docs += [row(200 + k, " ".join(w + "###" for w in prose(3000 + k, 150).split())) for k in range(60)]
    docs += [row(300, prose(2000, 150)), row(301, prose(2001, 150)), row(None, prose(2002, 150))]
    docs += [row(310 + k, prose(4000 + k, 80) + "\n" + shared + " " + prose(4100 + k, 50)) for k in range(3)]
    docs += [row(320, prose(4200, 60) + " " + item.upper() + " " + prose(4201, 60))]
    docs += [row(330, None), row(331, ""), row(332, " "), row(340, prose(4300, 50)), row(340, prose(4300, 50))]
    labels = [(r[0], int("###" not in (r[1] or "")), 0) for r in docs[:210]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages_against_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    columns = corpus_pipeline.COLUMNS
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, folder).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = docs.collect()
        given = Counter((r.doc_id, r.text) for r in before)
        if name != "sequence_packing":
            assert docs.columns == columns
            now = Counter((r.doc_id, r.text) for r in after)
        if name == "quality_classifier":
            assert now <= given
            scored = quality.classify(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet"))
            accepted = Counter(r.doc_id for r in scored.collect() if r.predicted == 1)
            assert Counter(r.doc_id for r in after) == accepted
            assert sum(1 for r in after if "###" in (r.text or "")) < 15
            assert sum(1 for r in after if r.doc_id is not None and r.doc_id < 150) == 150
        elif name == "simhash_near_dedup":
            fps = {r: plain_fingerprint(r[1]) for r in given}
            distinct = sorted(set(fps.values()))
            root = groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3])
            kept = Counter(root[fps[r]] for r in now.elements())
            assert set(kept) == set(root.values()) and set(kept.values()) == {1}
            for r in now:
                ids = [o[0] for o in given if root[fps[o]] == root[fps[r]] and o[0] is not None]
                assert r[0] == min(ids, default=None)
        elif name == "substring_dedup":
            plain = plain_removal([r.text for r in before], 35)
            wanted = Counter((r.doc_id, p[3]) for r, p in zip(before, plain, strict=True))
            assert Counter((r.doc_id, " ".join(r.text.split(None))) for r in after) == wanted
            assert any(p[1] for p in plain) and all(r.n_chars == len(r.text) for r in after if r.text.strip())
        elif name == "benchmark_decontamination":
            assert given - now == Counter((r.doc_id, r.text) for r in before if r.doc_id == 320) and now <= given
        else:
            plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            wanted = Counter(
                (r.doc_id, size)
                for r in before
                for size in packing.binary_pieces(len(plain.encode(r.text, add_special_tokens=False).ids) + 1).tolist()
            )
            assert Counter((r.doc_id, r.length) for r in after) == wanted
        before = after
    done = corpus_pipeline.run(spark, folder).collect()
    strip = lambda rows: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(done) == strip(before)


@tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_counterpart(spark, monkeypatch, name):
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    monkeypatch.setattr(check, "REGISTRY", REGISTRY)
    monkeypatch.setattr(check, "ORACLE", ORACLE)
    assert check.compare(spark, connection, FOLDER, name) is None


@tables
@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLE)))
def test_query_returns_rows(spark, name):
    assert REGISTRY[name](spark, FOLDER).count() > 0
