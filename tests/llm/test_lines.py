import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from regiometric.llm import lines


def key_of(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), bare)


def brute(rows, least_chars=40, least=5):
    """Kept text and counts by the plain definition; null ids are one document below all others."""
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(doc)
    out = []
    for doc, text in rows:
        split = (text or "").split("\n")
        kept = []
        for line in split:
            of = holders.get(key_of(line), ())
            if len(of) < least or max(of, key=order) == doc:
                kept.append(line)
        out.append((doc, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def run(df, rows, **settings):
    cut = lines.remove_repeated_lines(df, **settings)
    return rows(cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("digest")))


def ordered(found):
    return sorted(found, key=lambda row: tuple((v is not None, str(v)) for v in row))


def case(seed, documents, ids):
    rng = random.Random(seed)
    common = ["Ä shared line of prose with MORE than forty signs, number %d" % k for k in range(12)]
    common += ["exactly " + "x" * 32, "  short " + "y" * 20, "日" * 40, "日" * 39]
    out = []
    for k in range(documents):
        body = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(common) if rng.random() < 0.6 else "own %d %d %s" % (k, rng.random() * 1e9, "z" * 40)
            body.append(rng.choice(["", " ", "\t"]) + rng.choice([line, line.upper(), line.lower()]) + rng.choice(["", "\r", " \x0b"]))
        out.append((ids(k, rng), "\n".join(body)))
    return out


@pytest.mark.parametrize("batches, fan", [(1, 2), (4, 3), (9, 2)])
def test_against_plain_lines(spark, rows, batches, fan):
    data = case(1, 120, lambda k, rng: k)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = run(df, rows, batches=batches, fan=fan)
    assert got == ordered(brute(data))
    assert sum(r[2] for r in got) > 50


def test_repeated_and_null_ids(spark, rows):
    data = case(2, 90, lambda k, rng: rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]))
    data += [data[0]] * 3 + [(None, None), (9, None), (9, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert run(df, rows) == ordered(brute(data))


def test_odd_documents(spark, rows, odd_docs, no_docs):
    data = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs, rows, least_documents=2) == ordered(brute(data, least=2))
    assert run(odd_docs, rows, least_documents=2, least_chars=1) == ordered(brute(data, 1, 2))
    assert run(no_docs, rows) == []
    kept = lines.remove_repeated_lines(odd_docs, carry=["lang", "n_chars"])
    assert kept.columns == ["doc_id", "n_lines", "n_dropped", "kept_text", "lang", "n_chars"]


def test_a_very_common_line_and_a_very_long_text(spark, rows):
    common = "the same long line of boiler plate in every text"
    data = [(k, f"{common}\nunique {k} {'u' * 40}") for k in range(400)] + [(400, "\n".join([common] * 20_000))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = run(df, rows)
    assert got == ordered(brute(data))
    again = run(spark.createDataFrame([(500, data[-1][1]), *data], df.schema), rows)
    assert {r[0]: r[2] for r in again}[400] == 20_000


def test_runs_are_compacted_and_settled_keys_stay_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a line that is the same in all of the documents").alias("text"))
    found = lines.document_lines(docs)
    runs = lines.LineRuns(spark, fan=3)
    for low in range(300, -1, -100):
        runs.add(found.filter(F.col("id").between(low, low + 99)))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert [run.count() for level in runs.levels for run in level] == [0, 1]  # only the first batch had anything to add
    assert [r.largest for r in runs.repeated().collect()] == [399]


def test_no_python_and_no_shuffle_of_runs(spark, odd_docs, plan):
    runs = lines.LineRuns(spark, fan=8)
    found = lines.document_lines(odd_docs)
    runs.add(found)
    runs.add(found)
    with_runs = runs._merged([run for level in runs.levels for run in level])
    assert "Exchange" not in plan(with_runs)
    text = plan(lines.remove_repeated_lines(odd_docs))
    assert "Python" not in text and "Arrow" not in text
