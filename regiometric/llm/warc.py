"""WARC archives through a chunked record table.

Payloads become rows of (record, chunk number, chunk of at most ``CHUNK`` bytes), each with the bytes and the digest of
the payload so far, so that the last row of a record holds those of the whole. The table is written once. Which records
are revisits is decided on the last rows alone; a head row per record then goes before its chunks by one shuffle and
sort on (record, number), and a task writes its records chunk by chunk: the first as the response, the others as
continuation records with their segment numbers. Beside the source row itself, only chunks are held, on writing and on
reading. Archives are written and read by Spark's text source; records are told apart by the version line that opens
each. A chunk ends inside every version string that a payload holds, so none is ever seen whole in a record, and reading
needs no escapes. Each archive is one compressed file that one task reads front to back, carrying the digest of the
payload from chunk to chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometric.llm.words import slices, tidy
from regiometric.session import scratch_dir, stage

VERSION = "WARC/1.1"
LEAST_REVISIT = 100
CHUNK = 1 << 18
BATCH_BYTES = 4 << 20
LINE = "\r\n"
DATE = "1970-01-01T00:00:00Z"
CHUNKS = (
    "row_id long, page_id long, url string, number int, chunk string, so_far long, digest string, last boolean"
)
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def chunks(payload: memoryview, most: int = CHUNK) -> Iterator[bytes]:
    """UTF-8 ``payload`` in parts of at most ``most`` (4 or more) bytes of whole characters, none of which holds the
    version string; an empty payload is one empty part."""
    mark = VERSION.encode()
    at, end = 0, len(payload)
    while True:
        window = bytes(payload[at : at + most + len(mark)])
        cut = min(most, end - at)
        while at + cut < end and window[cut] & 0xC0 == 0x80:  # inside a character
            cut -= 1
        found = window.find(mark)
        if found >= 0:
            cut = min(cut, found + len(mark) // 2)
        yield window[:cut]
        at += cut
        if at >= end:
            return


def _record(fields: list[tuple[str, object]], body: str, length: int) -> str:
    """One record without the line end that the text writer adds; control characters in fields are dropped."""
    lines = [VERSION]
    for name, value in fields:
        if value is not None:
            clean = "".join(c for c in str(value) if c >= " ").replace(VERSION, "WARC%2F1.1")
            lines.append(f"{name}: {clean}")
    return LINE.join([*lines, f"Content-Length: {length}", "", body]) + LINE


def _urn(page_id: int | None, salt: object) -> str:
    name = f"page:{page_id}" if page_id is not None else f"row:{salt}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each page, with bytes and digest of its payload up to and with the chunk."""
    names = ["row_id", "page_id", "url", "number", "chunk", "so_far", "digest", "last"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        rows: list[tuple] = []
        held = 0
        row_ids, pages, urls, htmls = (batch.column(name) for name in ("row_id", "page_id", "url", "html"))
        for row in range(batch.num_rows):
            html = htmls[row]
            payload = memoryview(html.as_buffer() if html.is_valid else b"")
            key = (row_ids[row].as_py(), pages[row].as_py(), urls[row].as_py())
            running, so_far = hashlib.sha256(), 0
            for number, chunk in enumerate(chunks(payload, CHUNK), 1):
                running.update(chunk)
                so_far += len(chunk)
                rows.append((*key, number, chunk.decode(), so_far, running.hexdigest(), so_far == len(payload)))
                held += len(chunk)
                if held > BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)


def chunk_table(pages: DataFrame) -> DataFrame:
    """The chunk rows of ``pages``, written once: ``row_id``, ``page_id``, ``url``, ``number`` from 1, ``chunk``,
    ``so_far`` and ``digest`` of the payload up to and with the chunk, ``last``."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long").alias("page_id"), "url", "html"
    )
    folder = scratch_dir(pages.sparkSession, "chunks")
    rows.mapInArrow(tidy(_chunk_rows), CHUNKS).write.parquet(folder, compression="zstd")
    return pages.sparkSession.read.schema(CHUNKS).parquet(folder)


def record_heads(chunked: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """A row per record of a chunk table: ``row_id``, ``page_id``, ``url``, ``size``, ``digest`` and ``refers_to``: the
    smallest page id among equal payloads of ``least`` bytes or more that occur more than once, else null.

    No payload is read. The repeated payloads are written first, so that the join has two plain sides and rows of one
    payload can be split if they are very many.
    """
    ends = chunked.filter("last").select("row_id", "page_id", "url", F.col("so_far").alias("size"), "digest")
    first = ends.filter(F.col("size") >= least).groupBy("digest", "size")
    first = first.agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return ends.join(stage(first, "first"), ["digest", "size"], "left")


def _archive_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One WARC record per row, from heads (number 0) that are followed by their chunks in order."""
    head: dict = {}
    revisit = False
    for whole in batches:
        for batch in slices(whole, "chunk", BATCH_BYTES):
            out: list[str] = []
            for row in batch.to_pylist():
                if row["number"] == 0:
                    head, page = row, row["page_id"]
                    revisit = row["refers_to"] is not None and row["refers_to"] != page
                    origin = _urn(page, row["row_id"])
                    common = [
                        ("WARC-Record-ID", origin),
                        ("WARC-Date", DATE),
                        ("WARC-Target-URI", row["url"]),
                        ("Page-ID", page),
                        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
                        ("Payload-Length", row["size"]),
                    ]
                    if revisit:
                        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                        first = row["refers_to"]
                        extra = [("WARC-Profile", profile), ("WARC-Refers-To", _urn(first, "")), ("Refers-To-Page-ID", first)]
                        out.append(_record([("WARC-Type", "revisit"), *common, *extra], "", 0))
                    continue
                if head.get("row_id") != row["row_id"]:
                    raise ValueError("chunks without the head of their record")
                if revisit:
                    continue
                part, number = row["chunk"], row["number"]
                body = len(part.encode())
                if number == 1:
                    segment = [] if row["last"] else [("WARC-Segment-Number", 1)]
                    out.append(_record([("WARC-Type", "response"), *common, *segment], part, body))
                    continue
                fields = [
                    ("WARC-Type", "continuation"),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin}#{number}')}>"),
                    ("WARC-Date", DATE),
                    ("WARC-Segment-Origin-ID", origin),
                    ("WARC-Segment-Number", number),
                ]
                last = [("WARC-Segment-Total-Length", head["size"])] if row["last"] else []
                out.append(_record([*fields, *last], part, body))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def archive_rows(chunked: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads and chunks of all records, those of one record together and in order; one shuffle, no join."""
    begins = heads.withColumns({"number": F.lit(0), "chunk": F.lit(None).cast("string"), "last": F.lit(False)})
    both = begins.unionByName(chunked.select("row_id", "number", "chunk", "last"), allowMissingColumns=True)
    return both.repartition("row_id").sortWithinPartitions("row_id", "number")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> None:
    """Write a WARC record for every row of ``pages`` (``page_id``, ``url``, ``html``; other columns are ignored).

    A null html is an empty payload; a null url or page id leaves its field out. Among rows of equal payloads of at
    least ``least`` bytes those with the smallest page id are responses (several, if that id is repeated; all, if all
    ids are null) and the others revisits of it. An empty table writes archives without records.
    """
    chunked = chunk_table(pages)
    rows = archive_rows(chunked, record_heads(chunked, least))
    rows.mapInArrow(tidy(_archive_records), "value string").write.option("lineSep", LINE).text(folder, compression="gzip")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of archives whose pieces come in order; holds one piece and the running digest."""
    state: dict | None = None

    def finish(done: dict | None) -> list[dict]:
        if done is None:
            return []
        if done["kind"] == "response":
            digest = done["hash"].hexdigest()
            if f"sha256:{digest}" != done["told"] or done["bytes"] != done["size"]:
                raise ValueError(f"payload of page {done['page_id']} differs from its digest or length")
        page, refers = done["page_id"], done["refers_to"]
        return [{
            "page_id": page, "payload_bytes": done["size"], "payload_digest": done["told"].removeprefix("sha256:"),
            "record_type": done["kind"], "refers_to": refers,
        }]

    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])
    for batch in batches:
        out: list[dict] = []
        for piece in batch.column("value"):
            raw = piece.as_buffer().to_pybytes() if piece.is_valid else b""
            if not raw:
                continue  # what stands before the first record of an archive
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split(LINE) if ": " in line)
            length = int(fields["Content-Length"])
            body = rest[:length]
            if len(body) != length or rest[length:].strip(b"\r\n"):
                raise ValueError(f"record {fields.get('WARC-Record-ID')} is not as long as it says")
            kind = fields["WARC-Type"]
            if kind == "continuation":
                expected = state and (state["id"], state["number"] + 1)
                if expected != (fields["WARC-Segment-Origin-ID"], int(fields["WARC-Segment-Number"])):
                    raise ValueError("a continuation record does not follow its predecessor")
                state["number"] += 1
                state["bytes"] += length
                state["hash"].update(body)
                continue
            out.extend(finish(state))
            page, refers = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
            state = {
                "id": fields["WARC-Record-ID"], "number": 1, "kind": kind, "bytes": length,
                "hash": hashlib.sha256(body), "told": fields["WARC-Payload-Digest"], "size": int(fields["Payload-Length"]),
                "page_id": int(page) if page is not None else None, "refers_to": int(refers) if refers is not None else None,
            }
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    yield pa.RecordBatch.from_pylist(finish(state), schema=schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit in the archives of ``folder``, digests recomputed from the payloads.

    Fails if a record or payload is cut short or altered. ``payload_bytes`` and ``payload_digest`` of a revisit are
    those of the payload it refers to.
    """
    pieces = spark.read.option("lineSep", VERSION + LINE).text(folder)
    return pieces.mapInArrow(tidy(_read), RECORDS)
