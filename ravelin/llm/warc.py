"""WARC archives: writing captures as linked records, reading them, and assembling transactions."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK = "\r\n\r\n"  # what ends a record, and so what the text writer puts after each
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_A_FILE = 6000
CHUNK = 1 << 20  # bytes of payload in a batch of records, or little more


def digest_of(payload: bytes) -> str:
    """The payload digest of WARC tools: bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    """A record without its final two line breaks; fields without a value are left out."""
    head = {"WARC-Type": kind, **fields, "Content-Length": len(block)}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None), "", ""]).encode() + block


def asked_for(url: str | None) -> bytes:
    """The request for a URL: its path and query, and the host; a URL that cannot be read asks for the root."""
    try:
        parts = urlsplit(url or "")
        path, host = (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), parts.netloc.rpartition("@")[2]
    except ValueError:
        path, host = "/", ""
    return (f"GET {path.replace(' ', '%20')} HTTP/1.1\r\n" + (f"Host: {host}\r\n" if host else "") + "\r\n").encode()


def capture(key: object, url: str | None, payload: bytes, first: bool, target: str | None) -> list[bytes]:
    """The response (or, of what is not the first of its payload, revisit), request and metadata records of a capture,
    linked by WARC-Concurrent-To. ``target``: the URL that a revisit refers to.

    Line breaks in a URL would end its header: they are written as %0A and %0D.
    """
    clean = lambda x: None if x is None else x.replace("\r", "%0D").replace("\n", "%0A")
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    me, digest, url = name(), digest_of(payload), clean(url)
    both = {"WARC-Date": DATE, "WARC-Target-URI": url}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if first:
        main = record("response", {"WARC-Record-ID": me, **both, **more}, http + payload)
    else:
        main = record("revisit", {"WARC-Record-ID": me, **both, "WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": clean(target), "WARC-Refers-To-Date": DATE, **more}, http)
    asked = record("request", {"WARC-Record-ID": name(), **both, "WARC-Concurrent-To": me, "Content-Type": "application/http; msgtype=request"}, asked_for(url))
    about = b"" if key is None else f"captureId: {key}\r\n".encode()
    return [main, asked, record("metadata", {"WARC-Record-ID": name(), **both, "WARC-Concurrent-To": me, "Content-Type": "application/warc-fields"}, about)]


def write_archives(captures: DataFrame, path: str, scratch, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> None:
    """Write gzip-compressed archives with three records for every row of ``captures``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest id are responses and the
    others revisit it. Only the digests that repeat are gathered; their table is written, so its true size decides
    whether Spark sends it to every task or joins it by sorted shuffles, in which a digest with many rows is split.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = captures.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    again = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("key", "url")).alias("first")).where("n > 1").select("sha", "first")
    again = scratch.write(again, "again")
    linked = rows.join(again, "sha", "left").select("key", "url", "payload", (F.col("first").isNull() | F.col("key").eqNullSafe(F.col("first.key"))).alias("is_first"), F.col("first.url").alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for row in zip(*(batch.column(i) for i in range(5))):
                made += capture(*(x.as_py() for x in row))
                size += len(made[-3])
                if size > CHUNK:
                    yield pa.record_batch([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            if made:
                yield pa.record_batch([pa.array(made, pa.binary())], names=["value"])

    lines = linked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.mode("overwrite").option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; blocks are cut by Content-Length, so any bytes may be in them.
    What is held is one record and a part."""
    held, head, need, at = bytearray(), None, 0, 0
    for part in parts:
        held += part
        while True:
            if head is None:
                start = held.find(b"WARC/1.", at)
                end = held.find(b"\r\n\r\n", start) if start >= 0 else -1
                if end < 0:
                    break
                head = {k.lower(): v for k, _, v in (x.partition(": ") for x in held[start:end].decode().split("\r\n")[1:])}
                at, need = end + 4, int(head["content-length"])
            if len(held) < at + need:
                break
            yield head, bytes(held[at : at + need])
            head, at = None, at + need
        del held[:at]
        at = 0


RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, digest string, payload_bytes long, notes map<string,string>"


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """A row for every record of the archives under ``path``: identifiers, links, payload digest and metadata fields.

    The digest and the length of a response are those of the payload that was read; a digest header that disagrees
    raises. A revisit has the digest of its header and no length. The payload itself only with ``keep_payload``.

    Spark's text reader unpacks the archives and cuts them at every two line breaks, wherever these are; what is between
    comes to a task in the order of the file and is put together again, so no task holds more of an archive than a
    record and a batch. A record that its archive breaks off is left out.
    """
    def rows(parts: Iterator[bytes]):
        for head, block in parse(parts):
            kind, digest, size, notes, payload = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                size = len(payload)
                if digest != (digest := digest_of(payload)):
                    raise ValueError(f"payload digest of {head['warc-record-id']} does not hold")
            elif kind == "metadata":
                notes = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]
            yield head["warc-record-id"], kind, head.get("warc-target-uri"), head.get("warc-concurrent-to"), digest, size, notes, payload

    types = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["record_id", "record_type", "target_uri", "concurrent_to", "digest", "payload_bytes", "notes", "payload"][: 8 if keep_payload else 7]

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t, _ in zip(zip(*found), types, names)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, part) for batch in batches for f, part in zip(batch.column(0).to_pylist(), batch.column(1)))
        found: list[tuple] = []
        size = 0
        for _, of in groupby(pieces, itemgetter(0)):
            for row in rows(chain([next(of)[1].as_py()], (BREAK.encode() + part.as_py() for _, part in of))):
                found.append(row)
                size += len(row[-1] or b"") if keep_payload else 0
                if len(found) == 1000 or size > CHUNK:
                    yield table(found)
                    found, size = [], 0
        if found:
            yield table(found)

    lines = spark.read.option("lineSep", BREAK).option("pathGlobFilter", "*.gz").text(path)
    parts = lines.select(F.xxhash64("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("part"))
    return parts.mapInArrow(run, RECORD + (", payload binary" if keep_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: main (response or revisit), request and metadata, joined through concurrent-to.

    A capture without a request or metadata record keeps nulls there; request and metadata records whose response is
    missing are dropped. Further records of one kind that name the same response give further rows.
    """
    others = [c for c in ("target_uri", "digest", "payload_bytes", "payload") if c in records.columns]
    main = records.where("record_type IN ('response', 'revisit')").select("record_id", F.struct("record_type", *others).alias("main"))
    asked = records.where("record_type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "target_uri").alias("request"))
    about = records.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "notes").alias("metadata"))
    return main.join(asked, "record_id", "left").join(about, "record_id", "left")


def resolve(found: DataFrame) -> DataFrame:
    """``found`` (of ``assemble``) with ``refers_to`` and ``payload_bytes``: a revisit has those of the response of its
    payload digest, of which it takes the largest captureId should there be several."""
    key = F.col("metadata.notes")["captureId"].cast("long")
    of = found.where("main.record_type = 'response'").groupBy(F.col("main.digest").alias("digest")).agg(F.max(key).alias("first"), F.max("main.payload_bytes").alias("size"))
    revisits = found.where("main.record_type = 'revisit'").join(of, F.col("main.digest") == of["digest"], "left")
    rest = found.where("main.record_type = 'response'").select("*", F.lit(None).cast("long").alias("refers_to"), F.col("main.payload_bytes").alias("payload_bytes"))
    return rest.unionByName(revisits.select(*(found[c] for c in found.columns), F.col("first").alias("refers_to"), F.col("size").alias("payload_bytes")))


def archive_and_read(captures: DataFrame, scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``captures`` to archives in the shared folder, read them back and return one nested row per capture.

    What the archives say of records is read once and written without payloads. An archive has about 2,000 captures, of
    any size: it is written and read a batch at a time.

    Nulls: a null payload is empty, a null URL has no header, a null id no captureId; empty payloads repeat like any
    other. Rows that repeat an id and its payload are responses or revisits alike. No rows, no records.
    """
    write_archives(captures, scratch.path("warc"), scratch, id_col, url_col, payload_col, least_bytes)
    records = scratch.write(read_records(captures.sparkSession, scratch.path("warc")), "records")
    return resolve(scratch.write(assemble(records), "captures"))
