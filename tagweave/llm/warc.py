"""WARC archives of page captures: writing them as shards, reading records, and putting each capture together again.

A capture is three records: the ``request``, the ``response`` (or, for a payload that another capture already has, a
``revisit``) and a ``metadata`` record. Requests and metadata name their response in WARC-Concurrent-To; metadata may name the
request instead, so the link is followed once more.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, open_file, stored, write_file

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE_DATE = "2020-01-01T00:00:00Z"
# Bytes of compressed input that a reader asks for at once.
READ_BYTES = 1 << 20

RECORD_FIELDS = {
    "record_id": "string", "record_type": "string", "concurrent_to": "string", "target_uri": "string", "page_id": "long",
    "payload_digest": "string", "refers_to": "string", "payload": "binary", "content_type": "string",
}
RECORD = ", ".join(f"{k} {v}" for k, v in RECORD_FIELDS.items())


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def render(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block + END


def zipped(record: bytes) -> bytes:
    """One gzip member, so that a reader can start at any record."""
    tool = zlib.compressobj(1, zlib.DEFLATED, 31)
    return tool.compress(record) + tool.flush()


def one_line(text: str | None) -> str:
    """A header value: line breaks and control characters cannot stand in one."""
    return "".join(c if c.isprintable() else " " for c in text or "").strip()


def capture_records(shard: str, n: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> Iterator[bytes]:
    """The three records of one capture, in the order request, response or revisit, metadata.

    Page ids, that of the page a revisit refers to as well, travel in extension headers, as urls may repeat or be missing. What a revisit
    refers to is named by target and date, as the format allows in place of a record id.
    """
    ids = {kind: record_id(shard, n, kind) for kind in ("request", "response", "metadata")}
    uri = one_line(url)
    common = [("WARC-Date", CAPTURE_DATE), *([("WARC-Target-URI", uri)] if uri else []), *([("X-Page-Id", str(page_id))] if page_id is not None else [])]
    path = "/" + uri.split("://", 1)[-1].partition("/")[2]
    host = uri.split("://", 1)[-1].partition("/")[0]
    yield render(
        [("WARC-Type", "request"), ("WARC-Record-ID", ids["request"]), ("WARC-Concurrent-To", ids["response"]), *common,
         ("Content-Type", "application/http;msgtype=request")],
        f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
    )
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        target = one_line(refers_url)
        special = [("WARC-Profile", REVISIT_PROFILE), *([("WARC-Refers-To-Target-URI", target)] if target else []),
                   ("WARC-Refers-To-Date", CAPTURE_DATE), ("X-Refers-To-Page-Id", str(refers_to))]
    else:
        special = []
    # A revisit repeats the payload only if a reader could not find it elsewhere; here each record carries its own length and digest.
    yield render(
        [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", ids["response"]), *special, *common,
         ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")],
        http if revisit else http + payload,
    )
    yield render(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), ("WARC-Concurrent-To", ids["request"]), *common,
         ("Content-Type", "application/warc-fields")],
        b"fetchTimeMs: 0\r\n",
    )


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, refers_url, revisit): of equal payloads of ``min_bytes`` or more, the smallest page id is the response.

    Payloads are told apart by SHA-1 and length. The smallest id is found by an aggregate that combines before its shuffle, and only
    payloads that occur more than once are joined back, so a payload that a third of all pages share neither gathers
    in a task nor moves more than once. Rows that repeat the smallest page id of their payload are responses as well;
    a null page id counts as the largest and never is what a revisit refers to while another page has the payload. ``refers_url`` is
    the smallest url under the page id referred to.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "_n": F.length("payload")})
    groups = rows.where(F.col("_n") >= min_bytes).groupBy("sha1", "_n").agg(
        F.count(F.lit(1)).alias("_c"), F.min("page_id").alias("refers_to"),
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first"),
    )
    shared = groups.where(F.col("_c") > 1).select("sha1", "_n", "refers_to", F.col("_first.url").alias("refers_url"))
    joined = rows.join(shared, ["sha1", "_n"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    out = joined.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("refers_to")))
    return out.select("page_id", "url", "payload", "sha1", "refers_to", "refers_url", "revisit")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzipped WARC shards; return the manifest (shard, path, captures, bytes).

    Every partition of the table becomes one shard.
    A null html counts as empty, a null url leaves the target header out, repeated rows are captures of their own, other
    columns are ignored, and an empty table gives no shard. A shard appears under its name only when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, done = f"{folder}/captures-{part:08d}.warc.gz", [0]

        def chunks() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to", "refers_url", "revisit")]
                for page_id, url, payload, sha1, refers_to, refers_url, revisit in zip(*columns, strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    for record in capture_records(path.rsplit("/", 1)[1], done[0], page_id, url, payload, digest, refers_to, refers_url, revisit):
                        yield zipped(record)
                    done[0] += 1

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        size = write_file(path, (x for some in ([first], stream) for x in some))
        yield pa.RecordBatch.from_pydict({"shard": [part], "path": [path], "captures": [done[0]], "bytes": [size]})

    rows = with_revisits(pages, min_bytes)
    return stored(arrow_map(rows, run, "shard long, path string, captures long, bytes long"), "archives")


def members(file) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one record each, while only one of them and one stretch of input is held."""
    tool, parts = zlib.decompressobj(31), []
    while data := file.read(READ_BYTES):
        while data:
            parts.append(tool.decompress(data))
            data = tool.unused_data
            if tool.eof:
                yield b"".join(parts)
                tool, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, mark, rest = record.partition(END)
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != END:
        raise ValueError("a record's length does not fit its header")
    return headers, block


def record_row(record: bytes) -> tuple:
    headers, block = parse(record)
    kind = headers["warc-type"]
    payload = block.partition(END)[2] if "http" in headers.get("content-type", "") else block
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    page = headers.get("x-page-id")
    return (
        headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), None if page is None else int(page),
        digest, headers.get("x-refers-to-page-id"), payload, headers.get("content-type"),
        int(headers.get("x-payload-length", 0)) if kind == "revisit" else len(payload),
    )


def read_records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the shards listed in ``manifest``: the columns of ``RECORD`` and ``payload_bytes`` (length of the full payload).

    Digests of responses are checked against their payloads. ``payloads=False`` leaves the bytes out.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = {**RECORD_FIELDS, "payload_bytes": "long"}
    schema = pa.schema([(k, kinds[v]) for k, v in fields.items()])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path in files.column("path").to_pylist():
                rows, size = [], 0
                with open_file(path) as file:
                    for record in members(file):
                        row = record_row(record)
                        rows.append(row if payloads else (*row[:7], None, *row[8:]))
                        size += len(record) + 500
                        if size > 4_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    # One shard a task: the manifest is a few bytes, and Spark would else put all of it into one.
    files = manifest.select("path").repartition(max(1, manifest.count()))
    return arrow_map(files, run, f"{RECORD}, payload_bytes long")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata records as structs (null if absent).

    Requests and metadata are joined through ``concurrent_to``; what names a request is taken to that request's response.
    Further requests or metadata of one response give the one with the smallest record id; records that lead to no response are
    left out. Record ids are unique, so no key is hot.
    """
    part = F.struct("record_id", "target_uri", "content_type", "payload")
    main = records.where(F.col("record_type").isin("response", "revisit")).drop("concurrent_to")
    requests = records.where("record_type = 'request'").select(F.col("concurrent_to").alias("_root"), part.alias("request"))
    root = requests.select(F.col("request.record_id").alias("concurrent_to"), "_root")
    metadata = records.where("record_type = 'metadata'").select("concurrent_to", part.alias("metadata"))
    # Records come out of Python, so Spark takes them for as few bytes as the manifest has: without the hint it would broadcast them.
    metadata = metadata.join(root.hint("merge"), "concurrent_to", "left").select(F.coalesce("_root", "concurrent_to").alias("_root"), "metadata")
    linked = requests.withColumn("metadata", F.lit(None).cast(metadata.schema["metadata"].dataType)).unionByName(
        metadata.withColumn("request", F.lit(None).cast(requests.schema["request"].dataType))
    )
    linked = linked.groupBy("_root").agg(F.min_by("request", "request.record_id").alias("request"), F.min_by("metadata", "metadata.record_id").alias("metadata"))
    return main.join(linked.hint("merge"), main["record_id"] == linked["_root"], "left").drop("_root")


def archive_round_trip(pages: DataFrame, folder: str, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write ``pages`` as archives, read them back and return one assembled row per capture (see :func:`assemble`).

    Without ``payloads`` the records are narrow and written once, so that the archives are read a single time.
    """
    records = read_records(write_archives(pages, folder, min_bytes), payloads)
    return assemble(records if payloads else stored(records, "records"))


def capture_digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the ids of the joined records of assembled captures."""
    return captures.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"),
        "record_id", F.col("request.record_id").alias("request_id"), F.col("metadata.record_id").alias("metadata_id"),
    )

