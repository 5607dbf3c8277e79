"""Archives: what is written comes back, shared payloads become revisits, transactions are put together."""

import base64
import gzip
import hashlib

from pyspark.sql import types as T

from tagweave.llm import warc
from tagweave.llm.common import new_folder, open_file
from tagweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    T.StructField("payload", T.StringType()), T.StructField("revisit", T.LongType()), T.StructField("_n", T.LongType()),
])


def want(rows, min_bytes=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        revisit = len(raw) >= min_bytes and to is not None and to != i
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_op7_on_the_whole_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert got(QUERIES["op7_warc"](spark, FOLDER)) == want(rows)


def odd(spark):
    rows = [
        (5, "http://a.example/x", "<p>same</p>"), (3, "http://b.example", "<p>same</p>"), (9, None, None), (8, "http://c\r\nX: y/é ü", ""),
        (7, "http://d.example/", "WARC/1.1\r\n\r\n\r\n\r\nHTTP"), (4, "u", "é" * 300_000), (11, "u", "b\r\n\r\nb"), (12, "u", "b\r\n\r\nb"),
        (12, "u", "b\r\n\r\nb"), (None, "u", "b\r\n\r\nb"), (None, "n", "only null"), (3, "http://b.example", "<p>same</p>"),
    ]
    return rows, spark.createDataFrame([(*r, "x", 1, 2) for r in rows], PAGES)


def test_odd_pages(spark, tmp_path):
    rows, pages = odd(spark)
    assert got(warc.capture_digests(warc.archive_round_trip(pages, f"{tmp_path}/a"))) == want(rows)
    assert got(warc.capture_digests(warc.archive_round_trip(pages, f"{tmp_path}/b", min_bytes=10))) == want(rows, 10)
    assert got(warc.capture_digests(warc.archive_round_trip(pages.limit(0), f"{tmp_path}/c"))) == []


def test_nested_rows_hold_request_payload_and_metadata(spark, tmp_path):
    rows, pages = odd(spark)
    captures = warc.archive_round_trip(pages, str(tmp_path)).collect()
    assert len(captures) == len(rows) and len({c.record_id for c in captures}) == len(rows)
    by_type = {kind: [c for c in captures if c.record_type == kind] for kind in ("response", "revisit")}
    assert sorted(bytes(c.payload).decode() for c in by_type["response"]) == sorted(h or "" for (_, _, h), w in zip(
        sorted(rows, key=lambda r: str(r[0])), sorted(want(rows), key=lambda r: str(r[0])), strict=True) if w[3] == "response")
    assert all(not bytes(c.payload) for c in by_type["revisit"])
    for c in captures:
        assert c.request.record_id != c.metadata.record_id and bytes(c.metadata.payload).startswith(b"fetchTimeMs")
        assert c.request.target_uri == c.target_uri == c.metadata.target_uri


def test_shards_are_plain_warc(spark, tmp_path):
    rows, pages = odd(spark)
    manifest = warc.write_archives(pages, str(tmp_path)).collect()
    assert sum(m.captures for m in manifest) == len(rows)
    for m in manifest:
        with open_file(m.path) as f:
            raw = f.read()
        assert gzip.decompress(raw).count(b"WARC-Type: ") == 3 * m.captures
        with open_file(m.path) as f:
            assert [warc.parse(x)[0]["warc-type"] for x in warc.members(f)][:1] == ["request"]


def test_assembly_follows_links_and_leaves_strays_out(spark):
    kinds = f"{warc.RECORD}, payload_bytes long"

    def record(i, kind, to=None):
        return (i, kind, to, "u", 1, None, None, None, None, 0)

    records = [
        record("r1", "response"), record("q1", "request", "r1"), record("m1", "metadata", "q1"), record("m0", "metadata", "r1"),
        record("r2", "response"), record("m2", "metadata", "r2"), record("r3", "revisit"), record("m9", "metadata", "gone"), record("w", "warcinfo"),
    ]
    found = {r.record_id: r for r in warc.assemble(spark.createDataFrame(records, kinds)).collect()}
    assert set(found) == {"r1", "r2", "r3"}
    assert found["r1"].request.record_id == "q1" and found["r1"].metadata.record_id == "m0"
    assert found["r2"].request is None and found["r2"].metadata.record_id == "m2"
    assert found["r3"].request is None and found["r3"].metadata is None


def test_revisits_name_the_target_of_their_response(spark):
    rows = [(2, "http://b.example/", "same"), (1, "http://a.example/é", "same"), (4, None, "same"), (None, "http://n.example/", "same"), (9, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, new_folder(spark, "warc")).first()["path"]
    with open_file(path) as file:
        heads = [warc.parse(record)[0] for record in warc.members(file)]
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 3 and not any("warc-refers-to" in h for h in heads)
    assert {(h["warc-refers-to-target-uri"], h["warc-refers-to-date"], h["x-refers-to-page-id"]) for h in revisits} == {
        ("http://a.example/é", warc.CAPTURE_DATE, "1")
    }
