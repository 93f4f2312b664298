"""Web archives: round trips, damaged files, revisits by brute force, odd rows."""

import base64
import gzip
import hashlib
import io
import random

import duckdb
import pytest

from lotwright.llm import warc
from lotwright.llm.common import scratch
from lotwright.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, record_type int, payload string"


def digest(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_a_record_follows_the_format():
    payload = "<p>ä\r\n\r\n</p>".encode()
    member = warc.page_record(7, "http://x/a b\nWARC-Type: x", payload, None)
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    assert lines[0] == "WARC/1.1" and len(fields) == len(lines) - 1
    assert fields["WARC-Type"] == "response" and fields["WARC-Record-ID"] == "<urn:x-page:7>"
    assert fields["WARC-Target-URI"] == "http://x/a%20b%0AWARC-Type:%20x"
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    assert end == b"\r\n\r\n" and block.endswith(b"\r\n\r\n" + payload)
    assert fields["WARC-Payload-Digest"] == f"sha1:{digest(payload)}" and fields["WARC-Block-Digest"] == f"sha1:{digest(block)}"


class Dripping(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(random.randint(1, 7))


def test_reader_takes_any_cuts():
    random.seed(2)
    payloads = [b"", b"\r\n\r\n", b"x", bytes(random.randrange(256) for _ in range(2000)), b"a" * 300_000]
    members = [warc.page_record(k, None, p, None) for k, p in enumerate(payloads)] + [warc.page_record(9, "u", payloads[3], 3)]
    for stream in (io.BytesIO(b"".join(members)), Dripping(b"".join(members))):
        got = list(warc.read_records(stream, payload=True))
        assert [x[3] for x in got] == [None] * 6
        assert [b"".join(x[2].parts) for x in got] == [*payloads, b""]
        assert [x[1] for x in got] == [len(m) for m in members]
        assert [x[0] for x in got] == [sum(map(len, members[:k])) for k in range(6)]
        assert got[5][2].http["content-length"] == "2000" and got[5][2].fields["warc-refers-to"] == "<urn:x-page:3>"


def test_damage_is_told():
    good = warc.page_record(1, "u", b"hello", None)

    def problems(data):
        return [x[3] for x in warc.read_records(io.BytesIO(data))]

    def packed(text):
        return gzip.compress(text)

    plain = gzip.decompress(good)
    other = packed(plain.replace(b"hello", b"hallo"))
    assert problems(good + other + good) == [None, "the block digest differs", None]
    no_block = plain.replace(b"hello", b"hallo").replace(b"WARC-Block-Digest", b"X-Block")
    assert problems(packed(no_block)) == ["the payload digest differs"]
    assert problems(packed(plain[:-1]) + good) == ["the block is not as long as Content-Length", None]
    assert problems(packed(plain + b"x")) == ["the block is not as long as Content-Length"]
    assert problems(packed(b"no header\r\n\r\n")) == ["no WARC header"]
    assert problems(packed(b"WARC/1.1\r\nA: b\r\n\r\n")) == ["no Content-Length"]
    assert problems(good + good[:-3]) == [None, "the file ends within a record"]
    assert problems(good + b"plain text")[1].startswith("not gzip")
    assert problems(b"") == []


def test_files_end_after_their_size(spark, tmp_path):
    rows = [(k, f"http://x/{k}", "".join(random.choice("abcdefgh") for _ in range(4000)), None, None) for k in range(40)]
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, file_bytes=10_000)
    found = manifest.collect()
    assert len(found) > 4 and sum(r.records for r in found) == 40 + len(found)
    # A lost attempt's file is in no manifest.
    (tmp_path / "a" / "lost.warc.gz").write_bytes(b"half a rec")
    got = warc.read_archives(spark, folder, manifest, payload=True).where("type = 'response'").collect()
    assert sorted((int(r.record_id.split(":")[-1]), r.payload.decode()) for r in got) == [(r[0], r[2]) for r in rows]
    assert not [r.problem for r in got if r.problem]


def test_odd_rows(spark):
    same, short = "<p>same</p>", "<b>"
    rows = [(5, "u", same), (3, None, same), (3, None, same), (8, "", same), (None, "u", same), (None, None, None), (4, "u", None), (6, "u", ""), (9, "u", short), (10, "u", short), (None, "u", "alone"), (None, "v", "alone")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {}
    for least in (0, 4):
        folder = scratch(spark, "odd")
        found = warc.resolve(warc.read_archives(spark, folder, warc.write_archives(pages, folder, revisit_bytes=least)))
        pick = found.select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "type", warc.page_of("refers_to").alias("r"), "problem").collect()
        got[least] = [((r.p or 0), r.payload_bytes, r.payload_digest, r.type, r.r, r.problem) for r in pick]
    s, e, b, a = (digest(x.encode()) for x in (same, "", short, "alone"))
    big = [(0, 5, a, "response", None, None)] * 2 + [(0, 11, s, "revisit", 3, None)] + [(3, 11, s, "response", None, None)] * 2 + [(5, 11, s, "revisit", 3, None), (8, 11, s, "revisit", 3, None)]
    small = [(4, 0, e, "response", None, None), (9, 3, b, "response", None, None)]
    whole = big + small + [(0, 0, e, "revisit", 4, None), (6, 0, e, "revisit", 4, None), (10, 3, b, "revisit", 9, None)]
    alone = big + small + [(0, 0, e, "response", None, None), (6, 0, e, "response", None, None), (10, 3, b, "response", None, None)]
    assert sorted(got[0], key=str) == sorted(whole, key=str)
    assert sorted(got[4], key=str) == sorted(alone, key=str)


def test_empty_table(spark):
    folder = scratch(spark, "none")
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert manifest.collect() == [] and warc.resolve(warc.read_archives(spark, folder, manifest)).collect() == []


def test_a_revisit_without_its_response_is_told(spark):
    rows = [("f", 0, 1, "revisit", "urn:x-page:2", None, "urn:x-page:1", "5", "D", 0, None), ("f", 1, 1, "response", "urn:x-page:1", None, None, "5", "E", 5, None)]
    got = {r.record_id: r.problem for r in warc.resolve(spark.createDataFrame(rows, warc._RECORD)).collect()}
    assert got == {"urn:x-page:1": None, "urn:x-page:2": "no response of that digest"}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """The given pages with copies of some, as a table folder."""
    folder = tmp_path_factory.mktemp("pages")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = pages.where("page_id % 3 = 0").selectExpr("page_id + 1000 AS page_id", "url", "html")
    pages.union(more).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_query(spark, copies):
    want = duckdb.sql(f"WITH pages AS (SELECT * FROM '{copies}/pages.parquet/*.parquet') {oracle_sql()['op12_warc'].replace('WITH d', ', d', 1)}").fetchall()
    got = [tuple(r) for r in queries()["op12_warc"](spark, copies).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got) == sorted(want) and sum(r[3] == "revisit" for r in got) >= 17
