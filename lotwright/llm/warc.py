"""Web archives (WARC 1.1): one gzip member for each record, written and read in sequence.

A writer task appends records to files of bounded size and names them in a
manifest; files of lost attempts are in no manifest. A reader decompresses member
after member in small steps, frames header, block and end by Content-Length, and
checks block and payload digests on the way; it holds one step of one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, remove, scratch, table

#: Compressed bytes after which a task goes on with a new file.
FILE_BYTES = 64 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
_STEP, _HEADER_BYTES = 1 << 16, 1 << 20
#: The names of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP, _FIELDS = "application/http;msgtype=response", "application/warc-fields"
#: Record ids of pages.
_ID = "urn:x-page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def _sha1(*parts: bytes) -> str:
    h = hashlib.sha1(usedforsecurity=False)
    for p in parts:
        h.update(p)
    return base32(h.digest())


def record_bytes(fields: list[tuple[str, str | None]], *block: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{_sha1(*block)}"), ("Content-Length", str(sum(map(len, block))))]
    head = "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(x) for x in (head.encode(), *block, b"\r\n\r\n")] + [packer.flush()])


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = DATE) -> bytes:
    """The response of a page, or with ``first`` its revisit of that page's response, which has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        # Blanks and control characters would end the field or the header.
        ("WARC-Target-URI", None if url is None else re.sub(r"[^\x21-\x7e]", lambda c: quote(c[0]), url)),
        ("WARC-Profile", None if first is None else _PROFILE),
        ("WARC-Refers-To", None if first is None else f"<{_ID}{first}>"),
        ("WARC-Payload-Digest", f"sha1:{_sha1(payload)}"),
        ("Content-Type", _HTTP),
    ]
    return record_bytes(fields, *((http, payload) if first is None else (http,)))


class ArchiveWriter:
    """Appends records to files in ``folder``; a file ends after ``file_bytes`` or the record that reaches them."""

    def __init__(self, folder: str, file_bytes: int = FILE_BYTES):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.file_bytes, self.sink, self.done = file_bytes, None, []

    def add(self, record: bytes) -> None:
        if self.sink is None:
            # The name tells the attempt: only files that a finished task returns are in the manifest.
            self.name, self.records, self.size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.sink = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            info = b"software: lotwright\r\nformat: WARC File Format 1.1\r\n"
            self._put(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", _FIELDS)], info))
        self._put(record)
        if self.size >= self.file_bytes:
            self.close()

    def _put(self, record: bytes) -> None:
        self.sink.write(record)
        self.records, self.size = self.records + 1, self.size + len(record)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.name, self.records, self.size))
            self.sink = None


class _Framer:
    """Takes the bytes of one member and frames one record."""

    def __init__(self, payload: bool):
        self.fields: dict[str, str] = {}
        self.http: dict[str, str] | None = None
        self.held, self.state, self.left = b"", "head", 0
        self.block, self.body = (hashlib.sha1(usedforsecurity=False) for _ in range(2))
        self.payload_bytes, self.parts = 0, [] if payload else None

    @staticmethod
    def _lines(head: bytes) -> dict[str, str]:
        # A line that begins with a blank goes on with the one before.
        lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in lines) if found}

    def _cut(self, data: bytes) -> tuple[bytes | None, bytes]:
        """What stands before the next empty line, once it is there, and what follows."""
        self.held += data
        at = self.held.find(b"\r\n\r\n")
        if at < 0:
            if len(self.held) > _HEADER_BYTES:
                raise ValueError("a header without end")
            return None, b""
        head, rest = self.held[:at], self.held[at + 4 :]
        self.held = b""
        return head, rest

    def feed(self, data: bytes) -> None:
        if self.state == "head":
            head, data = self._cut(data)
            if head is None:
                return
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC header")
            self.fields = self._lines(head)
            if not re.fullmatch(r"[0-9]+", self.fields.get("content-length", "")):
                raise ValueError("no Content-Length")
            self.left = int(self.fields["content-length"])
            self.state = "http" if self.fields.get("content-type", "").startswith("application/http") else "body"
        if self.state in ("http", "body"):
            part, data = data[: self.left], data[self.left :]
            self.left -= len(part)
            self.block.update(part)
            if self.state == "http":
                head, part = self._cut(part)
                if head is not None:
                    self.http, self.state = self._lines(head), "body"
                elif not self.left:
                    raise ValueError("an HTTP header without end")
            if self.state == "body" and part:
                self.payload_bytes += len(part)
                self.body.update(part)
                if self.parts is not None:
                    self.parts.append(part)
            if not self.left and self.state == "body":
                self.state = "end"
        if self.state == "end" and data:
            self.held += data
            if not b"\r\n\r\n".startswith(self.held[:5]):
                raise ValueError("the block is not as long as Content-Length")

    def problem(self) -> str | None:
        """What is wrong with the record when its member has ended."""
        if self.state != "end" or self.held != b"\r\n\r\n":
            return "the block is not as long as Content-Length"
        revisit = self.fields.get("warc-type") == "revisit"
        for name, h in (("block", self.block), *([] if revisit else [("payload", self.body)])):
            kind, _, given = self.fields.get(f"warc-{name}-digest", "").partition(":")
            if given and kind.lower() == "sha1" and given.upper() != base32(h.digest()):
                return f"the {name} digest differs"
        return None


def read_records(stream, payload: bool = False):
    """(offset, compressed bytes, framer, problem) of each record of an open file, in order.

    A member that cannot be decompressed ends the file: what follows it has no
    known start. Other faults are told for their record, and reading goes on.
    """
    data, read, more = b"", 0, True
    while True:
        if not data and more:
            data = stream.read(_STEP)
            read, more = read + len(data), bool(data)
        if not data:
            return
        start, member, framer, problem = read - len(data), zlib.decompressobj(31), _Framer(payload), None
        while not member.eof:
            try:
                out = member.decompress(data, _STEP)
            except zlib.error as e:
                yield start, read - len(data) - start, framer, f"not gzip: {e}"
                return
            data = member.unused_data if member.eof else member.unconsumed_tail
            if problem is None:
                try:
                    framer.feed(out)
                except ValueError as e:
                    problem = str(e)
            if not data and not member.eof and len(out) < _STEP:
                data = stream.read(_STEP) if more else b""
                read, more = read + len(data), bool(data)
                if not data:
                    yield start, read - start, framer, "the file ends within a record"
                    return
        yield start, read - len(data) - start, framer, problem or framer.problem()


def mark_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, first): ``first`` is the page whose response a page revisits, null for responses.

    Of pages with equal payloads the smallest page_id is the response. Rows that
    repeat it and the payload are responses too; rows without an id revisit it,
    and are responses where no equal page has an id. Null html is an empty
    payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = keyed.withColumn("key", F.sha2("payload", 256))
    some = keyed.where(F.length("payload") >= revisit_bytes)
    firsts = cut(some.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "firsts")
    # A payload may stand on a third of all pages: adaptive execution splits it, as the other side has one row a payload.
    joined = keyed.join(firsts, "key", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str, *, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) to ``folder``; the manifest (file, records, bytes).

    See mark_revisits for which rows become revisits. A null url gives no target
    field; blanks and characters outside ASCII in it are percent-encoded. An
    empty table gives no file. Other columns are ignored, whatever their names.
    """

    def run(batches):
        out = ArchiveWriter(folder, file_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, first = (batch.column(c)[k].as_py() for c in range(4))
                out.add(page_record(page_id, url, payload, first, date))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out.done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    return cut(mark_revisits(pages, revisit_bytes).mapInArrow(run, "file string, records bigint, bytes bigint"), "manifest")


_RECORD = "file string, offset bigint, size bigint, type string, record_id string, uri string, refers_to string, http_length string, payload_digest string, payload_bytes bigint, problem string"


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the files that ``manifest`` names, with what is wrong with it in ``problem`` (null: nothing).

    ``payload_digest`` is that of the bytes read, of a revisit the one it states;
    ``payload_bytes`` is of the bytes read. With ``payload`` they are a column.
    """
    names = _RECORD.split(", ")
    kinds = [{"string": pa.string(), "bigint": pa.int64()}[n.split()[1]] for n in names] + [pa.binary()] * payload
    names = [n.split()[0] for n in names] + ["payload"] * payload

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}") as stream:
                    for at, size, x, problem in read_records(stream, payload):
                        f, http = x.fields, x.http or {}
                        stated = f.get("warc-payload-digest", "").partition(":")[2] or None
                        own = stated if f.get("warc-type") == "revisit" else base32(x.body.digest())
                        ids = [f.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")]
                        rows.append((name, at, size, f.get("warc-type"), ids[0], f.get("warc-target-uri"), ids[1], http.get("content-length"), own, x.payload_bytes, problem, *([b"".join(x.parts)] if payload else [])))
                        held += x.payload_bytes * payload + 1000
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(files, max(4 * spark.sparkContext.defaultParallelism, size >> 30))
    return manifest.select("file").repartition(max(1, tasks)).mapInArrow(run, _RECORD + ", payload binary" * payload)


def resolve(records: DataFrame) -> DataFrame:
    """Responses and revisits, revisits with the payload_bytes of the response they refer to; ``problem`` tells where there is none of that digest."""
    own = records.where("type = 'response'")
    # Distinct by three columns, joined by two: the join gets exchanges of its own, whose hot parts can be split.
    there = own.select(F.col("record_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")).distinct()
    met = records.where("type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left")
    lost = F.when(F.col("full").isNull(), F.lit("no response of that digest"))
    met = met.withColumn("payload_bytes", F.col("full")).withColumn("problem", F.coalesce("problem", lost)).drop("full")
    return own.unionByName(met)


def page_of(record_id):
    """The page of a record id as a Column; null for pages without an id."""
    return F.nullif(F.substring(record_id, len(_ID) + 1, 32), F.lit("")).cast("bigint")


def op12(spark, sf_dir):
    folder = scratch(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    records = cut(read_archives(spark, folder, manifest), "records")
    remove(spark, folder)
    discard(manifest)
    wrong = records.where("problem is not null").select("file", "offset", "problem").first()
    if wrong:
        raise ValueError(f"a record does not read back: {wrong}")
    found = resolve(records)
    # A revisit without its response would have no payload_bytes: it raises when it is read.
    whole = F.when(F.col("problem").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.col("problem")).cast("bigint"))
    return found.select(page_of("record_id").alias("page_id"), whole.alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))


OP12_SQL = """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16
      + greatest(instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INT), 1)) - 1, 0)) >> CAST(3 - 5 * i % 4 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s
"""
