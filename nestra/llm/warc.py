"""WARC archives: captures are written as request, response and metadata records and assembled again.

Writing: equal payloads of at least `min_bytes` are kept once, in the response
of the largest page_id; the others are revisits that refer to it. Which
payloads repeat is found by digest, without moving a payload. Each task writes
gzipped archives of bounded size (a member for each record) to a folder that
executors share; a file gets its name when it is whole, and a task that is run
again writes the same files.

Reading: the records of all archives, then transactions: request and metadata
join their response (or revisit) by WARC-Concurrent-To, and each capture is one
nested row.

Cases: null html is an empty payload; a null url or page_id has no header and
comes back null. Rows that repeat a page_id are captures of their own, and if
their payloads repeat too, all with the largest page_id are responses; their
revisits then name its page and url, but no record. Control characters in urls
are percent-encoded. Payloads may have any size; what a task holds is one archive,
or one record where that is larger. An empty table writes no archive and reads as
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestra.llm.common import filesystem, put_in_place, saved

MIN_REVISIT_BYTES = 1000
#: Records and payload bytes that reading passes on at once, or one record where that is larger.
READ_RECORDS, READ_BYTES = 1000, 4 << 20
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 4 << 20
#: Repeated payloads up to which their table of digests is broadcast (under 100 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "kind string, record_id string, concurrent_to string, page_id long, url string, date string, payload_digest string, refers_to long, payload_bytes long, status int, fields string, payload binary"


def repeated_payloads(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(digest, response_id, response_url, single) of payloads that more than one of (page_id, url, html) has; single: one row alone has that page_id."""
    sized = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "url", F.sha1("html").alias("digest"))
    each = sized.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max("url").alias("url"))
    found = each.groupBy("digest").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "n", "url")).alias("x"), F.sum("n").alias("n")).where("n > 1")
    return found.select("digest", F.col("x.page_id").alias("response_id"), F.col("x.url").alias("response_url"), (F.col("x.n") == 1).alias("single"))


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def response_name(page_id: int, digest: str) -> str:
    """Id of the record that revisits refer to."""
    return f"<urn:page:{page_id}:{digest}:response>"


def capture(key: str, page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None = None, response_url: str | None = None, single: bool = False) -> bytes:
    """The three records of a capture. response_id: the page whose equal payload is kept, and its url; single: one record has it."""
    target = [] if url is None else [("WARC-Target-URI", _escaped(url))]
    page = [] if page_id is None else [("WARC-Page-ID", str(page_id))]
    revisits = response_id is not None and response_id != page_id
    main = response_name(page_id, digest) if single and response_id == page_id and page_id is not None else f"<urn:capture:{key}:response>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    payload_digest = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if not revisits:
        answer = _record("response", main, target + page + payload_digest, "application/http;msgtype=response", head + payload)
    else:
        refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Date", DATE), ("WARC-Refers-To-Page-ID", str(response_id))]
        refers += [("WARC-Refers-To", response_name(response_id, digest))] * bool(single)
        refers += [] if response_url is None else [("WARC-Refers-To-Target-URI", _escaped(response_url))]
        answer = _record("revisit", main, target + page + payload_digest + refers, "application/http;msgtype=response", head)
    link = [*target, ("WARC-Concurrent-To", main)]
    path = "/" + (url or "").partition("://")[2].partition("/")[2]
    request = _record("request", f"<urn:capture:{key}:request>", link, "application/http;msgtype=request", f"GET {_CONTROL.sub('', path)} HTTP/1.1\r\n\r\n".encode())
    metadata = _record("metadata", f"<urn:capture:{key}:metadata>", link, "application/warc-fields", f"payload-bytes: {len(payload)}\r\n".encode())
    return request + answer + metadata


def _escaped(url: str) -> str:
    return _CONTROL.sub(lambda m: quote(m[0], safe=""), url)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> int:
    """Writes (page_id, url, html) as archives in a folder; returns the number of captures."""
    pages = pages.select("page_id", "url", "html")
    repeated = saved(repeated_payloads(pages, min_bytes), "payloads")
    digested = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    columns = ["page_id", "url", "html", "digest", "response_id", "response_url", "single"]
    if repeated.count() <= broadcast_rows:
        judged = digested.join(F.broadcast(repeated), "digest", "left").select(columns)
    else:  # only payloads that may repeat are dealt
        large = F.coalesce(F.octet_length("html") >= min_bytes, F.lit(False))
        nothing = [F.lit(None).cast(t).alias(c) for c, t in repeated.dtypes[1:]]
        judged = digested.where(large).join(repeated, "digest", "left").select(columns).unionByName(digested.where(~large).select("*", *nothing))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, number, n, held, size = task.partitionId(), 0, 0, [], 0

        def close() -> None:
            nonlocal number, held, size
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            draft = f"{root}/_{name}-{task.taskAttemptId()}"
            with fs.open_output_stream(draft, compression=None) as out:
                out.write(b"".join(held))
            put_in_place(fs, draft, f"{root}/{name}")
            number, held, size = number + 1, [], 0

        for batch in batches:
            for page_id, url, html, *rest in zip(*(batch.column(i) for i in range(7)), strict=True):
                record = capture(f"{part}-{n}", page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), *(x.as_py() for x in rest))
                held.append(record)
                n, size = n + 1, size + len(record)
                if size >= archive_bytes:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return judged.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one after another."""
    view, at, step = memoryview(content), 0, 1 << 14
    while at < len(view):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("an archive ends within a record")
            out.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(out)


def parse(record: bytes, with_payload: bool) -> tuple:
    """One record as a row of RECORDS; the digest of a response is that of its payload, which must be the header's."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    kind = headers["WARC-Type"]
    payload = payload_bytes = status = fields = digest = refers_to = None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        first, *named = http.decode().split("\r\n")
        status = int(first.split(" ")[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        payload_bytes = int(dict(x.split(": ", 1) for x in named)["Content-Length"])
        if kind == "revisit":
            payload, refers_to = None, int(headers["WARC-Refers-To-Page-ID"])
        elif len(payload) != payload_bytes or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload is damaged")
    else:
        fields = block.decode().strip()
    page_id = headers.get("WARC-Page-ID")
    return (kind, headers["WARC-Record-ID"], headers.get("WARC-Concurrent-To"), page_id and int(page_id), headers.get("WARC-Target-URI"), headers["WARC-Date"], digest, refers_to, payload_bytes, status, fields, payload if with_payload else None)


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in a folder (see RECORDS)."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for member in members(content.as_py()):
                    rows.append(parse(member, with_payload))
                    size += len(member) if with_payload else 0
                    if len(rows) >= READ_RECORDS or size >= READ_BYTES:
                        yield ready(rows)
                        rows, size = [], 0
                if rows:
                    yield ready(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(read, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (page_id, url, date, request, response, metadata)."""
    side = lambda kind: records.where(F.col("kind") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "fields").alias(kind))
    response = F.struct(F.col("record_id").alias("id"), "kind", "status", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response")
    captures = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "page_id", "url", "date", response)
    return captures.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left").select("page_id", "url", "date", "request", "response", "metadata")


def read_captures(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    return transactions(saved(read_records(spark, folder, with_payload), "warc-records"))
