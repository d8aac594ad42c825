"""Operator 11: pages as WARC archives with an index, and reads of selected records by coalesced byte ranges.

1. Payloads that occur more than once are found by one aggregate over (digest, page_id); the pages' bodies don't take part in it. Of the
   rows with one payload of least_bytes bytes or more, that with the smallest page_id is a `response`; others are `revisit` records,
   which have the HTTP head of the page but not its payload.
2. Each task appends records to archives of its own, every record a gzip member of its own, and gives one index row for each: file, offset,
   length, page_id, url, payload_digest, payload_bytes, record_type, refers_to. A new archive begins after file_bytes bytes. Only rows of
   successful attempts enter the index, which is a table in the shared folder.
3. A read takes any selection of index rows, deals them by stretches of files, sorts them by (file, offset), joins ranges that are at most
   GAP bytes apart into reads of at most RUN bytes, and cuts the records out of these. Each record's lengths and digest are verified.

A record begins with `WARC/1.1`; WARC-Record-ID is `<urn:page:ID>`, WARC-Refers-To that of the response. A revisit's WARC-Payload-Digest and the
Content-Length of its HTTP head are those of the full payload. Blanks and control characters of a url are percent-encoded in the record, not in the index.

Cases: a null html is an empty payload; a null url leaves WARC-Target-URI out; a null page_id is written as `none`, is never what others
refer to where an id is known, and comes back null; rows that repeat the smallest page_id of a payload are all responses; very long pages are one
record, in the memory of one task; an empty table gives no archive and no row; further columns are ignored."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_rows, local_path, read_table, shared_dir, written

LEAST_BYTES = 100
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
GAP, RUN, STRETCH, TASK_BYTES = 64 << 10, 8 << 20, 8 << 20, 32 << 20
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(uri: str) -> int | None:
    found = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "none" else int(found)


def framed(fields: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return framed(fields, head if revisit else head + payload)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def unframed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; ValueError if its parts don't fit its lengths."""
    unpack = zlib.decompressobj(31)
    try:
        raw = unpack.decompress(member)
    except zlib.error as e:
        raise ValueError(f"damaged record: {e}") from e
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not unpack.eof or unpack.unused_data or not head.startswith(b"WARC/"):
        raise ValueError("the range isn't one whole record")
    fields = _fields(head)
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: its block hasn't {n} bytes")
    return fields, rest[:n]


def parsed(member: bytes) -> tuple[int | None, str | None, str, int | None, int, str, bytes | None]:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a page's record; the payload of a revisit is None."""
    fields, block = unframed(member)
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, size, digest = fields["warc-type"], int(_fields(head)["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if len(payload) != size or found != digest:
            raise ValueError(f"record {fields['warc-record-id']}: its payload has another length or digest than it says")
    refers = fields.get("warc-refers-to")
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, None if refers is None else _page(refers), size, digest, payload if kind == "response" else None


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below path and returns the index, a row for each record."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    again = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # A plain table on this side, so that a hot digest of the other is split by adaptive execution.
    typed = rows.join(written(again.select("digest", "first"), "repeats"), "digest", "left")
    typed = typed.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = local_path(path)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(folder, recursive=True)
                        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(name, compression=None)
                        first = framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(first)
                        at = len(first)
                    payload = html.encode()
                    revisit = refers_to is not None
                    member = page_record(page, url, payload, digest, refers_to, revisit, date)
                    out.write(member)
                    found.append((name, at, len(member), page, url, digest, len(payload), "revisit" if revisit else "response", refers_to))
                    at += len(member)
                if found:
                    file, offset, length, page, url, digest, size, kind, refers_to = zip(*found, strict=True)
                    long = lambda x: pa.array(x, pa.int64())
                    text = lambda x: pa.array(x, pa.string())
                    yield arrow_rows(file=text(file), offset=long(offset), length=long(length), page_id=long(page), url=text(url), payload_digest=text(digest), payload_bytes=long(size), record_type=text(kind), refers_to=long(refers_to))
        finally:
            if out is not None:
                out.close()

    return written(typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, run: int = RUN) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of ranges (offset, length), sorted by offset, that one read serves."""
    i = 0
    while i < len(ranges):
        j, end = i + 1, sum(ranges[i])
        while j < len(ranges) and ranges[j][0] - end <= gap and sum(ranges[j]) - ranges[i][0] <= run:
            end = max(end, sum(ranges[j]))
            j += 1
        yield i, j
        i = j


def read_archive(index: DataFrame, path: str, payload: bool = True, gap: int = GAP, run: int = RUN) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records that index names, which can be any selection of
    write_archive's rows. A revisit's payload is null: it is that of refers_to."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-int(total) // TASK_BYTES))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = local_path(path)
        name, source = None, None
        try:
            for batch in batches:
                files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
                a = 0
                while a < len(files):
                    b = a
                    while b < len(files) and files[b] == files[a]:
                        b += 1
                    if files[a] != name:
                        if source is not None:
                            source.close()
                        name, source = files[a], store.open_input_file(files[a])
                    ranges = list(zip(offsets[a:b], lengths[a:b], strict=True))
                    for i, j in coalesced(ranges, gap, run):
                        low = ranges[i][0]
                        block = memoryview(source.read_at(max(sum(r) for r in ranges[i:j]) - low, low))
                        rows = [parsed(bytes(block[at - low : at - low + n])) for at, n in ranges[i:j]]
                        page, url, kind, refers, size, digest, body = zip(*rows, strict=True)
                        columns = dict(page_id=pa.array(page, pa.int64()), url=pa.array(url, pa.string()), record_type=pa.array(kind), refers_to=pa.array(refers, pa.int64()), payload_bytes=pa.array(size, pa.int64()), payload_digest=pa.array(digest))
                        yield arrow_rows(**columns, **({"payload": pa.array(body, pa.binary())} if payload else {}))
                    a = b
        finally:
            if source is not None:
                source.close()

    kind = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    return dealt.mapInArrow(read, kind)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write_archive(read_table(spark, sf_dir, "pages"), path)
    return read_archive(index, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
