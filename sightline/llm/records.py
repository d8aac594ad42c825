"""Operator 9: token ids as length-delimited binary records with masked checksums and an offset index.

A data file is a run of records; a record is

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked crc32 of the 8 length bytes
    payload  doc_id as 8 bytes signed, the bytes of an id as 1 byte, then the ids as unsigned integers of so many
             bytes (2 if all ids of the document are below 2^16, else 4), all little-endian
    check    4 bytes: masked crc32 of the payload

masked(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32. The index file beside it has one 8-byte
little-endian byte offset for each record, so a reader can fetch records in any order.

Cases: null or empty texts are records of the end id alone; a null doc_id is stored as the least 64-bit integer and comes first; repeated rows and
rows of one doc_id are records of their own, in the order of their texts; a very long text is one record, in the memory of one task; an empty table
writes no file and gives an empty manifest and no record; further columns are not read."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import arrow_rows, local_path, per_chunk, read_table, settled, shared_dir, text_of
from sightline.llm.tokens import encoder, vocabulary_path

MASK_DELTA = 0xA282EAD8
END_ID = 0
READ_BYTES = 8 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    width = 4 if len(ids) and int(ids.max()) >> 16 else 2
    payload = struct.pack("<qB", doc_id, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[int, np.ndarray, int]:
    """(doc_id, ids, place after the record) of the record at a place; ValueError if a checksum differs."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(length):
        raise ValueError(f"record at byte {at}: its length is damaged")
    n = struct.unpack("<Q", length)[0]
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"record at byte {at}: its payload is damaged")
    doc_id, width = struct.unpack_from("<qB", payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4"), at + 16 + n


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text), write them in ascending doc_id order below path, return the manifest.

    Rows are dealt by ranges of doc_id and sorted within; each task writes one data file and one index file
    under names of its attempt, and only files of successful attempts enter the manifest: (part, file, index,
    records, tokens, start), start being the ids in all parts before. A null text counts as empty (the end id
    only); a null doc_id sorts first and is stored as the least 64-bit integer; equal doc_ids stay side by
    side, by text. Only doc_id and text are read of docs, so further columns don't matter."""
    vocabulary = vocabulary or vocabulary_path()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text_of().alias("text"))
    n = partitions or max(1, docs.rdd.getNumPartitions() * 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, name = encoder(vocabulary).encode, TaskContext.get().partitionId(), uuid.uuid4().hex
        store, folder = local_path(path)
        store.create_dir(folder, recursive=True)
        file, index, at, tokens, places = f"{folder}/{part:06d}-{name}.bin", f"{folder}/{part:06d}-{name}.idx", 0, 0, []
        with store.open_output_stream(file) as out:
            for batch, data, offsets in per_chunk(batches):
                ids, cut = encode(data, offsets)
                block = []
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    block.append(frame(doc, np.append(ids[cut[i] : cut[i + 1]], np.uint32(end_id))))
                    places.append(at)
                    at += len(block[-1])
                tokens += len(ids) + batch.num_rows
                out.write(b"".join(block))
        if places:
            with store.open_output_stream(index) as out:
                out.write(np.array(places, "<i8").tobytes())
            yield arrow_rows(part=[part], file=[file], index=[index], records=[len(places)], tokens=[tokens])
        else:
            store.delete_file(file)

    manifest = settled(ordered.mapInArrow(write, "part long, file string, index string, records long, tokens long"))
    # One row for each file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, ids) of every record of a manifest, read by a streaming reader that checks every checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = local_path(path)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rest = b""
                with store.open_input_stream(file) as f:
                    while True:
                        block = f.read(READ_BYTES)
                        data, at = rest + block, 0
                        found: list[tuple[int, int, np.ndarray]] = []
                        while len(data) - at >= 8 and len(data) - at >= 16 + struct.unpack_from("<Q", data, at)[0]:
                            doc, ids, at = unframe(data, at)
                            found.append((doc, start, ids))
                            start += len(ids)
                        if found:
                            sizes = np.array([len(x[2]) for x in found])
                            lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([x[2] for x in found]).astype(np.int64))
                            yield arrow_rows(doc_id=[x[0] for x in found], start=[x[1] for x in found], ids=lists.cast(pa.list_(pa.int64())))
                        rest = data[at:]
                        if not block:
                            if rest:
                                raise ValueError(f"{file}: {len(rest)} bytes after the last whole record")
                            break

    return manifest.select("file", "start").mapInArrow(read, "doc_id long, start long, ids array<long>")


def read_digests(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = local_path(path)
        for batch in batches:
            for file, index, start in zip(*(batch.column(c).to_pylist() for c in ("file", "index", "start")), strict=True):
                with store.open_input_stream(index) as f:
                    places = np.frombuffer(f.read(), "<i8")
                out = []
                with store.open_input_file(file) as f:
                    ends = np.append(places[1:], f.size())
                    i = 0
                    while i < len(places):  # runs of records of some MB
                        j = max(i + 1, int(np.searchsorted(ends, places[i] + READ_BYTES, "right")))
                        block = memoryview(f.read_at(int(ends[j - 1] - places[i]), int(places[i])))
                        for k in range(i, j):
                            doc, ids, _ = unframe(block, int(places[k] - places[i]))
                            out.append((doc, start, len(ids), zlib.crc32(ids)))
                            start += len(ids)
                        i = j
                doc, begin, n, crc = zip(*out, strict=True)
                yield arrow_rows(doc_id=doc, start=begin, n_tokens=n, ids_crc32=crc)

    files = manifest.select("file", "index", "start")
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(file: str, index: str, record: int, path: str = "file:/") -> tuple[int, np.ndarray]:
    """One record by its number, through the offset index (a shuffled read)."""
    store, _ = local_path(path)
    with store.open_input_file(index) as f:
        at = struct.unpack("<q", f.read_at(8, 8 * record))[0]
    with store.open_input_file(file) as f:
        n = struct.unpack("<Q", f.read_at(8, at))[0]
        return unframe(f.read_at(16 + n, at), 0)[:2]


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    return read_digests(write_records(read_table(spark, sf_dir, "documents"), path), path)
