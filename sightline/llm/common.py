"""What the text operators share: reading tables, checkpoints, and word hashing over Arrow buffers.

Words are `[^\\x20\\x09-\\x0D]+` over UTF-8 bytes. Hashes are 64-bit polynomial hashes of the bytes
through a fixed random table, so a whole batch of texts is hashed by a few array operations.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as long as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.zeros(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, CHUNK_BYTES + 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(m - 1, b, U64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


BYTE_POWERS, GRAM_POWERS, GRAM_POWERS_2 = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93), _Powers(0xC2B2AE3D27D4EB4F)
BYTE_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir. Only a local session may do without one: it gets
    a temporary folder; on a cluster that would be another disk for each executor, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sightline-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read again (compressed, unlike a checkpoint)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sightline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that `written` gave, when nothing that is still to run reads it. Other tables stay until the owner of the
    shared folder clears it, as lost executors may need them for as long as a result is not stored."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_remainder(modulus: int, column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and n+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents of about target bytes each; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a run of documents: byte places start and end, hash, doc (index of the document), first (n+1 word offsets)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        n_docs, n = len(offsets) - 1, len(data)
        if lower:
            data = LOWER[data]
        self.data = data
        inside = ~SPACE[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < n]
        begin[edge] = inside[edge]
        edge = offsets[1:][offsets[1:] > 0] - 1
        end[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n_docs), np.diff(self.first))
        if hashes:
            up, down = BYTE_POWERS.get(n + 1)
            total = np.zeros(n + 1, U64)
            np.cumsum(BYTE_TABLE[data] * up[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def gram_hash(h: np.ndarray, k: int, powers: _Powers = GRAM_POWERS) -> np.ndarray:
    """Hash of h[i:i+k] for each i."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """For each i: whether words i to i+k-1 are of one document."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def sliding(h: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """f over h[i:i+w] for each i."""
    if len(h) < w:
        return h[:0]
    size = 1
    while size * 2 <= w:
        h = f(h[: len(h) - size], h[size:])
        size *= 2
    return f(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def per_chunk(batches: Iterator[pa.RecordBatch], column: str = "text", target: int = CHUNK_BYTES):
    """(batch slice, bytes, offsets) for runs of rows of about target bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = flat(batch.column(column))
        for i, j in pieces(at, target):
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]


def arrow_rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def schema_with(df: DataFrame, added: dict[str, str]) -> T.StructType:
    """The schema of df and further columns."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in added.items())).fields])


class Steps:
    """A column that is packed as its differences, in as few bytes as they need; good where neighbours are close."""

    def __init__(self, values: np.ndarray):
        self.values = values


def _narrow(x: np.ndarray) -> np.ndarray:
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def pack_arrays(*arrays: np.ndarray | Steps) -> bytes:
    """Arrays as one run of bytes."""
    head, parts = [len(arrays)], []
    for a in arrays:
        step, first = isinstance(a, Steps), 0
        if step:
            values = a.values.astype(np.int64)
            first = int(values[0]) if len(values) else 0
            a = _narrow(np.diff(values, prepend=first))
        head += [ord(a.dtype.char), len(a), int(step), first]
        parts.append(np.ascontiguousarray(a).tobytes())
    return b"".join([np.array(head, "<i8").tobytes(), *parts])


def unpack_arrays(body: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(body, "<i8", 1)[0])
    head = np.frombuffer(body, "<i8", 4 * n, 8)
    out, at = [], 8 + 32 * n
    for code, size, step, first in head.reshape(-1, 4).tolist():
        own = np.frombuffer(body, chr(code), size, at)
        at += own.nbytes
        out.append(np.cumsum(own, dtype=np.int64) + first if step else own)
    return out


def merged(bodies: list[bytes]) -> list[np.ndarray]:
    """The arrays of several bodies, each put together."""
    return [np.concatenate(x) for x in zip(*map(unpack_arrays, bodies), strict=True)]


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(key + U64(7)) % U64(blocks)).astype(np.int64)


def packed_runs(*streams: tuple[np.ndarray, list[np.ndarray | Steps]]) -> pa.RecordBatch:
    """Rows (block, body), one for each bucket that has entries. A stream is (bucket of each entry, columns); entries keep their order.

    The work is that of sorting the entries and of the buckets that occur; it doesn't grow with the number of blocks."""
    placed = []
    for bucket, columns in streams:
        low = int(bucket.min()) if len(bucket) else 0
        near = bucket - low
        order = np.argsort(near.astype(np.uint16) if not len(near) or near.max() < 1 << 16 else near, kind="stable")
        placed.append((bucket[order], [Steps(c.values[order]) if isinstance(c, Steps) else c[order] for c in columns]))
    names = np.unique(np.concatenate([b for b, _ in placed]))
    cuts = [np.searchsorted(b, np.append(names, names[-1:] + 1)).tolist() for b, _ in placed]
    bodies = []
    for k in range(len(names)):
        own = []
        for (_, columns), cut in zip(placed, cuts, strict=True):
            own += [Steps(c.values[cut[k] : cut[k + 1]]) if isinstance(c, Steps) else c[cut[k] : cut[k + 1]] for c in columns]
        bodies.append(pack_arrays(*own))
    return arrow_rows(block=names.astype(np.int64), body=pa.array(bodies, pa.binary()))


FAN = 4096


def deal_widths(blocks: int, fan: int = FAN) -> list[int]:
    """How many blocks a bucket of each dealing holds: a run of rows meets about `fan` buckets at each, however many blocks there are."""
    widths = [1]
    while -(-blocks // widths[0]) > fan:
        widths.insert(0, widths[0] * fan)
    return widths


def dealt_on(rows: DataFrame, widths: list[int], streams: Callable[[list[bytes], int], list], flush_bytes: int) -> DataFrame:
    """Rows (block, body) by buckets of widths[0] blocks, dealt on to single blocks. streams(bodies, width) gives what packed_runs takes."""
    for width in widths[1:]:

        def deal(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            held, size, last = [], 0, None
            for batch in batches:
                for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    if held and (block != last or size >= flush_bytes):
                        yield packed_runs(*streams(held, width))
                        held, size = [], 0
                    held.append(body)
                    size, last = size + len(body), block
            if held:
                yield packed_runs(*streams(held, width))

        rows = rows.repartition("block").sortWithinPartitions("block").mapInArrow(deal, "block long, body binary")
    return rows


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, counted by a scan of it (plan statistics are unknown or wrong behind most operators)."""
    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0)


def local_path(uri: str) -> tuple["object", str]:
    """(file system, path) of a URI, for reads and writes from tasks: local, HDFS or an object store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
