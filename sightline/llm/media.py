"""Operator 5: media columns checked by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in a binary in one scan; at each hit the format's
validator walks its structure (chunks, segments, pages, frames, checksums) and says how long it is, or rejects it. The format that
validates at byte 0 is the column's real type, whatever was declared; others found inside are carved as (type, offset, length).

`store_text_media` keeps texts as 8-bit samples: the UTF-8 bytes padded with zeros to a multiple of 64, as mono WAV, gray BMP or gray PNG
of 64 pixels a line, by a checksum of the bytes. They are declared by another checksum, mostly wrongly, as files in a crawl are; only the sniffed
type says how they are read back. What texts embed is carved out of the payload that is read back, so it is found whatever holds it.

Cases: a null media value has type null and nothing carved; an empty one is `unknown`; truncated or damaged files are not
of the type that their magic says; declared types are compared in lower case; a null text counts as empty, and equal texts are stored
alike; of very long texts the whole is stored, in the memory of one task; an empty table gives an empty one; further columns are kept by
sniff_media, but for the added ones (media_type, mismatch, carved), which are replaced."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import read_table, schema_with, text_of, written

PAD = 64
RATE = 8000
#: Magic bytes, and how far before them a file begins.
MAGIC: dict[bytes, tuple[str, int]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("riff", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("audio/ogg", 0),
    b"ftyp": ("video/mp4", 4),
}
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def _png(b: bytes, at: int) -> int | None:
    """Chunks with their checksums; what the image data inflate to must be the lines that the head says (of interlaced images, at least one byte each)."""
    i, packed, lines, exact = at + 8, [], 0, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0] or (i == at + 8) != (kind == b"IHDR"):
            return None
        if kind == b"IHDR":
            if n != 13:
                return None
            width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", b, i + 8)
            channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
            if not width or not height or not channels or depth not in (1, 2, 4, 8, 16):
                return None
            exact, lines = not interlaced, height * (1 + (width * channels * depth + 7) // 8)
        elif kind == b"IDAT":
            packed.append(b[i + 8 : i + 8 + n])
        i += 12 + n
        if kind == b"IEND":
            return i - at if _inflates(packed, lines, exact) else None
    return None


def _inflates(packed: list[bytes], size: int, exact: bool) -> bool:
    """Whether a zlib stream in pieces holds size bytes, or with exact off any; no more than 1 MB of it is held."""
    stream, total = zlib.decompressobj(), 0
    try:
        for piece in packed:
            while piece and total <= size:
                total += len(stream.decompress(piece, 1 << 20))
                piece = stream.unconsumed_tail
        while total <= size and (rest := stream.decompress(stream.unconsumed_tail, 1 << 20)):
            total += len(rest)
    except zlib.error:
        return False
    return stream.eof and (total == size if exact else total > 0)


def _blocks(b: bytes, i: int) -> int | None:
    """The place after a run of GIF sub-blocks."""
    while i < len(b):
        if not b[i]:
            return i + 1
        i += 1 + b[i]
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    i: int | None = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while i is not None and i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = _blocks(b, i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = _blocks(b, i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i = at + 2
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 - at
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return None
        i += 2 + n
        if kind == 0xDA:  # entropy-coded data: up to a marker that is neither stuffing nor a restart
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                elif b[i + 1] == 0xFF:
                    i += 1
                else:
                    break
    return i + 2 - at if b[i : i + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 34 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    if reserved or header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= start <= size <= len(b) - at:
        return None
    width, height, bits, packed = (*struct.unpack_from("<HH", b, at + 18), struct.unpack_from("<H", b, at + 24)[0], 0) if header == 12 else (*struct.unpack_from("<ii", b, at + 18), *struct.unpack_from("<HI", b, at + 28))
    if width <= 0 or not height or bits not in (0, 1, 2, 4, 8, 16, 24, 32):
        return None
    # Lines that aren't compressed are as long as width and depth say.
    return size if packed not in (0, 3) or start + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_FORMS:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i = at + 12
    while i + 8 <= end <= len(b):
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + n % 2
    return end - at if i == end <= len(b) and end > at + 12 else None


def _zip(b: bytes, at: int) -> int | None:
    end = b.find(b"PK\x05\x06", at)
    while 0 <= end <= len(b) - 22:
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + size == end and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            return end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 1)
    return None


def _gzip(b: bytes, at: int) -> int | None:
    reader = zlib.decompressobj(31)
    try:
        i = at
        while i < len(b) and not reader.eof:
            reader.decompress(b[i : i + 65536])
            i += 65536
    except zlib.error:
        return None
    return min(i, len(b)) - len(reader.unused_data) - at if reader.eof else None


def _crc_table(bits: int, poly: int) -> list[int]:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_header(b: bytes, i: int) -> int | None:
    """The length of the frame header at i, if its checksum holds."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] >> 1 != 0x7C or b[i + 3] & 1:
        return None
    lead = b[i + 4]
    n = 4 + (1 if lead < 0x80 else next((k for k in range(2, 8) if lead << k & 0x80 == 0), 8))  # a number in the manner of UTF-8
    n += {6: 1, 7: 2}.get(b[i + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[i + 2] & 15, 0)
    c = 0
    for x in b[i : i + n]:
        c = _CRC8[c ^ x]
    return n + 1 if i + n < len(b) and c == b[i + n] else None


def _flac(b: bytes, at: int) -> int | None:
    """Frames follow the metadata: each ends with a checksum, before the next frame's header or what is no part of the file."""
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, n = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind & 0x7F or n != 34):
            return None
        i, first = i + 4 + n, False
        if kind & 0x80:
            break
    else:
        return None
    end = None
    while (n := _flac_header(b, i)) is not None:
        c, j, last = 0, i, None
        while j < len(b):
            c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b[j]]
            j += 1
            if c == 0 and j - i > n + 2:  # the checksum over a whole frame and its own two bytes is 0
                last = last or j
                if j == len(b) or _flac_header(b, j) is not None:
                    last = j
                    break
        if last is None:
            break
        end = i = last
    return end - at if end else None


def _ogg(b: bytes, at: int) -> int | None:
    if at + 27 > len(b) or b[at + 4] or not b[at + 5] & 2:
        return None
    i = at
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b):
        n = b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        if i + size > len(b):
            return None
        last, i = b[i + 5] & 4, i + size
        if last:
            return i - at
    return None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to the last end mark before another header whose startxref names a cross-reference table or stream of this file."""
    stop = b.find(b"%PDF-", at + 5)
    limit, end, found = stop if stop > 0 else len(b), b.find(b"%%EOF", at), None
    while 0 < end < limit and b[at + 5 : at + 6].isdigit():
        start = b.rfind(b"startxref", at, end)
        number = b[start + 9 : end].strip()
        if start > 0 and number.isdigit():
            table = at + int(number)
            if table < start and (b[table : table + 4] == b"xref" or b" obj" in b[table : table + 24]):
                found = end + 5 - at
        end = b.find(b"%%EOF", end + 5)
    return found


def _mp4(b: bytes, at: int) -> int | None:
    i, kinds = at, set()
    while i + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if n < 8 or i + n > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        i += n
    return i - at if {b"ftyp", b"moov"} <= kinds else None


VALIDATORS: dict[str, Callable[[bytes, int], int | None]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4,
}


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, (kind, before) in MAGIC.items():
            self.automaton.add_word(magic.decode("latin-1"), (kind, before + len(magic) - 1))
        self.automaton.make_automaton()

    def scan(self, data: bytes) -> list[tuple[str, int, int]]:
        """(type, offset, length) of every file found that no earlier one holds, the one at 0 with what it holds."""
        out: list[tuple[str, int, int]] = []
        free = 0
        for end, (kind, back) in self.automaton.iter(data.decode("latin-1")):
            at = end - back
            if at < free:
                continue
            n = VALIDATORS[kind](data, at)
            if n:
                out.append((RIFF_FORMS[data[at + 8 : at + 12]] if kind == "riff" else kind, at, n))
                free = at + 1 if at == 0 else at + n
        return out


def wav_of(payload: bytes) -> bytes:
    """8-bit mono PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def wav_samples(data: bytes) -> bytes:
    i = 12
    while i + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, i)
        if kind == b"data":
            return data[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("no samples")


WIDTH = 64
GRAYS = b"".join(bytes([i, i, i, 0]) for i in range(256))


def bmp_of(payload: bytes) -> bytes:
    """8-bit gray, lines from the top."""
    start, lines = 54 + len(GRAYS), len(payload) // WIDTH
    head = struct.pack("<2sIII", b"BM", start + len(payload), 0, start) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -lines, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return head + GRAYS + payload


def bmp_samples(data: bytes) -> bytes:
    size, _, start = struct.unpack_from("<III", data, 2)
    return data[start:size]


def png_of(payload: bytes) -> bytes:
    """8-bit gray, no line filtered."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"\0" + b"\0".join(payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(payload) // WIDTH, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def png_samples(data: bytes) -> bytes:
    i, packed, width = 8, [], 0
    while i + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, i)
        if kind == b"IHDR":
            width = struct.unpack_from(">I", data, i + 8)[0]
        elif kind == b"IDAT":
            packed.append(data[i + 8 : i + 8 + n])
        i += 12 + n
    lines = zlib.decompress(b"".join(packed))
    if any(lines[:: width + 1]):
        raise ValueError("filtered lines")
    return b"".join(lines[j + 1 : j + 1 + width] for j in range(0, len(lines), width + 1))


#: Types that stored texts are declared as.
DECLARED = "image/png", "audio/wav", "image/bmp", "application/octet-stream"
STORES: list[Callable[[bytes], bytes]] = [wav_of, bmp_of, png_of]
READERS: dict[str, Callable[[bytes], bytes]] = {"audio/wav": wav_samples, "image/bmp": bmp_samples, "image/png": png_samples}


def stored(text: bytes) -> bytes:
    """A text as media."""
    payload = text + bytes(PAD - len(text) % PAD if len(text) % PAD or not text else 0)
    return STORES[zlib.crc32(payload) % len(STORES)](payload)


def store_text_media(docs: DataFrame, declared: tuple[str, ...] = DECLARED) -> DataFrame:
    """(doc_id, n_bytes, declared_type, media) of docs (doc_id, text); the declared type is one of `declared`, by a checksum of the stored bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                media = [stored(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([declared[zlib.adler32(m) % len(declared)] for m in media], pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared_type", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, declared_type string, media binary")


CARVED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def sniff_media(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """df with media_type (the real one), mismatch (declared another), carved (what is embedded)."""
    added = {"media_type": "string", "mismatch": "boolean", "carved": "array<struct<type: string, offset: long, length: long>>"}
    df = df.drop(*added)

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                kinds, wrong, carved = [], [], []
                for data, said in zip(batch.column(media).to_pylist(), batch.column(declared).to_pylist(), strict=True):
                    found = sniffer.scan(data) if data else []
                    top = found[0][0] if found and found[0][1] == 0 else "unknown"
                    kinds.append(None if data is None else top)
                    wrong.append(None if data is None or said is None else said.lower() != top)
                    carved.append([{"type": k, "offset": i, "length": n} for k, i, n in found if i])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(carved, CARVED)], names=[*batch.schema.names, *added])

    return df.mapInArrow(sniff, schema_with(df, added))


def media_digests(df: DataFrame) -> DataFrame:
    """Digests of stored text media (doc_id, n_bytes, media, media_type, mismatch), from the bytes read back; what the payload embeds is named with its place in it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            rows: list[tuple] = []
            for doc, n, data, kind, wrong in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "media_type", "mismatch")), strict=True):
                if kind not in READERS:
                    raise ValueError(f"no reader for {kind}")
                payload = READERS[kind](data)
                feature = f"{kind};8bit;samples={len(payload)};mean={sum(payload) / len(payload):.3f};corrected={str(bool(wrong)).lower()};carved=" + ",".join(f"{k}@{i}+{size}" for k, i, size in sniffer.scan(payload))
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), DIGEST.types, strict=True)] if rows else [pa.array([], k) for k in DIGEST.types], schema=DIGEST)

    return df.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = written(store_text_media(read_table(spark, sf_dir, "documents")), "media", compression="zstd")
    return media_digests(sniff_media(kept))
