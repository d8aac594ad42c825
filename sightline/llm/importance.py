"""Operator 13: importance resampling of documents towards a target text, over hashed n-gram counts.

1. Every text becomes a packed stream of uint16 buckets (crc32 of a feature modulo `buckets`) with the place at which each document ends in
   it; a run of documents is one row of a table in the shared folder. A feature is a run of 1 to `ngrams` consecutive words.
2. Each task reads streams, sorts them by the piece, run-length encodes the pieces and adds the runs up, so it sends `buckets` counts at
   most; Spark sums those of all tasks. The target's texts are counted in the same way.
3. A bucket's gain is floor(1000 * ln of the smoothed share in the target over that in the corpus). At most 65 536 gains go to all tasks;
   they are gathered along the streams and summed by document with `np.add.reduceat`.
4. weight is the floored mean of a document's gains, score adds a Gumbel number that depends on seed and doc_id alone, so the highest
   scores are a draw without replacement in proportion to exp(weight / 1000). Ranks come from one sort by ranges of (score, doc_id): a
   row's rank is its place in its range and the number of rows in the ranges before.

Words are the runs of ASCII digits, letters and bytes of 128 and above; A-Z count as a-z.

Cases: null or empty texts, and texts without a word, have no features and weight 0; a null doc_id counts as empty in the hash and as the
smallest among ties; repeated rows are each counted, scored and drawn; rows equal in score and doc_id go by n_features; very long texts
are a stream of their own, in the memory of one task; an empty target makes all t zero; without documents there is no row; further columns
are ignored."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import Words, arrow_rows, per_chunk, read_table, text_of, written

BUCKETS, NGRAMS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
SORTED_AT_ONCE = 1 << 22
PLAIN = np.full(256, 32, np.uint8)
PLAIN[48:58], PLAIN[97:123], PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
PLAIN[65:91] = np.arange(97, 123)

CRC_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC_TABLE = np.where(CRC_TABLE & 1, np.uint32(0xEDB88320) ^ (CRC_TABLE >> np.uint32(1)), CRC_TABLE >> np.uint32(1))
#: Bytes of a word that are worked side by side with those of others; what is longer goes on by zlib.
SIDE_BY_SIDE = 32


def crc32_on(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[start:end], crc) for each."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, size = start[order], size[order]
    state = ~crc[order]
    for k in range(min(SIDE_BY_SIDE, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -k, "left"))  # those of more than k bytes
        now = state[:n]
        state[:n] = CRC_TABLE[(now ^ data[at[:n] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -SIDE_BY_SIDE, "left"))):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] + SIDE_BY_SIDE : at[i] + size[i]], int(~state[i])))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def bucket_stream(data: np.ndarray, offsets: np.ndarray, buckets: int, ngrams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features by document, where each document's features end, words of each document) of a run of texts."""
    words = Words(PLAIN[data], offsets, hashes=False)
    n_words = np.diff(words.first)
    left = words.first[1:][words.doc] - np.arange(len(words))  # words from here to the document's end
    blank, at = np.array([32], np.uint8), np.arange(len(words))
    crc, found = np.zeros(len(words), np.uint32), []
    for k in range(ngrams):
        if k:
            longer = left[at] > k
            at, crc = at[longer], crc[longer]
            crc = crc32_on(crc, blank, np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
        crc = crc32_on(crc, words.data, words.start[at + k], words.end[at + k])
        found.append((words.doc[at], (crc % np.uint32(buckets)).astype(np.uint16)))
    doc, stream = (np.concatenate(x) for x in zip(*found, strict=True))
    if ngrams > 1:
        order = np.argsort(doc, kind="stable")
        doc, stream = doc[order], stream[order]
    return stream, np.searchsorted(doc, np.arange(1, len(offsets)), "left"), n_words


def write_streams(texts: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> DataFrame:
    """(doc_ids, ends, words, stream) of (doc_id, text) as a table in the shared folder: each row a run of documents, the last three packed
    as little-endian int64, int64 and uint16."""
    if not 0 < buckets <= 1 << 16 or ngrams < 1:
        raise ValueError("buckets must fit in 16 bits, and a feature has one word at least")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in per_chunk(batches):
            stream, ends, words = bucket_stream(data, offsets, buckets, ngrams)
            ids = batch.column("doc_id")
            yield arrow_rows(doc_ids=pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), ends=[ends.astype("<i8").tobytes()], words=[words.astype("<i8").tobytes()], stream=[stream.astype("<u2").tobytes()])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return written(rows.mapInArrow(pack, "doc_ids array<long>, ends binary, words binary, stream binary"), "streams")


def count_streams(streams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of streams, by sorted pieces and their runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(buckets, np.int64), [], 0

        def settle() -> None:
            piece = np.sort(np.concatenate(held), kind="stable")
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else np.zeros(0, np.int64)
            total[piece[first]] += np.diff(np.append(first, len(piece)))

        for batch in batches:
            for body in batch.column("stream"):
                held.append(np.frombuffer(body.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= SORTED_AT_ONCE:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        there = np.flatnonzero(total)
        if len(there):
            yield arrow_rows(bucket=there.astype(np.int32), n=total[there])

    return streams.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the counts of both sides, which are `buckets` rows each at most."""
    s, t = np.zeros(buckets, object), np.zeros(buckets, object)
    for counts, table in ((s, corpus), (t, target)):
        for r in table.collect():
            counts[r.bucket] = r.n
    all_s, all_t = int(sum(s)) + buckets, int(sum(t)) + buckets
    return np.array([math.floor(1000 * math.log(float((b + 1) * all_s) / float((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh_streams(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of each document."""
    shared = streams.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for ids, ends, words, stream in zip(*(batch.column(c) for c in ("doc_ids", "ends", "words", "stream")), strict=True):
                ends, words, stream = (np.frombuffer(x.as_buffer(), t) for x, t in ((ends, "<i8"), (words, "<i8"), (stream, "<u2")))
                size = np.diff(ends, prepend=0)
                weight, full = np.zeros(len(ends), np.int64), size > 0
                if full.any():
                    weight[full] = np.add.reduceat(gain[stream], (ends - size)[full]) // size[full]
                yield arrow_rows(doc_id=ids.values, n_features=size, n_words=words, weight=weight)

    return streams.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text) against target (text); rank is null where a row isn't drawn.

    Drawn are floor(percent * N / 100) of the N rows that have least_words words or more."""
    streams = write_streams(docs, buckets, ngrams)
    wanted = write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, ngrams)
    gain = gains(count_streams(streams, buckets), count_streams(wanted, buckets), buckets)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weigh_streams(streams, gain).withColumn("score", F.col("weight") + gumbel)
    able = F.col("n_words") >= least_words
    n = max(1, docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("__able").desc(), F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    sorted_ = scored.withColumn("__able", able).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "scores")
    sizes = sorted_.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n"), F.count_if("__able").alias("able")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:  # one row for each range
        before.append((r.part, total))
        total += r.n
    drawn = sum(r.able for r in sizes) * percent // 100
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = sorted_.join(starts, F.shiftright("__at", 33) == F.col("part"), "left")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("__able") & (rank <= drawn), rank).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with all their columns; rows of one doc_id stay or go together."""
    return docs.join(resample(docs, target, **settings).where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
