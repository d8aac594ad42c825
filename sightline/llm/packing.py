"""Operator 3: hierarchical best-fit packing of token sequences.

Documents become pieces of at most `capacity` ids. Full pieces are sequences of their own. The others are
items: each partition packs its items best-fit (largest first), emits the nearly full bins, and sends the
underfull ones as items to a level of fewer partitions, where the same is done. A level has as many groups as its items need. Before it,
bins that not even the least item left can join are emitted too, and the rounds end when one group is left or a level
brought the number of open bins down by less than a hundredth; so no group grows with the table, whatever the sizes are.
Only (item, size) rows move between levels; texts and ids don't.

Cases: a null or empty text is the end id alone; equal rows and equal doc_ids are packed each on their own, a null doc_id stays null; of very
long texts every piece is packed, a text in the memory of one task; ties in size go by item number; an empty table gives an empty one; further
columns are ignored, whatever their names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_rows, per_chunk, read_table, text_of, written
from sightline.llm.tokens import encoder, vocabulary_path

CAPACITY = 1024
END_ID = 2
GROUP_ITEMS = 20_000
LEAST_GAIN = 0.01
NEARLY_FULL = 0.999


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin of each item, offset in it, fill of each bin). Ties go by place in sizes."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order.tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if room > s:
            by_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return bins, offsets, fill


def _packer(level: int, last: bool, capacity: int, nearly_full: float):
    """Packs the items of one group; groups, levels and bins of the names don't meet."""

    def pack(key, pdf):
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, offsets, fill = best_fit(pdf["size"].to_numpy(), capacity)
        filled = np.array(fill, np.int64)
        name = -1 - ((level << 56) + (int(key[0]) << 24) + bins)
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "bin": name, "offset": offsets, "fill": filled[bins], "closed": last | (filled[bins] >= nearly_full * capacity)})

    return pack


def pack_items(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, nearly_full: float = NEARLY_FULL, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(item, bin, offset) for items (item long unique, size long from 1 to capacity); bin: any numbers below zero.

    A group has about group_items items at every level."""
    level, placed, left, n = 0, [], items.select("item", "size"), items.count()
    while n:
        groups = max(1, -(-n // group_items))
        dealt = left.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups)))
        out = written(dealt.groupBy("g").applyInPandas(_packer(level, groups == 1, capacity, nearly_full), "item long, bin long, offset long, fill long, closed boolean"), "pack")
        placed.append(out)
        if groups == 1:
            break
        bins = out.where(~F.col("closed")).groupBy("bin").agg(F.max("fill").alias("size"))
        least = bins.agg(F.min("size")).first()[0] or 0
        left = bins.where(F.col("size") + least <= capacity).select(F.col("bin").alias("item"), "size")
        before, n, level = n, left.count(), level + 1
        if n > (1 - least_gain) * before:
            break
    if not placed:
        return items.select("item", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    result = placed[0].select("item", "bin", "offset")
    for later in placed[1:]:
        up = later.select(F.col("item").alias("bin"), F.col("bin").alias("bin2"), F.col("offset").alias("offset2"))
        result = result.join(up, "bin", "left").select("item", F.coalesce("bin2", "bin").alias("bin"), (F.col("offset") + F.coalesce("offset2", F.lit(0))).alias("offset"))
    return result


def cut_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of docs (doc_id, text): (item, doc_id, n_ids, crcs of its pieces, base).

    The first piece has n_ids mod capacity ids if that isn't 0, all others capacity. item is unique, and
    base + k is unique over all pieces k. A null text counts as empty: the end id alone."""
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = encoder(vocabulary).encode, TaskContext.get().partitionId() << 36
        item = place
        for batch, data, offsets in per_chunk(batches):
            ids, at = encode(data, offsets)
            sizes, crcs, bases = [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))
                first = len(own) % capacity or capacity
                edges = [0, *range(first, len(own) + 1, capacity)]
                crcs.append([zlib.crc32(own[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
                sizes.append(len(own))
                bases.append(place)
                place += len(edges) - 1
            yield arrow_rows(item=np.arange(item, item + len(sizes)), doc_id=batch.column("doc_id"), n_ids=np.array(sizes, np.int64), crcs=pa.array(crcs, pa.list_(pa.int64())), base=np.array(bases, np.int64))
            item += len(sizes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, "item long, doc_id long, n_ids long, crcs array<long>, base long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of docs and its place.

    Repeated rows and equal doc_ids are packed each on their own; a null doc_id stays null."""
    cut = written(cut_documents(docs, vocabulary, end_id, capacity), "pieces")
    first = F.col("n_ids") % capacity
    items = cut.where(first > 0).select("item", first.alias("size"))
    bins = pack_items(items, capacity)
    pieces = cut.join(bins, "item", "left").select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    rest, alone = F.col("n_ids") % capacity, F.col("n_ids") % capacity == 0
    start = F.when((F.col("piece") == 0) | alone, F.col("piece").cast("long") * capacity).otherwise(rest + (F.col("piece").cast("long") - 1) * capacity)
    packed = (F.col("piece") == 0) & ~alone
    return pieces.select(
        "doc_id",
        "piece",
        start.alias("start"),
        F.when(packed, rest).otherwise(F.lit(capacity).cast("long")).alias("length"),
        "ids_crc32",
        F.when(packed, F.col("bin")).otherwise(F.col("base") + F.col("piece")).alias("sequence_id"),
        F.when(packed, F.col("offset")).otherwise(F.lit(0).cast("long")).alias("offset"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
