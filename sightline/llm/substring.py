"""Operator 4: substring deduplication by relative Lempel-Ziv parsing against content-addressed reference blocks.

A reference block is what the corpus holds under one range of anchors. Every run of `window` words has an
anchor, the least hash of its `gram`-word grams; neighbouring windows with one anchor form a segment, and a
segment goes to the block of its anchor. So a block holds every segment that could match a factor there, and
a document meets each block that can hold a match of `window` words, and no other. In its block a segment is
factored greedily from left to right: the longest match with any one place that is earlier in (doc_id, start), taken until it
breaks; then the next factor begins at the first window that the last one does not hold, window - 1 words before the last one's
end, so a window over the border of two factors is checked too. A window over the border of two segments belongs
to the later one and is checked in that one's block. Factors become spans of words, and the spans go back to the documents.

A first pass counts anchors. Those of more than HOT_SEGMENTS segments (a frequent phrase among varying neighbours) are not used: their
windows take the hash of all their words as anchor, which spreads them over all blocks. The counts leave out anchors that no
run of FLUSH_BYTES holds HOT_RUN times; such an anchor can have HOT_RUN - 1 segments for each FLUSH_BYTES of text.

Equal segments of a task are settled there (all but the first are factors as a whole), so a hot passage reaches its block
once for each task; the settled ones are dealt to all blocks by document. A task that runs again must therefore see
its rows in the same order, as a table scan gives them. Windows are told apart by a 64-bit anchor and 32 further bits.

Cases: a null or empty text has no words; a null doc_id sorts before all others; rows with one doc_id are
ordered by crc32 of the text, and wholly equal rows count as one document; of very long texts all windows are parsed, each text in the
memory of one task; an empty table gives an empty one; further columns are kept as they are, but for those named as the added ones, which
are replaced."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import FAN, GRAM_POWERS, U64, Steps, Words, arrow_rows, as_signed, block_of, deal_widths, dealt_on, gram_hash, merged, mix, packed_runs, per_chunk, read_table, schema_with, settled, sliding, text_of, within

WINDOW = 20
GRAM = 6
FLUSH_BYTES = 24 << 20
BLOCK_SEGMENTS = 1 << 18
HOT_SEGMENTS = 1 << 14
HOT_RUN = 4
NO_ID = -(1 << 63)


def segments(words: Words, window: int = WINDOW, gram: int = GRAM, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, content hash) of each segment, and 32 bits for each window of them. hot: anchors, in
    order, that are not used."""
    ok = within(words.doc, window)
    if not ok.any():
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.uint32)
    least = sliding(gram_hash(words.hash, gram), window - gram + 1)
    whole = gram_hash(words.hash, window)
    bits = (whole >> U64(32)).astype(np.uint32)
    if hot is not None and len(hot):
        at = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        least = np.where(at, mix(whole + U64(1)), least)
    at = np.flatnonzero(ok)
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    end = start + count + window - 1
    up, down = GRAM_POWERS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words.hash * up[: len(words)], out=total[1:])
    content = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    return least[start], start, count, content, bits[at]


def _take(bits: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """bits of the segments `which`, one after the other."""
    own = count[which]
    ends = np.cumsum(own)
    begin = (np.cumsum(count) - count)[which]
    return bits[np.repeat(begin - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _fresh(*sorted_: np.ndarray) -> np.ndarray:
    """Whether each place differs in any column from the one before it."""
    out = np.ones(len(sorted_[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return out


def hot_anchors(rows: DataFrame, window: int, gram: int, least: int = HOT_SEGMENTS) -> tuple[np.ndarray, int]:
    """(anchors of more than `least` segments and than 2^-20 of all, so 2^20 of them at most; number of segments, equal ones of a run once)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def send() -> pa.RecordBatch:
            anchor, content = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first = np.unique(content, return_index=True)
            key, n = np.unique(anchor[first], return_counts=True)
            often = n >= HOT_RUN
            return arrow_rows(anchor=pa.array([*as_signed(key[often]).tolist(), None], pa.int64()), n=np.append(n[often], len(first)).astype(np.int64))

        for _, data, offsets in per_chunk(batches):
            anchor, _, _, content, _ = segments(Words(data, offsets), window, gram)
            parts.append((anchor, content))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield send()
                parts, size = [], 0
        if parts:
            yield send()

    counts = settled(rows.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where((F.col("n") > least) | F.col("anchor").isNull()))
    total = counts.where("anchor is null").first()
    n = int(total.n) if total else 0
    hot = counts.where(F.col("anchor").isNotNull() & (F.col("n") > n >> 20)).collect()
    return np.sort(np.array([r.anchor for r in hot], np.int64).view(U64)), n


class Pending:
    """Segments of a task that have not been sent yet."""

    def __init__(self, blocks: int, width: int, window: int, gram: int, hot: np.ndarray):
        self.blocks, self.width, self.window, self.gram, self.hot = blocks, width, window, gram, hot
        self.parts, self.bytes = [], 0

    def add(self, doc_id: np.ndarray, tag: np.ndarray, words: Words, size: int) -> None:
        anchor, start, count, content, bits = segments(words, self.window, self.gram, self.hot)
        doc = words.doc[start] if len(start) else start
        self.parts.append((doc_id[doc], tag[doc], start - words.first[doc], anchor, count, content, bits))
        self.bytes += size

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        doc_id, tag, start, anchor, count, content, bits = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.bytes = [], 0
        order = np.lexsort((start, tag, doc_id))
        order = order[_fresh(*(x[order] for x in (doc_id, tag, start, content)))]
        _, first = np.unique(content[order], return_index=True)
        live = np.zeros(len(order), bool)
        live[first] = True
        i, j = order[live], order[~live]
        # Settled segments meet nothing: they go by document, so that those of a hot passage spread over all blocks.
        yield packed_runs(*_streams(self.blocks, self.width, (doc_id[i], tag[i], start[i], count[i], anchor[i]), _take(bits, count, i), (doc_id[j], tag[j], start[j], count[j])))


def _streams(blocks: int, width: int, live: tuple, bits: np.ndarray, done: tuple) -> list:
    """What packed_runs takes: segments to match, their windows' bits, settled segments; buckets hold `width` blocks."""
    to = block_of(live[4], blocks) // width
    by_document = block_of(done[0].astype(np.int64).view(U64) + done[1].astype(U64) * U64(0x9E3779B97F4A7C15), blocks) // width
    pack = lambda d, t, s, n: [Steps(d), t.astype(np.uint32), s.astype(np.int32), Steps(n)]
    return [(to, [*pack(*live[:4]), live[4]]), (np.repeat(to, live[3]), [bits]), (by_document, pack(*done))]


def longest_earlier(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, source) for the places of `keys` whose key occurs more than once: the longest run from there on, within its
    owner, that also starts at an earlier place, and the place where (0 and -1 if there is none). By a suffix array."""
    _, rank, n = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[rank] > 1)
    m = len(at)
    if not m:
        return at, at, at
    breaks = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))
    run_end = np.append(breaks + 1, m)
    left = run_end[np.searchsorted(run_end, np.arange(m), "right")] - np.arange(m)  # windows up to the end of the run
    rank = np.unique(rank[at], return_inverse=True)[1] + 1
    levels, h = [rank], 1
    while h < int(left.max()):
        second = np.zeros(m, np.int64)
        inside = np.flatnonzero(left > h)
        second[inside] = rank[inside + h]
        finer = np.unique(rank * (m + 2) + second, return_inverse=True)[1] + 1
        if finer.max() == rank.max():
            break
        rank, h = finer, h * 2
        levels.append(rank)
    order = np.lexsort((np.arange(m), rank))
    a, b = order[:-1].copy(), order[1:].copy()
    least = np.minimum(left[a], left[b])
    common = np.zeros(m - 1, np.int64)
    same_rank = levels[-1][a] == levels[-1][b]
    common[same_rank] = least[same_rank]
    for k in range(len(levels) - 1, -1, -1):
        step = np.flatnonzero(~same_rank & (common < least))
        step = step[levels[k][a[step] + common[step]] == levels[k][b[step] + common[step]]]
        common[step] = np.minimum(common[step] + (1 << k), least[step])
    length, source, stack = [0] * m, [-1] * m, []
    for place, met in zip([*order.tolist(), -1], [0, *common.tolist(), 0], strict=True):
        while stack and place < stack[-1][0]:
            p, before = stack.pop()
            if before or met:
                length[p], source[p] = (before, stack[-1][0]) if before >= met else (met, place)
            met = min(before, met)
        stack.append((place, met))
    source = np.array(source)
    return at, np.array(length), np.where(source >= 0, at[source], -1)


def greedy_factors(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, source) of the factors: at the first place that no factor holds yet the longest earlier match, if there is one."""
    at, length, source = longest_earlier(keys, owner)
    chosen, free = [], -1
    for i, (p, n) in enumerate(zip(at.tolist(), length.tolist(), strict=True)):
        if n and p >= free:
            chosen.append(i)
            free = p + n
    return at[chosen], length[chosen], source[chosen]


def parse_block(bodies: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(doc_id, tag, first word, number of words, doc_id and first word of the source) of the factors of one block; a segment that its task
    settled is a factor whose source is not named (NO_ID, -1)."""
    doc_id, tag, start, size, anchor, bit, *done = merged(bodies)
    cuts = np.cumsum(size) - size
    order = np.lexsort((start, tag, doc_id))
    order = order[_fresh(*(x[order] for x in (doc_id, tag, start, anchor, size)))]  # rows repeated in other tasks
    bit = bit[np.repeat(cuts[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(int(size[order].sum()))]
    doc_id, tag, start, size, anchor = (x[order] for x in (doc_id, tag, start, size, anchor))
    key = mix(np.repeat(anchor, size) + bit.astype(U64) * U64(0x9E3779B97F4A7C15))
    owner, inner = np.repeat(np.arange(len(size)), size), np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    at, length, source = greedy_factors(key, owner)
    own, other = owner[at], owner[source]
    n = len(done[0])
    return (
        np.concatenate([doc_id[own], done[0]]),
        np.concatenate([tag[own], done[1]]),
        np.concatenate([start[own] + inner[at], done[2]]).astype(np.int64),
        np.concatenate([length, done[3]]).astype(np.int64) + window - 1,
        np.concatenate([doc_id[other], np.full(n, NO_ID)]),
        np.concatenate([start[other] + inner[source], np.full(n, -1)]).astype(np.int64),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__tag", F.crc32(text_of().cast("binary")))


def _in_blocks(docs: DataFrame, window: int, gram: int, blocks: int | None, fan: int, hot_segments: int) -> DataFrame:
    """(block, body): the segments of docs (doc_id, text)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), text_of().alias("text"))
    hot, n = hot_anchors(rows, window, gram, hot_segments)
    blocks = blocks or max(16, -(-n // BLOCK_SEGMENTS))
    widths = deal_widths(blocks, fan)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = Pending(blocks, widths[0], window, gram, shared.value)
        for batch, data, offsets in per_chunk(batches):
            raw = memoryview(data)
            tag = np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint32)
            pending.add(batch.column("__id").to_numpy(zero_copy_only=False), tag, Words(data, offsets), len(data))
            if pending.bytes >= FLUSH_BYTES:
                yield from pending.send()
        yield from pending.send()

    def again(bodies: list[bytes], width: int) -> list:
        doc_id, tag, start, size, anchor, bit, *done = merged(bodies)
        return _streams(blocks, width, (doc_id, tag, start, size, anchor), bit, done)

    return dealt_on(rows.mapInArrow(cut, "block long, body binary"), widths, again, FLUSH_BYTES)


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None, fan: int = FAN, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, first_word, n_words, source_id, source_word): the factors of docs (doc_id, text) that are `window` words long or longer.

    A factor is cut where the anchor changes; the source is null where the factor equals an earlier segment of its own task."""

    def parse(table: pa.Table) -> pa.Table:
        doc, _, start, length, other, place = parse_block(table.column("body").to_pylist(), window)
        known = pa.array(place >= 0)
        return pa.table({"doc_id": doc, "first_word": start, "n_words": length, "source_id": pa.array(other, mask=place < 0), "source_word": pa.array(place, mask=~known.to_numpy(zero_copy_only=False))})

    found = _in_blocks(docs, window, gram, blocks, fan, hot_segments).groupBy("block").applyInArrow(parse, "doc_id long, first_word long, n_words long, source_id long, source_word long")
    none = F.lit(NO_ID)
    return found.select(F.nullif("doc_id", none).alias("doc_id"), "first_word", "n_words", F.nullif("source_id", none).alias("source_id"), "source_word")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None, fan: int = FAN, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(__id, __tag, spans): for each document with factors, its spans as pairs of int64 (first word, words), packed in binaries."""

    def parse(table: pa.Table) -> pa.Table:
        doc, tag, start, length, _, _ = parse_block(table.column("body").to_pylist(), window)
        order = np.lexsort((start, tag, doc))
        doc, tag, pairs = doc[order], tag[order].astype(np.int64), np.column_stack([start, length])[order].astype("<i8")
        first = np.flatnonzero(_fresh(doc, tag)) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(doc))[: len(first)]
        return pa.table({"__id": doc[first], "__tag": tag[first], "span": pa.array([pairs[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())})

    return _in_blocks(docs, window, gram, blocks, fan, hot_segments).groupBy("block").applyInArrow(parse, "__id long, __tag long, span binary").groupBy("__id", "__tag").agg(F.collect_list("span").alias("spans"))


def covered(spans: list[bytes] | None, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    if not spans:
        return np.zeros(n, bool)
    pairs = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 0] + pairs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def remove_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None) -> DataFrame:
    """docs with n_words, n_removed, kept_text and kept_sha256 added: the words that no duplicate window covers, joined by one space."""
    added = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    spans = duplicate_spans(docs, window, gram, blocks)
    base = _keyed(docs.drop(*added))
    joined = base.join(spans.withColumnRenamed("__id", "__i").withColumnRenamed("__tag", "__t"), (F.col("__id") == F.col("__i")) & (F.col("__tag") == F.col("__t")), "left").drop("__id", "__tag", "__i", "__t").withColumnRenamed("spans", "__spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in per_chunk(batches):
            words = Words(data, offsets, hashes=False)
            lists = batch.column("__spans").to_pylist()
            raw = memoryview(data)
            n_words, n_removed, kept, digests = np.diff(words.first), [], [], []
            for i, spans in enumerate(lists):
                a, b = int(words.first[i]), int(words.first[i + 1])
                gone = covered(spans, b - a)
                left = np.flatnonzero(~gone) + a
                text = b" ".join(raw[x:y] for x, y in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True))
                n_removed.append(b - a - len(left))
                kept.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            names = [c for c in batch.schema.names if c != "__spans"]
            columns = [batch.column(c) for c in names] + [pa.array(n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names + added)

    kinds = dict(zip(added, ("long", "long", "string", "string"), strict=True))
    return joined.mapInArrow(finish, schema_with(base.drop("__id", "__tag"), kinds))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_duplicates(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
