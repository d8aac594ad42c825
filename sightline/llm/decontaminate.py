"""Operator 1: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. Equal items are one item with several ids. Seeds of an item are its pairs of neighbouring words that COMMON items or fewer hold; a document holds
   a pair also where a further word stands between the two. So a place of a document meets 2 * COMMON pairs at most, however large the
   benchmark is. Rare is what few *items* hold: copies in the documents don't change it, so they can't hide edited copies.
2. An alignment whose score reaches THRESHOLD (one half or more) keeps a third of the item's pairs in this sense, less one; needed_pairs gives the exact
   number. Of an item with q pairs that aren't seeds a document must hold needed_pairs - q distinct seeds, at diagonals (place in
   the document less place in the item) that differ by the item's size at most: no alignment is lost.
3. Where q is as large as needed_pairs, runs of common pairs are seeds too, as n-grams of LEVELS words, the shortest that few items hold; one seed is enough
   then. Such items, which share most of their words with many others, can lose copies that are edited in each of their own places.
4. Each group of seeds at near diagonals opens a passage that holds every alignment through it. Passages that lack so many of the item's words that no
   alignment can reach THRESHOLD are left out (a matched word gives 2 of the 2 * item words points), for many passages at once.
5. The passage is aligned to the item word by word (match +2, else -1, gap -1), many passages of equally long items at a time. Score over
   2 * item words is the coverage; at THRESHOLD and more the document is contaminated by the item. Items of one or two words must be met in full.

The items go to all tasks only while their text is at most MAX_ITEM_BYTES; a larger benchmark is worked in several
passes of that size, each of which reads the documents once. Words are compared in lower case; punctuation counts as blank wherever it stands.

Cases: null or empty texts have no seeds, and neither have items without a word, which match nothing; equal items and
documents are each reported; nulls in ids are kept; of very long texts all passages are aligned, a text in the memory of one task; of
equally good places the last counts; an empty table on either side gives an empty one; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import U64, Words, gram_hash, mix, per_chunk, read_table, text_of, within

THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
MAX_ITEM_BYTES = 8 << 20
#: As many items may hold a seed.
COMMON = 16
LEVELS = 3, 4, 6, 8, 12, 16, 24, 32
#: Cells of items and passages that are compared at once, and the size from which items are aligned one by one.
CELLS, LONG = 1 << 22, 256
EDGE = np.zeros(256, bool)
EDGE[[ord(c) for c in ".,;:!?\"'()[]{}*#$%&|-_"]] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case; bytes of EDGE count as blanks."""
    clean = data.copy()
    clean[EDGE[clean]] = 32
    return Words(clean, offsets, lower=True)


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best score, first word, word after the last) of the local alignment of item to passage, both word hashes."""
    n, m = len(item), len(passage)
    before, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, ends = 0, (0, 0)
    steps = -GAP * np.arange(m + 1)
    for i in range(n):
        diagonal, up = before[:-1] + np.where(passage == item[i], MATCH, MISMATCH), before[1:] + GAP
        row, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
        row[1:] = np.maximum(0, np.maximum(diagonal, up))
        start[1:] = np.where(row[1:] == 0, start[1:], np.where(diagonal >= up, origin[:-1], origin[1:]))
        # Gaps along the row: the best of what stands before it, less a point for each step.
        lifted = row + steps
        peak = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == peak, np.arange(m + 1), 0))
        row, start = peak - steps, start[at]
        j = int(np.argmax(row))
        if row[j] > best:
            best, ends = int(row[j]), (int(start[j]), j)
        before, origin = row, start
    return best, *ends


def best_scores(same: np.ndarray) -> np.ndarray:
    """The scores of the best local alignments of many items and passages at a time; same: (pair, word of the item, word of the passage)."""
    n, size, m = same.shape
    before, best, steps = np.zeros((n, m + 1), np.int32), np.zeros(n, np.int32), -GAP * np.arange(m + 1, dtype=np.int32)
    for i in range(size):
        row = np.zeros((n, m + 1), np.int32)
        np.maximum(before[:, :-1] + np.where(same[:, i], MATCH, MISMATCH), before[:, 1:] + GAP, out=row[:, 1:])
        before = np.maximum.accumulate(np.maximum(row, 0) + steps, axis=1) - steps
        np.maximum(best, before.max(axis=1), out=best)
    return best


def needed_pairs(n: int) -> int:
    """How many neighbouring pairs of an item of n words a document holds at least, if it aligns with half of all points or more.

    m words match. Of the m - 1 steps between them, some skip words of the item (x, at most n - m, a point each at least), some cost two points or
    more without that (y), and the others are such pairs. The points lost are 2 m - n at most."""
    least = n
    for m in range((n + 1) // 2, n + 1):
        x = np.arange(min(n - m, 2 * m - n) + 1)
        if len(x):
            least = min(least, int((m - 1 - x - np.minimum((2 * m - n - x) // 2, np.maximum(0, m - 1 - x))).min()))
    return max(0, least)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b)


class Items:
    """The distinct test items, their words and seeds: level -> (hash, item, place) by hash. Levels 1 and 2 are words and pairs, others longer n-grams."""

    def __init__(self, rows: list[tuple[object, str | None]], common: int = COMMON):
        texts = [(t or "").encode() for _, t in rows]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words = plain_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        same: dict[bytes, list] = {}
        kept = []
        for (i, _), a, b in zip(rows, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            key = words.hash[a:b].tobytes()
            if key not in same:
                same[key] = []
                kept.append(words.hash[a:b])
            same[key].append(i)
        self.ids = list(same.values())
        self.size = np.array([len(x) for x in kept], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.hash = np.concatenate([np.zeros(0, U64), *kept])
        needs = {n: needed_pairs(n) for n in np.unique(self.size).tolist()}
        self.needed = np.array([max(1, needs[n]) for n in self.size.tolist()], np.int64)
        self._find_seeds(common)

    def words(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]

    def _find_seeds(self, common: int) -> None:
        h, item = self.hash, np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(h)) - self.first[:-1][item]
        found: dict[int, list] = {}

        def put(level: int, keys: np.ndarray, at: np.ndarray) -> None:
            found.setdefault(level, []).append((keys, item[at], place[at]))

        lone = np.flatnonzero(self.size[item] == 1)
        put(1, mix(h[lone] + U64(1)), lone)
        near = np.flatnonzero(within(item, 2))
        # Of three words two that stand apart can be enough.
        apart = np.flatnonzero(within(item, 3))
        apart = apart[self.size[item[apart]] == 3]
        at, keys = np.concatenate([near, apart]), np.concatenate([pair_hash(h[near], h[near + 1]), pair_hash(h[apart], h[apart + 2])])
        wide = _holders(keys, item[at]) > common
        put(2, keys[~wide], at[~wide])
        lost = np.bincount(item[at[wide]], minlength=len(self.size))
        self.least = np.maximum(1, self.needed - lost)
        open_ = lost >= self.needed
        # An item of which nothing is rare takes its first n-gram of the longest kind.
        last_level, last_at, last_key = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64), np.zeros(len(self.size), U64)
        at, keys, wide, size = near, keys[: len(near)], wide[: len(near)], 2
        for level in (*LEVELS, 0):
            who, first = np.unique(item[at[wide]], return_index=True)
            last_level[who], last_at[who], last_key[who] = size, at[wide][first], keys[wide][first]
            # A longer n-gram is a seed where common ones stand at both its ends.
            starts = np.zeros(len(h) + 1, bool)
            starts[at[wide]] = True
            at = np.flatnonzero(within(item, level)) if level else at[:0]
            at = at[open_[item[at]] & starts[at] & starts[at + level - size]]
            if not len(at):
                break
            keys = gram_hash(h, level)[at]
            wide, size = _holders(keys, item[at]) > common, level
            put(level, keys[~wide], at[~wide])
        served = np.zeros(len(self.size), bool)
        for parts in found.values():
            for _, owner, _ in parts:
                served[owner] = True
        for level in np.unique(last_level[~served & (last_level > 0)]).tolist():
            bare = np.flatnonzero(~served & (last_level == level))
            put(level, last_key[bare], last_at[bare])
        self.seeds = {}
        for level, parts in sorted(found.items()):
            keys, owner, where = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(keys):
                order = np.argsort(keys, kind="stable")
                self.seeds[level] = keys[order], owner[order], where[order]


def _holders(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many owners have each key."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.lexsort((owner, keys))
    k, o = keys[order], owner[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(new)
    distinct = np.add.reduceat((new | np.concatenate([[True], o[1:] != o[:-1]])).astype(np.int64), first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(distinct, np.diff(np.append(first, len(k))))
    return out


def _members(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    # A table of 2^20 bits first, so that most words need no search.
    seen = np.zeros(1 << 20, bool)
    seen[(sorted_ >> U64(44)).astype(np.int64)] = True
    hit = seen[(x >> U64(44)).astype(np.int64)]
    at = np.flatnonzero(hit)
    right = np.minimum(np.searchsorted(sorted_, x[at]), len(sorted_) - 1)
    hit[at] = sorted_[right] == x[at]
    return hit


def seed_hits(words: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of the text, item, seed of the item) of all places at which a text holds a seed."""
    out = []
    for n, (level, (seeds, owner, anchor)) in enumerate(items.seeds.items()):
        places, keys = [], []
        if level == 1:
            places, keys = [np.arange(len(words))], [mix(words.hash + U64(1))]
        elif level == 2:
            for apart in (1, 2):
                at = np.flatnonzero(within(words.doc, apart + 1))
                places.append(at)
                keys.append(pair_hash(words.hash[at], words.hash[at + apart]))
        else:
            at = np.flatnonzero(within(words.doc, level))
            places, keys = [at], [gram_hash(words.hash, level)[at]]
        at, key = np.concatenate(places), np.concatenate(keys)
        hit = _members(seeds, key)
        at, key = at[hit], key[hit]
        a, b = np.searchsorted(seeds, key, "left"), np.searchsorted(seeds, key, "right")
        entry = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(int((b - a).sum()))
        out.append((np.repeat(at, b - a), owner[entry], anchor[entry] * len(items.seeds) + n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def passages(words: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, word after the last) of the passages that hold enough seeds of an item at near diagonals.

    Diagonals of one alignment differ by the item's size at most, so they are together in a stretch of twice that, which begins at a multiple of
    that or half-way between two."""
    at, item, seed = seed_hits(words, items)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    pair = words.doc[at] * len(items.size) + item
    order = np.lexsort((seed, pair))
    at, item, seed, pair = at[order], item[order], seed[order], pair[order]
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    first = np.flatnonzero(new)
    distinct = np.add.reduceat((new | np.concatenate([[True], seed[1:] != seed[:-1]])).astype(np.int64), first)
    enough = np.repeat(distinct >= items.least[item[first]], np.diff(np.append(first, len(at))))
    at, item, seed, pair = at[enough], item[enough], seed[enough], pair[enough]
    diagonal, size = at - seed // len(items.seeds), items.size[item]
    twice = np.flatnonzero(items.least[item] > 1)
    both = np.concatenate([np.arange(len(at)), twice])
    stretch = np.concatenate([diagonal // (2 * size) * 2, (diagonal[twice] + size[twice]) // (2 * size[twice]) * 2 + 1])
    order = np.lexsort((seed[both], stretch, pair[both]))
    both, stretch = both[order], stretch[order]
    if not len(both):
        return (np.zeros(0, np.int64),) * 3
    pair, seed, diagonal, item = pair[both], seed[both], diagonal[both], item[both]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (stretch[1:] != stretch[:-1])])
    first = np.flatnonzero(new)
    distinct = np.add.reduceat((new | np.concatenate([[True], seed[1:] != seed[:-1]])).astype(np.int64), first)
    low, high, who = np.minimum.reduceat(diagonal, first), np.maximum.reduceat(diagonal, first), item[first]
    doc = pair[first] // len(items.size)
    # What an alignment loses is at most item words points, so it begins and ends at most so many words further off.
    low = np.maximum(words.first[doc], low - items.size[who])
    high = np.minimum(words.first[doc + 1], high + 2 * items.size[who] + 1)
    enough = distinct >= items.least[who]
    return who[enough], low[enough], high[enough]


def aligned(words: Words, items: Items, who: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Whether each passage aligns with share of its item's points or more."""
    out = np.zeros(len(who), bool)
    sizes = items.size[who]
    for n in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == n)
        if n > LONG:
            for j in mine.tolist():
                own, passage = items.words(int(who[j])), words.hash[low[j] : high[j]]
                out[j] = np.isin(own, passage).sum() >= share[j] * n and alignment(own, passage)[0] >= share[j] * MATCH * n
            continue
        width = int((high - low)[mine].max())
        step = max(1, CELLS // (n * width))
        for part in (mine[k : k + step] for k in range(0, len(mine), step)):
            place = low[part][:, None] + np.arange(width)
            passage = words.hash[np.minimum(place, len(words) - 1)]
            own = items.hash[items.first[who[part]][:, None] + np.arange(n)]
            same = (own[:, :, None] == passage[:, None, :]) & (place < high[part][:, None])[:, None, :]
            full = same.any(axis=2).sum(axis=1) >= share[part] * n
            part, same = part[full], same[full]
            if len(part):
                out[part] = best_scores(same) >= share[part] * MATCH * n
    return out


def _match(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch, data, offsets in per_chunk(batches):
            words = plain_words(data, offsets)
            who, low, high = passages(words, items)
            share = np.where(items.size[who] < 3, 1.0, threshold)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for j in np.flatnonzero(aligned(words, items, who, low, high, share)).tolist():
                d, w = int(words.doc[low[j]]), int(who[j])
                score, begin, end = alignment(items.words(w), words.hash[low[j] : high[j]])
                before = int(low[j] - words.first[d])
                best[d, w] = max(best.get((d, w), (0, 0, 0)), (score, before + begin, before + end))
            rows = [(d, i, score / (MATCH * int(items.size[w])), begin, end) for (d, w), (score, begin, end) in best.items() for i in items.ids[w]]
            if rows:
                d, i, score, begin, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array(i, pa.int64()), pa.array(score), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(align, "doc_id long, item_id long, score double, first_word long, end_word long")
    return rows.withColumn("score", F.round("score", 6))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every document and test item that align; words are those of plain_words. threshold is one half or more."""
    if threshold < THRESHOLD:
        raise ValueError("below a threshold of one half the seeds don't find every alignment")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // max_item_bytes))
    out = None
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        rows = [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]
        found = _match(docs, Items(rows), threshold) if rows else None
        out = found if out is None else out if found is None else out.union(found)
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    return empty if out is None else out


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
