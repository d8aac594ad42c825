"""Operator 6: the size-aware heavy-light join of shingle sets at Jaccard 0.8 and more.

1. Filter. In hash order, a linked set shares a known share of its first 30 % with its partner's. These shingles
   go to blocks by hash; a document that shares fewer of them than any link needs has no link.
2. Sets. Those that pass keep their whole set (40-bit hashes). Equal sets become one representative, the least row.
3. Lists. Shingles known as frequent come last in the order. A small (light) set enumerates the 2-subsets of
   its prefix: two linked sets share at least one. Large (heavy) sets are put on the inverted list of each shingle of their
   prefix. The boundary is where a light set's subsets cost as much as a heavy one's list scans, by the
   mean list length that step 1 counted, and where its subsets are MOST_SUBSETS at most; sets near it do both, so that pairs across it meet.
4. Links. Each member of the lists is first checked against one centre, the list head that most of its lists
   share, and linked sets become components. Lists still in several components are then joined within: lists with one
   head form a group, whose sets meet in one task (in pairs of blocks if they are many), which emits links that
   span the group's components. A list of more than LONG sets that is still unsettled is first split: linked sets of one list share
   one shingle more, so each set goes on to a list for each further shingle of a prefix one longer, up to two times. So thousands of near
   copies cost no pair rows, a frequent shingle costs no pair of blocks unless three shingles are as frequent together, and no
   link that joins two components is missed. Checks are exact set intersections.

Cases: null or empty texts have the empty set and link with nothing; rows with one doc_id are one document;
a null doc_id is a document of its own; the component is the least doc_id of those linked that have one, else null. Nodes are
sets, not doc_ids, so rows with one doc_id or none don't link what their texts don't; of very long texts the whole set is compared, a text in
the memory of one task; an empty table gives an empty one; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import FAN, GRAM_POWERS, U64, Steps, Words, arrow_rows, as_signed, block_of, deal_widths, dealt_on, gram_hash, merged, mix, pack_arrays, packed_runs, per_chunk, read_table, text_bytes, text_of, unpack_arrays, within, written
from sightline.llm.graph import components

SHINGLE = 5
NO_ID = -(1 << 63)
FLUSH_BYTES = 24 << 20
BLOCK_BYTES = 16 << 20
HOT_TOKENS = 4096
TOKEN_BITS = 40
BLOCK_SETS = 2048
LONG = 4 * BLOCK_SETS
REFINEMENTS = 2
MOST_SUBSETS = 8192


def document_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n+1 offsets): the distinct shingles of each document in hash order."""
    n = len(words.first) - 1
    ok = within(words.doc, k)
    g, d = gram_hash(words.hash, k)[ok], words.doc[: len(ok)][ok]
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < k))
    if len(short):
        a, b = words.first[short], words.first[short + 1]
        up, down = GRAM_POWERS.get(len(words) + 1)
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(words.hash * up[: len(words)], out=total[1:])
        g, d = np.concatenate([g, mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(n + 1))


def fingerprints(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(hashes) + 1, U64)
        np.cumsum(mix(hashes + U64(salt)), out=total[1:])
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U64)))
    return out[0], out[1]


def needed(size: np.ndarray) -> np.ndarray:
    """How many of a set's first 30 % any linked partner's first 30 % hold, at least."""
    return np.maximum(1, np.floor(0.0995 * size).astype(np.int64) - 2)


def _first_share(size: np.ndarray) -> np.ndarray:
    return -(-3 * size // 10)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def shared_counts(docs: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """(block, body): for documents, how many of their first shingles others have, in blocks of documents; block -1: statistics of the shingles."""
    widths = deal_widths(blocks, fan)

    def token_streams(width: int, lone: tuple, many: tuple, done: tuple) -> list:
        """Shingles (block, token, document) that occur once in a run, those (block, token, times) of several of its documents, and
        documents (id, times) that the run itself has counted."""
        named = [Steps(x[0]) if width > 1 else np.zeros(0, np.int64) for x in (lone, many)]
        keep = lambda columns, name: [c for c in columns] + ([name] if width > 1 else [])
        return [
            (lone[0] // width, keep([Steps(lone[2]), lone[1].astype(np.uint32)], named[0])),
            (many[0] // width, keep([many[1].astype(np.uint32), many[2].astype(np.uint32)], named[1])),
            (block_of(done[0].view(U64), blocks) // width, [Steps(done[0]), done[1].astype(np.uint32)]),
        ]

    def opened_tokens(bodies: list[bytes], wide: bool) -> tuple[tuple, tuple, tuple]:
        found = merged(bodies)
        if wide:
            ids, token, at, heard, total, where, done, times = found
        else:
            (ids, token, heard, total, done, times), at, where = found, np.zeros(0), np.zeros(0)
        return (at, token, ids), (where, heard, total), (done, times)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def send():
            hashes, sizes, ids, print_ = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.concatenate([[0], np.cumsum(sizes)])
            _, own = np.unique(print_, return_index=True)  # equal sets of a task are sent once
            own = own[np.argsort(ids[own], kind="stable")]
            doc = np.repeat(np.arange(len(own)), sizes[own])
            token = hashes[_ranges(at[own], sizes[own])]
            block = ((token >> U64(TOKEN_BITS)) % U64(blocks)).astype(np.int64)
            _, first, inverse, n = np.unique((block << 32) | (token & U64(0xFFFFFFFF)).astype(np.int64), return_index=True, return_inverse=True, return_counts=True)
            # What the run itself shares is counted here, and goes to its block as one number.
            met = n[inverse] > 1
            times = np.bincount(doc[met], minlength=len(own))
            done = np.flatnonzero(times)
            lone, many = np.flatnonzero(~met), first[n > 1]
            return packed_runs(*token_streams(widths[0], (block[lone], token[lone], ids[own][doc[lone]]), (block[many], token[many], n[n > 1]), (ids[own][done], times[done])))

        for batch, data, offsets in per_chunk(batches):
            hashes, at = document_sets(Words(data, offsets, lower=True))
            sizes = _first_share(np.diff(at))
            parts.append((hashes[_ranges(at[:-1], sizes)], sizes, batch.column("id").to_numpy(zero_copy_only=False), fingerprints(hashes, at)[0]))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield send()
                parts, size = [], 0
        if parts:
            yield send()

    def count(table: pa.Table) -> pa.Table:
        (_, tokens, ids), (_, many, totals), (done, known) = opened_tokens(table.column("body").to_pylist(), False)
        token, inverse = np.unique(np.concatenate([tokens, many]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([np.ones(len(tokens)), totals])).astype(np.int64)
        met = ids[n[inverse[: len(ids)]] > 1]
        doc, inverse = np.unique(np.concatenate([met, done]), return_inverse=True)
        times = np.bincount(inverse, np.concatenate([np.ones(len(met)), known])).astype(np.int64)
        hot = np.argsort(-n, kind="stable")[:64]
        hot = hot[n[hot] >= 32]
        stats = arrow_rows(block=np.array([-1]), body=pa.array([pack_arrays(np.array([n[n > 1].sum(), (n > 1).sum()]), token[hot].astype(np.uint32), n[hot])], pa.binary()))
        return pa.Table.from_batches([stats, packed_runs(*document_streams([(doc, times)], widths[0]))])

    def document_streams(parts: list[tuple[np.ndarray, np.ndarray]], width: int) -> list:
        ids, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        return [(block_of(ids.view(U64), blocks) // width, [Steps(ids), times.astype(np.uint32)])]

    dealt = dealt_on(docs.mapInArrow(cut, "block long, body binary"), widths, lambda bodies, width: token_streams(width, *opened_tokens(bodies, True)), FLUSH_BYTES)
    counted = written(dealt.groupBy("block").applyInArrow(count, "block long, body binary"), "shared")
    of_documents = dealt_on(counted.where("block >= 0"), widths, lambda bodies, width: document_streams([tuple(unpack_arrays(b)) for b in bodies], width), FLUSH_BYTES)
    return of_documents.union(counted.where("block < 0"))


def _summed(counts: DataFrame) -> DataFrame:
    """(i, shared) for each document that shares a shingle."""

    def add(table: pa.Table) -> pa.Table:
        ids, times = merged(table.column("body").to_pylist())
        doc, inverse = np.unique(ids, return_inverse=True)
        return pa.table({"i": doc, "shared": np.bincount(inverse, times).astype(np.int64)})

    return counts.where("block >= 0").groupBy("block").applyInArrow(add, "i long, shared long")


def packed_set(hashes: np.ndarray) -> bytes:
    """The low 40 bits of each hash, sorted, 5 bytes each."""
    low = np.unique(hashes & U64((1 << TOKEN_BITS) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def opened_set(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _sets_of(rows: DataFrame) -> DataFrame:
    """(id, t1, t2, n, hi, lo, tokens) of rows (id, t1, t2, text, shared); tokens only where a link is possible."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in per_chunk(batches):
            hashes, at = document_sets(Words(data, offsets, lower=True))
            size = np.diff(at)
            hi, lo = fingerprints(hashes, at)
            shared = batch.column("shared").to_numpy(zero_copy_only=False)
            may = (size > 0) & (shared >= needed(size))
            sets = [packed_set(hashes[at[i] : at[i + 1]]) if may[i] else None for i in range(batch.num_rows)]
            yield arrow_rows(id=batch.column("id"), t1=batch.column("t1"), t2=batch.column("t2"), n=size.astype(np.int64), hi=as_signed(hi), lo=as_signed(lo), tokens=pa.array(sets, pa.binary()))

    return rows.mapInArrow(build, "id long, t1 long, t2 long, n long, hi long, lo long, tokens binary")


def prefix_length(size: np.ndarray, least: int = 1) -> np.ndarray:
    """So many of a set's first shingles hold `least` of those common with any linked set."""
    return size - -(-4 * size // 5) + least


def boundary(mean_list: float) -> int:
    """The largest size at which the 2-subsets of a prefix, p (p + 1) / 2 of them, cost no more than p lists of mean_list entries, and are no more than
    MOST_SUBSETS: a list entry costs a row, however long its list."""
    return int(5 * max(0.0, min(2 * mean_list, (2 * MOST_SUBSETS) ** 0.5 - 1)))


def in_order(body: bytes, hot: np.ndarray) -> np.ndarray:
    """A set's shingles, frequent ones (by their low 32 bits, hot in order) last."""
    own = opened_set(body).astype(U64)
    if len(hot):
        low = own & U64(0xFFFFFFFF)
        late = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        own = np.concatenate([own[~late], own[late]])
    return own


def pair_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, place) of the 2-subsets of a light set's prefix."""
    a, b = np.triu_indices(min(len(own), int(prefix_length(np.array(len(own)), 2))), 1)
    x, y = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
    return mix(mix(x) + y + U64(1)), a, b


def single_keys(own: np.ndarray) -> np.ndarray:
    """Keys of the lists of a heavy set's prefix."""
    return mix(own[: int(prefix_length(np.array(len(own))))] + U64(1 << 63))


def list_entries(sets: DataFrame, light: int, hot: np.ndarray) -> DataFrame:
    """(key, id, n): one row for each list that a representative is on. hot: low 32 bits of frequent shingles, ordered last."""
    hot = np.sort(hot.astype(U64))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, sizes = [], [], []
            for i, body in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                own = in_order(body, hot)
                n = len(own)
                found = []
                if n <= light:
                    found.append(pair_keys(own)[0])
                if n >= 0.8 * light:
                    found.append(single_keys(own))
                found = np.concatenate(found)
                keys.append(found)
                ids.append(np.full(len(found), i))
                sizes.append(np.full(len(found), n))
            if keys:
                key, one, size = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes)
                for a in range(0, len(key), 1 << 16):
                    b = a + (1 << 16)
                    yield arrow_rows(key=as_signed(key[a:b]), id=one[a:b], n=size[a:b].astype(np.int32))

    return sets.mapInArrow(build, "key long, id long, n int")


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets have Jaccard 0.8 or more."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("s")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("t")), "b").select("a", "b", "s", "t")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                both = np.sort(np.concatenate([opened_set(s), opened_set(t)]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= 80 * (len(both) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def with_heads(entries: DataFrame) -> DataFrame:
    """entries (key, id, n) of lists with several members, with the list's head and its size; the head has the least order number."""
    order = F.xxhash64("id")
    heads = entries.groupBy("key").agg(F.count("*").alias("k"), F.min_by("id", order).alias("head"), F.min_by("n", order).alias("head_n")).where("k > 1").drop("k")
    return entries.join(heads, "key")


def centre_votes(entries: DataFrame) -> DataFrame:
    """(a, b, v): in how many lists a set stands with the head b, where their sizes allow a link."""
    near = 5 * F.least("n", "head_n").cast("long") >= 4 * F.greatest("n", "head_n").cast("long")
    return entries.where((F.col("id") != F.col("head")) & near).groupBy(F.col("id").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("v"))


def unsettled_lists(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """entries of all lists with more than one component, with the list's length k."""
    placed = entries.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("k")).where("least <> most").select("key", "k")
    return entries.join(mixed, "key")


def refined(entries: DataFrame, sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, id, n, own) of entries (key, id, maybe own) of long lists: a list for each further shingle of a prefix that is one longer, own being the
    shingles that name a list. Two linked sets that share the d shingles of a list share d + 1 within the longer prefixes."""
    hot = np.sort(hot.astype(U64))
    if "own" not in entries.columns:
        entries = entries.withColumn("own", F.lit(None).cast("binary"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, named, body in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "own", "tokens")), strict=True):
                own = in_order(body, hot)
                if named is not None:
                    have = np.frombuffer(named, U64)
                else:
                    wanted = np.array([key], np.int64).view(U64)[0]
                    single = np.flatnonzero(single_keys(own) == wanted)
                    keys, a, b = pair_keys(own) if not len(single) else (np.zeros(0, U64), single, single)
                    at = np.flatnonzero(keys == wanted)
                    have = own[single[:1]] if len(single) else np.sort(own[[a[at[0]], b[at[0]]]])
                more = own[: min(len(own), int(prefix_length(np.array(len(own)), len(have) + 1)))]
                more = more[~np.isin(more, have)]
                lists = np.sort(np.column_stack([np.tile(have, (len(more), 1)), more]), axis=1)
                found = np.full(len(more), U64(lists.shape[1]))
                for column in lists.T:
                    found = mix(found * U64(0x9E3779B97F4A7C15) + column)
                for p in range(0, len(found), 1 << 15):
                    q = slice(p, p + (1 << 15))
                    yield arrow_rows(key=as_signed(found[q]), id=np.full(len(found[q]), i), n=np.full(len(found[q]), len(own), np.int32), own=pa.array([x.tobytes() for x in lists[q]], pa.binary()))

    return entries.select("key", "id", "own").join(sets, "id").select("key", "id", "own", "tokens").mapInArrow(build, "key long, id long, n int, own binary").dropDuplicates(["key", "id"])


def unsettled_groups(entries: DataFrame, labels: DataFrame, sets: DataFrame, hot: np.ndarray, long: int = LONG, refinements: int = REFINEMENTS) -> DataFrame:
    """(head, id): the members of all lists with more than one component, lists with one head put together, long lists split."""
    out, rest = None, unsettled_lists(entries, labels)
    for turn in range(refinements + 1):
        rest = written(rest, "unsettled")
        short = rest if turn == refinements else rest.where(F.col("k") <= long)
        found = short.select("head", "id")
        out = found if out is None else out.union(found)
        if turn == refinements or rest.where(F.col("k") > long).isEmpty():
            break
        rest = unsettled_lists(with_heads(refined(rest.where(F.col("k") > long), sets, hot)), labels)
    return out.distinct()


def local_links(ids: np.ndarray, bodies: list[bytes]) -> list[tuple[int, int]]:
    """Links that span the components of a group of sets: rare-first prefixes by the group's own counts, then exact overlaps."""
    sets = [opened_set(x) for x in bodies]
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets))
        same = int((both[1:] == both[:-1]).sum())
        return [(int(ids[0]), int(ids[1]))] if 100 * same >= 80 * (len(both) - same) else []
    size = np.array([len(x) for x in sets])
    token, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    while True:  # a set with a fifth of its shingles to itself has no link
        _, index, count = np.unique(token, return_inverse=True, return_counts=True)
        alone = size - np.bincount(doc[count[index] > 1], minlength=len(size))
        dead = alone >= prefix_length(size)
        keep = ~dead[doc]
        if keep.all():
            break
        token, doc = token[keep], doc[keep]
        if not len(token):
            return []
    order = np.argsort(index, kind="stable")
    posting, begin = doc[order], np.cumsum(count) - count
    by_doc = np.searchsorted(doc, np.arange(len(size) + 1))
    label, links = np.arange(len(size)), []
    for i in np.unique(doc).tolist():
        own = index[by_doc[i] : by_doc[i + 1]]
        own = own[count[own] > 1]
        same = np.bincount(posting[_ranges(begin[own], count[own])], minlength=len(size))
        near = np.flatnonzero(100 * same[:i] >= 80 * (size[:i] + size[i] - same[:i]))
        for root in np.unique(label[near]).tolist():
            if root != label[i]:
                links.append((int(ids[i]), int(ids[near[np.argmax(label[near] == root)]])))
                label[label == root] = label[i]
    return links


def group_links(groups: DataFrame, sets: DataFrame, buckets: int, block: int = BLOCK_SETS) -> DataFrame:
    """Links (a, b) that span each group (head, id). A group of more than `block` sets is dealt as pairs of blocks."""
    sizes = groups.groupBy("head").agg(F.count("*").alias("m"))
    large = sizes.where(F.col("m") > block).select("head", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    placed = groups.join(large, "head", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("head", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = dealt.join(sets, "id").withColumn("g", F.pmod(F.xxhash64("head", "i", "j"), F.lit(buckets)))

    def work(table: pa.Table) -> pa.Table:
        names = [table.column(x).to_numpy() for x in ("head", "i", "j")]
        ids, bodies = table.column("id").to_numpy(), table.column("tokens")
        order = np.lexsort((ids, *names))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in names], axis=0)
        first = np.flatnonzero(new)
        found = []
        for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True):
            if b - a > 1:
                own = order[a:b]
                found += local_links(ids[own], bodies.take(own).to_pylist())
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("g").applyInArrow(work, "a long, b long")


def text_keys() -> list[F.Column]:
    """128 bits of the text, as columns t1 and t2."""
    return [F.xxhash64(text_of()).alias("t1"), F.xxhash64(F.lit(1), text_of()).alias("t2")]


def _linked(docs: DataFrame, blocks: int | None = None, fan: int = FAN, long: int = LONG) -> DataFrame:
    """(id, t1, t2, n, first) for each row of docs (doc_id, text); id: NO_ID if null. first: (none, id, t1, t2) of the first row that it is
    linked with, rows that have a doc_id first, or its own."""
    blocks = blocks or max(8, text_bytes(docs) // BLOCK_BYTES)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), *text_keys(), text_of().alias("text"))
    counts = shared_counts(rows.select("id", "text"), blocks, fan)
    mean_list, hot = _statistics(counts.where("block = -1").select("body"))
    flags = _summed(counts)
    flagged = rows.join(flags, F.col("id") == F.col("i"), "left").select("id", "t1", "t2", "text", F.coalesce("shared", F.lit(0)).alias("shared"))
    # Numbered as written, so the numbers stay: a set's node is its least row.
    all_sets = written(_sets_of(flagged).withColumn("row", F.monotonically_increasing_id()), "sets")
    own = F.struct((F.col("id") == NO_ID).alias("none"), "id", "t1", "t2")
    groups = all_sets.where("n > 0").groupBy("hi", "lo")
    first_of = F.min(own).alias("own")
    named_sets = written(groups.agg(F.min("row").alias("node"), F.max("tokens").alias("tokens"), first_of).where("tokens is not null"), "representatives")
    sets = named_sets.select(F.col("node").alias("id"), "tokens")
    lists = max(8, blocks)
    entries = written(with_heads(list_entries(sets, boundary(mean_list), hot)), "lists")
    best = centre_votes(entries).groupBy("a").agg(F.max_by("b", F.struct("v", "b")).alias("b"))
    first = written(linked_pairs(best, sets), "pairs")
    groups_left = unsettled_groups(entries, components(first), sets, hot, long)
    rest = written(group_links(groups_left, sets, 4 * lists), "pairs")
    labels = written(components(first.union(rest)), "labels")
    least = labels.join(named_sets.select("node", "own"), "node").groupBy("component").agg(F.min("own").alias("least"))
    found = labels.join(least, "component").select(F.col("node").alias("m"), "least")
    named = groups.agg(F.min("row").alias("node"), first_of).join(found, F.col("node") == F.col("m"), "left").select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.coalesce("least", "own").alias("least"))
    out = all_sets.join(named, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0), "left")
    return out.select("id", "t1", "t2", "n", F.coalesce("least", own).alias("first"))


def link_classes(docs: DataFrame, blocks: int | None = None, fan: int = FAN, long: int = LONG) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    none = F.lit(NO_ID)
    return _linked(docs, blocks, fan, long).select(F.nullif("id", none).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("first.id", none).alias("component_id"))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with one document of each linked group, the first by doc_id, nulls last. Rows of one doc_id
    and one text are one document and stay together; rows of one text without a doc_id are copies."""
    linked = _linked(docs.select("doc_id", "text")).where("struct(id = %d, id, t1, t2) <> first" % NO_ID)
    extra = written(linked.select(F.nullif("id", F.lit(NO_ID)).alias("i"), F.col("t1").alias("x1"), F.col("t2").alias("x2")).distinct(), "copies")
    t1, t2 = text_keys()
    keyed = docs.select("*", t1, t2)
    same = (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2"))
    by_id = keyed.where("doc_id is not null").join(extra.where("i is not null"), (F.col("doc_id").cast("long") == F.col("i")) & same, "left_anti")
    nameless = keyed.where("doc_id is null")
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))  # others have the empty set, which links with nothing
    once = nameless.where(worded).join(extra.where("i is null"), same, "left_anti").dropDuplicates(["t1", "t2"])
    return by_id.union(once).union(nameless.where(~worded)).select(*docs.columns)


def _statistics(stats: DataFrame) -> tuple[float, np.ndarray]:
    """Mean length of the lists that have more than one entry, and the most frequent shingles, HOT_TOKENS at most (they only order)."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                total, token, n = unpack_arrays(body)
                yield arrow_rows(token=np.concatenate([[-1, -2], token.astype(np.int64)]), n=np.concatenate([total, n]).astype(np.int64))

    table = stats.mapInArrow(opened, "token long, n long")
    totals = {r.token: r.n for r in table.where("token < 0").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    hot = table.where("token >= 0").orderBy(F.desc("n"), "token").limit(HOT_TOKENS).collect()
    return totals.get(-1, 0) / max(1, totals.get(-2, 0)), np.array([r.token for r in hot], np.int64)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
