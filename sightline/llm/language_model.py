"""Operator 2: Brown class-based bigram scores.

1. Words are counted over all training documents, in blocks of their hashes.
2. The MEMBERS most frequent words, the core, are put into CLASSES classes by exchange clustering on their bigram counts over
   all training text (its size is bounded by MEMBERS, not by the corpus).
3. Every other word that occurs LEAST times or more joins the class that an exchange step gives it: the counts of the classes before
   and after it, gathered over all training text in the block of its hash, against the core's class bigrams.
4. Rarer words and unseen ones belong to one of SHAPES classes by their last two bytes; the end of a text is a class of its own.
5. Each document becomes its sequence of classes. The most frequent words, TABLE at most, are known to every task; for others the
   block of their hash answers with class and count. Class bigrams are counted from the sequences of all training documents.

    P(w | v) = L * P(class w | class v) * (c(w) + 1) / (N_class + V_class + u) + (1 - L) * (c(w) + 1) / (N + V + 1)

u is 1 for shape classes, which hold the unseen words, else 0. The transition is smoothed by the class's share.

Blocks, words and counts grow with the corpus. A task that runs again must see its rows in the same order, as a table scan gives
them: rows are named by partition and place.

Cases: null or empty texts are the end token alone; an empty training set gives c = 0 throughout, an empty table no rows; each row is scored
by itself, so repeated ids and rows don't matter; of very long texts every token is scored, a text in the memory of one task;
words that tie in frequency are ranked by their hash; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import FAN, U64, Steps, Words, arrow_rows, block_of, crc_remainder, deal_widths, dealt_on, merged, pack_arrays, packed_runs, per_chunk, read_table, text_bytes, text_of, unpack_arrays, written

MEMBERS = 2048
CLASSES = 64
SHAPES = 64
TABLE = 131_072
LEAST = 3
EXCHANGES = 4
MIX = 0.95
SMOOTHING = 5.0
FLUSH_BYTES = 24 << 20
BLOCK_BYTES = 24 << 20
BIGRAM_BLOCKS = 64
END = np.uint64(0x452821E638D01377)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, document) of the tokens of a run of texts, an end after each."""
    words = Words(data, offsets, lower=True)
    last = words.data[words.end - 1].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    before = np.where(words.end - words.start > 1, words.data[words.end - 2], 0).astype(np.int64) if len(words) else last
    shape = (before * 31 + last * 7) % 251 % SHAPES
    n = len(offsets) - 1
    at = words.first[1:]
    return np.insert(words.hash, at, END), np.insert(shape.astype(np.uint8), at, 0), np.insert(words.doc, at, np.arange(n))


def in_runs(batches: Iterator[pa.RecordBatch], part, send) -> Iterator[pa.RecordBatch]:
    """send(parts) for runs of about FLUSH_BYTES of text, part(batch, data, offsets) of each piece of them."""
    parts, size = [], 0
    for batch, data, offsets in per_chunk(batches):
        parts.append(part(batch, data, offsets))
        size += len(data)
        if size >= FLUSH_BYTES:
            yield send(parts)
            parts, size = [], 0
    if parts:
        yield send(parts)


def word_counts(docs: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """(block, body): hashes (sorted), counts and shapes of a block's words."""
    widths = deal_widths(blocks, fan)

    def streams(key: np.ndarray, n: np.ndarray, shape: np.ndarray, width: int) -> list:
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        return [(block_of(key, blocks) // width, [key, np.bincount(inverse, n).astype(np.int64), shape[first]])]

    def send(parts: list) -> pa.RecordBatch:
        key, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
        return packed_runs(*streams(key, np.ones(len(key)), shape, widths[0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_runs(batches, lambda _, data, offsets: tokens(data, offsets)[:2], send)

    def add(table: pa.Table) -> pa.Table:
        keys, counts, shapes = merged(table.column("body").to_pylist())
        key, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        n, shape = np.bincount(inverse, counts).astype(np.int64), shapes[first]
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int64()), "body": pa.array([pack_arrays(key, n, shape)], pa.binary())})

    dealt = dealt_on(docs.mapInArrow(count, "block long, body binary"), widths, lambda bodies, width: streams(*merged(bodies), width), FLUSH_BYTES)
    return dealt.groupBy("block").applyInArrow(add, "block long, body binary")


class Symbols:
    """The words that every task knows, with their counts. Symbol numbers of tokens: members 0.., then shapes, then the end."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, members: int = MEMBERS):
        rank = np.lexsort((keys, -counts))
        keys, counts = keys[rank], counts[rank]
        ordinary = np.flatnonzero(keys != END)[:members]
        member = np.full(len(keys), -1, np.int64)
        member[ordinary] = np.arange(len(ordinary))
        order = np.argsort(keys)
        self.keys, self.counts, self.member = keys[order], counts[order], member[order]
        self.members = len(ordinary)
        self.size = self.members + SHAPES + 1

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether it is there) of each key."""
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def of(self, key: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Symbols."""
        symbol = self.members + shape.astype(np.int64)
        if len(self.keys):
            at, hit = self.find(key)
            own = self.member[at]
            symbol = np.where(hit & (own >= 0), own, symbol)
        symbol[key == END] = self.size - 1
        return symbol


def bigram_counts(docs: DataFrame, symbols: Symbols, blocks: int = BIGRAM_BLOCKS) -> np.ndarray:
    """Counts of neighbouring symbols (size x size), a text's first token following the end."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    size = symbols.size

    def part(_, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        symbol = shared.value.of(*tokens(data, offsets)[:2])
        return np.concatenate([[size - 1], symbol[:-1]]) * size + symbol

    def send(parts: list) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(parts), return_counts=True)
        return packed_runs((code % blocks, [code.astype(np.uint32), n.astype(np.uint32)]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_runs(batches, part, send)

    def add(table: pa.Table) -> pa.Table:
        codes, counts = merged(table.column("body").to_pylist())
        code, inverse = np.unique(codes, return_inverse=True)
        return pa.table({"body": pa.array([pack_arrays(code, np.bincount(inverse, counts).astype(np.int64))], pa.binary())})

    out = np.zeros(size * size, np.int64)
    for row in docs.mapInArrow(count, "block long, body binary").groupBy("block").applyInArrow(add, "body binary").toLocalIterator():
        code, n = unpack_arrays(bytes(row.body))
        out[code] += n
    return out.reshape(size, size)


def exchange(counts: np.ndarray, members: int, classes: int = CLASSES, rounds: int = EXCHANGES) -> np.ndarray:
    """The class of each symbol. Members start by rank; each in turn moves to the class that raises the class bigrams' likelihood most."""
    size = len(counts)
    k = min(classes, max(1, members))
    group = np.concatenate([np.arange(members) % k, k + np.arange(size - members)])
    total = k + size - members
    table = np.zeros((total, total))
    rows = np.zeros((total, size))
    np.add.at(rows, group, counts)
    np.add.at(table.T, group, rows.T)

    def f(x):
        return x * np.log(np.maximum(x, 1e-12))

    own = counts.sum(1).astype(np.float64)
    for _ in range(rounds):
        moved = 0
        for w in range(members):
            if not own[w] and not counts[:, w].any():
                continue
            a = group[w]
            after = np.bincount(group, counts[w], minlength=total)
            before = np.bincount(group, counts[:, w], minlength=total)
            self_ = counts[w, w]
            after[a] -= self_
            before[a] -= self_
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= self_
            part, column, out_, in_ = table[:k], table[:, :k], table.sum(1)[:k], table.sum(0)[:k]
            gain = (f(part + after) - f(part)).sum(1) + (f(column + before[:, None]) - f(column)).sum(0)
            own_at = np.arange(k)
            corner = table[own_at, own_at]
            gain += f(corner + after[:k] + before[:k] + self_) - f(corner + after[:k]) - f(corner + before[:k]) + f(corner)
            n_out, n_in = after.sum() + self_, before.sum() + self_
            gain -= f(out_ + n_out) - f(out_) + f(in_ + n_in) - f(in_)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            group[w] = b
            table[b] += after
            table[:, b] += before
            table[b, b] += self_
        if not moved:
            break
    return group


def joining_gains(bigrams: np.ndarray, group: np.ndarray, classes: int) -> np.ndarray:
    """(2 * groups x classes): what one token after (first half) or before it (second half), of each group, says for each class."""
    total = int(group.max()) + 1
    table = np.full((total, total), 0.5)
    np.add.at(table, (group[:, None], group[None, :]), bigrams)
    out, in_ = table.sum(1), table.sum(0)
    mutual = np.log(table) - np.log(out)[:, None] - np.log(in_)[None, :]
    return np.vstack([mutual[:classes].T, mutual[:, :classes]])


def word_classes(docs: DataFrame, counted: DataFrame, symbols: Symbols, group: np.ndarray, bigrams: np.ndarray, blocks: int, least: int = LEAST, fan: int = FAN) -> DataFrame:
    """(block, body, known): hashes, counts and classes of a block's words; known: the same of those in the table."""
    shared = docs.sparkSession.sparkContext.broadcast((symbols, group))
    widths, members, total = deal_widths(blocks, fan), symbols.members, int(group.max()) + 1
    classes = int(group[:members].max()) + 1 if members else 0
    gains = joining_gains(bigrams, group, classes)

    def streams(key: np.ndarray, code: np.ndarray, n: np.ndarray, width: int) -> list:
        order = np.lexsort((code, key))
        key, code, n = key[order], code[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        n = np.add.reduceat(n, first) if len(first) else n
        return [(block_of(key[first], blocks) // width, [key[first], code[first].astype(np.uint16), n.astype(np.uint32)])]

    def part(_, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, group = shared.value
        key, shape, _ = tokens(data, offsets)
        symbol = symbols.of(key, shape)
        own = group[symbol]
        at = np.flatnonzero((symbol >= members) & (key != END))
        before = own[at - 1]  # the first token follows the end, which stands last
        return np.concatenate([key[at], key[at]]), np.concatenate([own[at + 1], total + before])

    def send(parts: list) -> pa.RecordBatch:
        key, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        return packed_runs(*streams(key, code, np.ones(len(key), np.int64), widths[0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_runs(batches, part, send)

    def choose(table: pa.Table) -> pa.Table:
        symbols, group = shared.value
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        words = [b for k, b in zip(kinds, bodies, strict=True) if k == 0]
        if not words:
            return pa.table({"block": pa.array([], pa.int64()), "body": pa.array([], pa.binary()), "known": pa.array([], pa.binary())})
        key, n, shape = unpack_arrays(words[0])
        found = group[symbols.of(key, shape)]
        heard = [b for k, b in zip(kinds, bodies, strict=True) if k != 0]
        if heard and classes:
            who, code, times = merged(heard)
            at = np.searchsorted(key, who)
            order = np.argsort(at, kind="stable")
            at, code, times = at[order], code[order].astype(np.int64), times[order]
            free = (n >= least) & (symbols.of(key, shape) >= members) & (key != END)
            for a in range(0, len(key), 8192):
                b = min(a + 8192, len(key))
                i, j = np.searchsorted(at, [a, b])
                counts = np.bincount((at[i:j] - a) * 2 * total + code[i:j], times[i:j], minlength=(b - a) * 2 * total).reshape(b - a, 2 * total)
                best = np.argmax(counts @ gains, axis=1)
                found[a:b] = np.where(free[a:b], best, found[a:b])
        at, hit = symbols.find(key)
        found = found.astype(np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int64()), "body": pa.array([pack_arrays(key, n, found)], pa.binary()), "known": pa.array([pack_arrays(at[hit], n[hit], found[hit])], pa.binary())})

    contexts = dealt_on(docs.mapInArrow(count, "block long, body binary"), widths, lambda bodies, width: streams(*merged(bodies), width), FLUSH_BYTES)
    both = contexts.withColumn("kind", F.lit(2)).unionByName(counted.withColumn("kind", F.lit(0)))
    return both.groupBy("block").applyInArrow(choose, "block long, body binary, known binary")


class ClassModel:
    """What scoring needs: the table's words with counts and classes, and the words of each class."""

    def __init__(self, symbols: Symbols, table_class: np.ndarray, end: int, shapes: int, n_class: np.ndarray, v_class: np.ndarray):
        self.symbols, self.table_class, self.end, self.shapes, self.n, self.v = symbols, table_class, end, shapes, n_class, v_class
        self.tokens, self.distinct = int(n_class.sum()), int(v_class.sum())
        self.price: np.ndarray | None = None

    def fit_transitions(self, bigrams: np.ndarray) -> None:
        """Prices from counts of neighbouring classes; a class without words has no price of its own and takes the general part alone."""
        share = (bigrams.sum(0) + 1) / (bigrams.sum() + len(bigrams))
        transition = (bigrams + SMOOTHING * share) / (bigrams.sum(1, keepdims=True) + SMOOTHING)
        words = (self.n + self.v).astype(np.float64)
        words[self.shapes : self.shapes + SHAPES] += 1
        own = np.divide(MIX * transition, words[None, :], out=np.zeros_like(transition), where=words[None, :] > 0)
        self.price = np.log10(own + (1 - MIX) / (self.tokens + self.distinct + 1))


def fit(docs: DataFrame, blocks: int | None = None, fan: int = FAN, members: int = MEMBERS, table: int = TABLE) -> tuple[ClassModel, DataFrame]:
    """(model without transitions, classes of the words by block) of training docs (text)."""
    blocks = blocks or max(4, text_bytes(docs) // BLOCK_BYTES)
    rows = docs.select(text_of().alias("text"))
    counted = written(word_counts(rows, blocks, fan), "words")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                n, words_ = np.unique(unpack_arrays(body)[1], return_counts=True)
                yield arrow_rows(n=n, words=words_)

    # The words of the table are those of the count from which on there are at most `table` of them.
    tallies = counted.select("body").mapInArrow(tally, "n long, words long").groupBy("n").agg(F.sum("words").alias("words")).toPandas().sort_values("n", ascending=False)
    enough = tallies[tallies.words.cumsum() <= table]
    limit = int(enough.n.min()) if len(enough) else 1 << 62

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                key, n, _ = unpack_arrays(body)
                yield arrow_rows(key=key[n >= limit].view(np.int64), n=n[n >= limit])

    top = counted.select("body").mapInArrow(frequent, "key long, n long").toPandas()
    symbols = Symbols(top.key.to_numpy(np.int64).view(U64), top.n.to_numpy(np.int64), members)
    bigrams = bigram_counts(rows, symbols)
    group = exchange(bigrams, symbols.members)
    classed = written(word_classes(rows, counted, symbols, group, bigrams, blocks, fan=fan), "classes")

    def of_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, known in zip(batch.column("body").to_pylist(), batch.column("known").to_pylist(), strict=True):
                _, n, own = unpack_arrays(body)
                at, _, mine = unpack_arrays(known)
                yield arrow_rows(place=np.full(256, -1), own=np.arange(256), n=np.bincount(own, n, minlength=256).astype(np.int64), v=np.bincount(own, minlength=256))
                if len(at):
                    yield arrow_rows(place=at, own=mine.astype(np.int64), n=np.zeros(len(at), np.int64), v=np.zeros(len(at), np.int64))

    total = int(group.max()) + 1
    sums = classed.select("body", "known").mapInArrow(of_classes, "place long, own long, n long, v long").groupBy("place", "own").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # the table and 256 rows
    n_class, v_class, table_class = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(len(symbols.keys), np.uint8)
    by_class, by_word = sums[(sums.place < 0) & (sums.own < total)], sums[sums.place >= 0]
    n_class[by_class.own.to_numpy()], v_class[by_class.own.to_numpy()] = by_class.n.to_numpy(), by_class.v.to_numpy()
    table_class[by_word.place.to_numpy()] = by_word.own.to_numpy()
    return ClassModel(symbols, table_class, int(group[-1]), int(group[symbols.members]), n_class, v_class), classed.select("block", "body")


def class_sequences(docs: DataFrame, model: ClassModel, classed: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """(id, held_out, n_tokens, n_known, log, classes) of docs (doc_id, text, held_out): log: sum of log10(count + 1); classes: one byte a token."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    widths = deal_widths(blocks, fan)

    def asked(row: np.ndarray, place: np.ndarray, key: np.ndarray, width: int) -> list:
        return [(block_of(key, blocks) // width, [Steps(row), Steps(place), key])]

    def mine(row: np.ndarray, doc_id: np.ndarray, held: np.ndarray, n: np.ndarray, known: np.ndarray, log: np.ndarray, own: np.ndarray, width: int) -> list:
        to = block_of(row.view(U64), blocks) // width
        return [(to, [Steps(row), Steps(doc_id), held, Steps(n), Steps(known), log]), (np.repeat(to, n), [own])]

    def answers(row: np.ndarray, place: np.ndarray, own: np.ndarray, n: np.ndarray, width: int) -> list:
        return [(block_of(row.view(U64), blocks) // width, [Steps(row), Steps(place), own, Steps(n)])]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at_row = shared.value, TaskContext.get().partitionId() << 36

        def part(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple:
            nonlocal at_row
            key, shape, doc = tokens(data, offsets)
            at, hit = model.symbols.find(key)
            count = np.where(hit, model.symbols.counts[at], 0) if len(model.symbols.keys) else np.zeros(len(key), np.int64)
            k = batch.num_rows
            row = at_row + np.arange(k)
            at_row += k
            n = np.bincount(doc, minlength=k).astype(np.int64)
            place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            hole = ~hit
            # What a block cannot tell: the shape class of a word that no training document holds.
            own = np.where(key == END, model.end, model.shapes + shape.astype(np.int64))
            if len(model.symbols.keys):
                own = np.where(hit, model.table_class[at], own)
            own = own.astype(np.uint8)
            return row, batch.column("id").to_numpy(zero_copy_only=False), batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.int8), n, np.bincount(doc, count > 0, minlength=k).astype(np.int64), np.bincount(doc, np.log10(count + 1.0), minlength=k), own, row[doc[hole]], place[hole], key[hole]

        def send(parts: list) -> pa.RecordBatch:
            *rows, own, row, place, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            questions, own_rows = packed_runs(*asked(row, place, key, widths[0])), packed_runs(*mine(*rows, own, widths[0]))
            return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(questions.columns, own_rows.columns, strict=True)] + [pa.array([1] * questions.num_rows + [2] * own_rows.num_rows, pa.int32())], names=["block", "body", "kind"])

        return in_runs(batches, part, send)

    def look_up(table: pa.Table) -> pa.Table:
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        questions = [b for k, b in zip(kinds, bodies, strict=True) if k == 1]
        words = [b for k, b in zip(kinds, bodies, strict=True) if k == 0]
        if not questions or not words:
            return pa.table({"block": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
        row, place, key = merged(questions)
        keys, counts, classes = unpack_arrays(words[0])
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        hit = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
        hit = hit[np.lexsort((place[hit], row[hit]))]
        return pa.Table.from_batches([packed_runs(*answers(row[hit], place[hit], classes[at[hit]], counts[at[hit]], widths[0]))])

    def join(table: pa.Table) -> pa.Table:
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        rows = [b for k, b in zip(kinds, bodies, strict=True) if k == 2]
        if not rows:
            return out_schema.empty_table()
        row, doc_id, held, n, known, log, own = merged(rows)
        own, log, known = own.copy(), log.copy(), known.copy()
        start = np.cumsum(n) - n
        heard = [b for k, b in zip(kinds, bodies, strict=True) if k != 2]
        if heard:
            who, place, classes, counts = merged(heard)
            order = np.argsort(row)
            at = order[np.searchsorted(row[order], who)]
            own[start[at] + place] = classes
            log += np.bincount(at, np.log10(counts + 1.0), minlength=len(row))
            known += np.bincount(at, minlength=len(row))
        whole = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(start, n.sum()).astype(np.int64)), pa.py_buffer(own)])
        return pa.table([doc_id, held == 1, n, known, log, whole.cast(pa.binary())], schema=out_schema)

    out_schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log", pa.float64()), ("classes", pa.binary())])
    none = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("id"), text_of().alias("text"), "held_out")
    sent = rows.mapInArrow(first, "block long, body binary, kind int")
    if len(widths) > 1:
        sent = written(sent, "sequences")

    def of_kind(kind: int) -> DataFrame:
        return sent.where(F.col("kind") == kind).select("block", "body")

    def dealt(rows: DataFrame, streams) -> DataFrame:
        return dealt_on(rows, widths, lambda bodies, width: streams(*merged(bodies), width), FLUSH_BYTES)

    if len(widths) > 1:
        sent = dealt(of_kind(1), asked).withColumn("kind", F.lit(1)).unionByName(dealt(of_kind(2), mine).withColumn("kind", F.lit(2)))
    replies = sent.where("kind = 1").unionByName(classed.withColumn("kind", F.lit(0))).groupBy("block").applyInArrow(look_up, "block long, body binary")
    together = sent.where("kind = 2").unionByName(dealt(replies, answers).withColumn("kind", F.lit(3)))
    return together.groupBy("block").applyInArrow(join, "id long, held_out boolean, n_tokens long, n_known long, log double, classes binary")


def _neighbours(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, row) of the tokens of class sequences."""
    bodies = batch.column("classes").to_pylist()
    own = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64)
    n = np.fromiter(map(len, bodies), np.int64, len(bodies))
    before = np.concatenate([[end], own[:-1]])
    before[(np.cumsum(n) - n)[n > 0]] = end
    return before, own, np.repeat(np.arange(len(bodies)), n)


def class_bigrams(sequences: DataFrame, model: ClassModel) -> np.ndarray:
    """Counts of neighbouring classes in training documents: a table of fixed size from each task, added up."""
    total, end = len(model.n), model.end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total * total, np.int64)
        for batch in batches:
            if batch.num_rows:
                before, own, _ = _neighbours(batch, end)
                out += np.bincount(before * total + own, minlength=total * total)
        at = np.flatnonzero(out)
        yield arrow_rows(code=at, n=out[at])

    sums = sequences.where("not held_out").select("classes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(total * total, np.int64)
    out[sums.code.to_numpy(np.int64)] = sums.n.to_numpy(np.int64)
    return out.reshape(total, total)


def score(docs: DataFrame, model: ClassModel, classed: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text, held_out), those not held out being
    the training documents, whose class bigrams complete the model."""
    sequences = written(class_sequences(docs, model, classed, blocks, fan), "sequences")
    model.fit_transitions(class_bigrams(sequences, model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_train, distinct = model.tokens, model.distinct

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                before, own, row = _neighbours(batch, model.end)
                n, log = batch.column("n_tokens").to_numpy(), batch.column("log").to_numpy()
                found = np.bincount(row, model.price[before, own], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "held_out", "n_tokens", "n_known")), pa.array(log - n * np.log10(n_train + distinct + 1)), pa.array(log + found)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = sequences.mapInArrow(price, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.nullif("id", F.lit(-(1 << 63))).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op2_class_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(7) == 2
    blocks = max(4, text_bytes(docs) // BLOCK_BYTES)
    model, classed = fit(docs.where(~held_out), blocks)
    return score(docs.withColumn("held_out", held_out), model, classed, blocks)
