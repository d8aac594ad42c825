"""Operator 7: toxicity of texts restored by a noisy-channel decoder.

A token that looks obfuscated (digits or symbols before, among or after letters, a letter three times in a row, letters
spaced out one by one) is a lattice: each byte may be itself, the letters it can stand for, or nothing where it
repeats its neighbour or separates letters. Viterbi decoding under a trigram language model of bytes finds the likeliest
word. The score is a noisy-or over the features of the restored text (words, and their first 4 and 6 bytes), each with
the lower Wilson bound of the share of toxic documents among the training documents that hold it.

A feature counts if chance doesn't explain its toxic documents: n documents of which the share q is toxic, at a base rate of p, must have
n * KL(q, p) above the logarithm of the number of features looked at.

Model and features are fitted on every labelled training document, less most of their near copies, so that a copied text counts about
once. Scoring covers every row and whole text.

Cases: null and empty texts get a tenth of the base rate; without labels every score is 0; a document with several labels counts as toxic if one
says so; null labels are ignored; each row is scored by itself, so repeated rows and equal ids don't matter; of very long texts every word is
looked at, a text in the memory of one task; words that tie in the decoder go to the last by bytes; an empty table gives an empty one; further
columns are kept out of the score, and toxic_score and toxic_predicted are replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import BYTE_POWERS, BYTE_TABLE, LOWER, SPACE, U64, Words, arrow_rows, as_signed, crc_remainder, gram_hash, mix, per_chunk, read_table, schema_with, settled, text_of, written

LEAST_TOXIC = 3
LEAST_SHARE = 0.3
WILSON_Z = 3.0
PREFIXES = (4, 6)
THRESHOLD = 0.3
CACHE = 200_000
#: Features of documents that a task adds up before it passes them on.
HELD = 1 << 22
SIGNATURES = 3
#: What a sign may stand for.
LEET = {b"0": b"o", b"1": b"il", b"3": b"e", b"4": b"a", b"5": b"s", b"7": b"t", b"8": b"b", b"9": b"g", b"@": b"a", b"$": b"s", b"!": b"i", b"|": b"il", b"+": b"t", b"(": b"c"}
SIGNS = np.zeros(256, bool)
SIGNS[[k[0] for k in LEET]] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
SEPARATORS = b".-_*~'`^,"
EDGES = b".,;:!?\"'()[]{}*#$%&|-_<>=+~`^"
#: Punctuation that stands for no letter, and signs that may be either at the ends of a token.
PLAIN, BOTH = b".,;:?\"')[]{}*#%&-_<>=~`^", b"!|+("
STRIP = np.zeros(256, bool)
STRIP[list(EDGES)] = True
CLASSES = np.zeros(256, np.int64)
CLASSES[97:123] = np.arange(1, 27)
CLASSES[128:] = 27 + np.arange(128) % 37
SWAP, DROP = -1.5, -0.7  # log10 prices of the channel


class Restorer:
    """Viterbi decoding under trigram counts of byte classes (64 x 64 x 64)."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(64, 64, 64).astype(np.float64) + 0.05
        self.price = np.log10(n / n.sum(2, keepdims=True)).astype(np.float32)
        self.known: dict[bytes, bytes] = {}

    def restore(self, token: bytes) -> bytes:
        """The likeliest word behind a token (lower case, without punctuation at its ends)."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[token] = self._decode(token)
        return found

    def _decode(self, token: bytes) -> bytes:
        states: dict[tuple[int, int], tuple[float, bytes]] = {(0, 0): (0.0, b"")}
        for i, byte in enumerate(token):
            one = bytes([byte])
            options = [(one, 0.0)] if LETTER[byte] else [(bytes([c]), SWAP if len(LEET[one]) > 1 else SWAP / 2) for c in LEET[one]] if one in LEET else []
            drop = DROP if (i and token[i - 1] == byte) else 0.0 if byte in SEPARATORS else None if options else 0.0
            after: dict[tuple[int, int], tuple[float, bytes]] = {}
            for (a, b), (p, text) in states.items():
                if drop is not None and p + drop > after.get((a, b), (-1e9, b""))[0]:
                    after[a, b] = (p + drop, text)
                for c, price in options:
                    k = int(CLASSES[c[0]])
                    q = p + price + float(self.price[a, b, k])
                    if q > after.get((b, k), (-1e9, b""))[0]:
                        after[b, k] = (q, text + c)
            states = after
        ends = [(p + float(self.price[a, b, 0]), text) for (a, b), (p, text) in states.items()]
        return max(ends, key=lambda x: (x[0], x[1]))[1]


def readings(token: bytes) -> set[bytes]:
    """The token without plain punctuation at its ends, and with signs at either end as punctuation instead of letters."""
    whole = token.strip(PLAIN)
    left = whole.lstrip(BOTH)
    return {whole, left, whole.rstrip(BOTH), left.rstrip(BOTH)}


def suspicious(raw: np.ndarray, words: Words) -> list[tuple[int, bytes]]:
    """(document, token) of what looks obfuscated; raw is in lower case. Runs of three and more single signs are one token."""
    n = len(raw)
    out: list[tuple[int, bytes]] = []
    if n < 3 or not len(words):
        return out
    letter, sign = LETTER[raw], SIGNS[raw] | np.isin(raw, np.frombuffer(SEPARATORS, np.uint8))
    odd = np.zeros(n, bool)
    odd[:-1] |= sign[:-1] & letter[1:]
    odd[1:] |= SIGNS[raw[1:]] & letter[:-1]  # signs that run to the end of a token, as in a$$
    odd[2:] |= letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
    total = np.concatenate([[0], np.cumsum(odd)])
    for i in np.flatnonzero(total[words.end] > total[words.start]).tolist():
        token = raw[words.start[i] : words.end[i]].tobytes()
        out += [(int(words.doc[i]), t) for t in sorted(readings(token))]
    single = (words.end - words.start == 1) & (letter | SIGNS[raw])[words.start]
    if single.any():
        edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            for d in range(int(words.doc[a]), int(words.doc[b - 1]) + 1):
                x, y = max(a, int(words.first[d])), min(b, int(words.first[d + 1]))
                if y - x >= 3:
                    out.append((d, raw[words.start[x:y]].tobytes()))
    return out


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    up, down = BYTE_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_TABLE[data] * up[: len(data)], out=total[1:])
    return np.concatenate([mix((total[np.minimum(end, start + k)] - total[start]) * down[start] + (np.minimum(end, start + k) - start).astype(U64) + U64(salt * k)) for k in (*PREFIXES, len(data) + 1)])


def features(data: np.ndarray, offsets: np.ndarray, restorer: Restorer | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all words of a run of texts, restored ones too; features are 64-bit hashes."""
    raw = LOWER[data]
    clean = raw.copy()
    clean[STRIP[clean]] = 32
    words = Words(clean, offsets, hashes=False)
    docs, found = [np.tile(words.doc, 1 + len(PREFIXES))], [_hashes(clean, words.start, words.end, 1)[: len(words) * len(PREFIXES)]]
    whole = Words(clean, offsets)
    found.append(whole.hash)
    if restorer is not None:
        again = [(d, restorer.restore(t)) for d, t in suspicious(raw, Words(raw, offsets, hashes=False)) if t]
        again = [(d, t) for d, t in again if t]
        if again:
            text = np.frombuffer(b" ".join(t for _, t in again), np.uint8)
            own = Words(text, np.array([0, len(text)]))
            if len(own) != len(again):
                raise ValueError("a restored word holds a blank")
            docs.append(np.tile(np.array([d for d, _ in again]), 1 + len(PREFIXES)))
            found += [_hashes(text, own.start, own.end, 1)[: len(own) * len(PREFIXES)], own.hash]
    return np.concatenate(docs), np.concatenate(found)


class ToxicModel:
    def __init__(self, restorer: Restorer, keys: np.ndarray, shares: np.ndarray, base: float):
        order = np.argsort(keys)
        self.restorer, self.keys, self.shares, self.base = restorer, keys[order], shares[order], base
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U64(44)).astype(np.int64)] = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, feature = features(data, offsets, self.restorer)
        rest = np.full(n, np.log1p(-min(self.base, 0.999999)))
        if len(self.keys):
            near = self.seen[(feature >> U64(44)).astype(np.int64)]
            doc, feature = doc[near], feature[near]
            at = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1)
            hit = self.keys[at] == feature
            pair = np.unique(np.column_stack([doc[hit], at[hit]]), axis=0)
            rest += np.bincount(pair[:, 0], np.log1p(-self.shares[pair[:, 1]]), minlength=n)
        return -np.expm1(rest)


def lower_share(toxic: np.ndarray, clean: np.ndarray, z: float = WILSON_Z) -> np.ndarray:
    n = toxic + clean
    p = toxic / n
    return np.minimum((p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0.999)


def beyond_chance(toxic: np.ndarray, clean: np.ndarray, base: float, tried: int) -> np.ndarray:
    """Whether features with so many toxic and clean documents are above what `tried` features at a base rate show by chance."""
    n, p = toxic + clean, min(max(base, 1e-6), 1 - 1e-6)
    q = toxic / n
    part = lambda x, y: x * np.log(np.maximum(x, 1e-12) / y)
    return (q > p) & (n * (part(q, p) + part(1 - q, 1 - p)) >= np.log(max(tried, 2)))


def distinct_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id) of those of docs (doc_id, text) that are in known (doc_id), without most copies and near copies, whose words would count as often as they do: of
    rows that agree in one of SIGNATURES min-hashes of their 3-word shingles the one with the least id stays."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in per_chunk(batches):
            words = Words(data, offsets, lower=True)
            grams = gram_hash(words.hash, 3)
            at = np.minimum(words.first, len(grams))
            out = []
            for k in range(SIGNATURES):
                h = np.append(mix(grams + U64(k + 1)), U64(0))
                own = np.minimum.reduceat(h, np.minimum(at[:-1], len(h) - 1)) if batch.num_rows else h
                out.append(np.where(np.diff(at) > 0, own, mix(batch.column("doc_id").fill_null(0).to_numpy().view(U64))))
            yield arrow_rows(doc_id=batch.column("doc_id"), **{f"s{k}": as_signed(x) for k, x in enumerate(out)})

    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, " + ", ".join(f"s{k} long" for k in range(SIGNATURES)))
    signed = signed.join(known.select("doc_id"), "doc_id")
    each = signed.select("doc_id", F.posexplode(F.array(*[f"s{k}" for k in range(SIGNATURES)])).alias("k", "s"))
    least = each.groupBy("k", "s").agg(F.min("doc_id").alias("doc_id"))  # adds up before the shuffle, so a large group of copies is a row from each task
    return least.groupBy("doc_id").agg(F.count_distinct("k").alias("n")).where(F.col("n") == SIGNATURES).select("doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of all labelled documents. Their texts are shuffled once, to meet their labels."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    docs = docs.select("doc_id", text_of().alias("text"))
    single = written(known.join(distinct_documents(docs, known), "doc_id", "left_semi"), "labelled")
    train = docs.join(single.hint("merge"), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, keys, held, n = np.zeros(1 << 18, np.int64), [], 0, np.zeros(2, np.int64)

        def summed() -> pa.RecordBatch:
            key, inverse = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
            is_toxic = np.concatenate([t for _, t in keys])
            yes, no = np.bincount(inverse[is_toxic], minlength=len(key)), np.bincount(inverse[~is_toxic], minlength=len(key))
            return arrow_rows(kind=np.ones(len(key), np.int32), key=as_signed(key), toxic=yes.astype(np.int64), clean=no.astype(np.int64))

        for batch, data, offsets in per_chunk(batches):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            n += [toxic.sum(), (~toxic).sum()]
            kind = CLASSES[LOWER[data]]
            if len(kind) > 2:
                grams += np.bincount((kind[:-2] * 64 + kind[1:-1]) * 64 + kind[2:], minlength=1 << 18)
            doc, feature = features(data, offsets, None)
            pair = np.unique(np.column_stack([feature, doc.astype(U64)]), axis=0)
            keys.append((pair[:, 0], toxic[pair[:, 1].astype(np.int64)]))
            held += len(pair)
            if held >= HELD:
                yield summed()
                keys, held = [], 0
        at = np.flatnonzero(grams)
        yield arrow_rows(kind=np.zeros(len(at), np.int32), key=at.astype(np.int64), toxic=grams[at], clean=np.zeros(len(at), np.int64))
        yield arrow_rows(kind=np.array([2], np.int32), key=np.array([0], np.int64), toxic=n[:1], clean=n[1:])
        if keys:
            yield summed()

    counted = train.mapInArrow(count, "kind int, key long, toxic long, clean long").groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = settled(counted.where((F.col("kind") != 1) | (F.col("toxic") >= LEAST_TOXIC)))
    tried = often.where("kind = 1").count()
    total = often.where("kind = 2").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()  # one row
    n_toxic, n_all = total.toxic or 0, (total.toxic or 0) + (total.clean or 0)
    base = n_toxic / max(1, n_all)
    # What can be in the model goes to the driver: words of which chance doesn't explain the toxic documents; lower_share and beyond_chance decide.
    p, n = min(max(base, 1e-6), 1 - 1e-6), F.col("toxic") + F.col("clean")
    q = F.col("toxic") / n
    apart = F.col("toxic") * F.log(q / p) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - q) / (1 - p))).otherwise(0.0)
    found = often.where((F.col("kind") == 0) | ((F.col("kind") == 1) & (q > LEAST_SHARE) & (apart >= 0.999 * float(np.log(max(tried, 2)))))).toPandas()
    grams = np.zeros(1 << 18, np.int64)
    own = found[found.kind == 0]
    grams[own.key.to_numpy()] = own.toxic.to_numpy()
    words = found[found.kind == 1]
    shares = lower_share(words.toxic.to_numpy(np.float64), words.clean.to_numpy(np.float64)) if len(words) else np.zeros(0)
    keep = shares >= LEAST_SHARE
    if len(words):
        keep &= beyond_chance(words.toxic.to_numpy(np.float64), words.clean.to_numpy(np.float64), base, tried)
    return ToxicModel(Restorer(grams), words.key.to_numpy(np.int64)[keep].view(U64), shares[keep], 0.1 * base)


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs (with text) and columns toxic_score, toxic_predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"toxic_score": "double", "toxic_predicted": "int"}
    docs = docs.drop(*added)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in per_chunk(batches):
            scores = shared.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names, *added])

    return docs.mapInArrow(score, schema_with(docs, added))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(4) == 2
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out).select("doc_id", "text"), labels.where(~held_out))
    rows = docs.select("doc_id", text_of().alias("text"), held_out.alias("held_out"))
    return score_toxicity(rows, model).select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
