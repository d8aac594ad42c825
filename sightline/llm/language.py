"""Operator 8: language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed by it into the fewest phrases,
each the longest match in the training text; the language that needs the fewest phrases for a normalised
length wins. Texts are parsed in pieces of PIECE characters, all pieces of a batch in step by array
operations; a piece's border ends a phrase for every language alike.

Training is a bounded sample of rows: of each language the `rows` training documents with the least crc32 of the id, those of `row_chars`
characters or fewer first, as many as have `chars` characters together (one at least). Their texts are taken whole. Everything else covers all
rows and whole texts.

Cases: `und` with score 0 for texts without a letter and null texts; ties go to the first language by name; without any labelled
row all are `und`; a null doc_id is never held out by chance: its remainder is that of the empty text; each row is judged by itself, so
repeated rows don't matter; of very long texts every piece is parsed, a text in the memory of one task; an empty table gives an empty
one; further columns are kept, but for lang_pred and lang_score, which are replaced."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import crc_remainder, read_table, schema_with

CHARS = 48_000
ROWS = 96
ROW_CHARS = 2_000
ALPHABET = 63
PIECE = 256
UNKNOWN = "und"


def automaton_moves(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions (symbol: state) of each state of the automaton of all substrings; state 0 is its start."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p != -1:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(s) == q:
                    moves[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def move_table(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """Transitions by symbols below width (states x width, -1: none)."""
    table = np.full((len(moves), width), -1, np.int32)
    for state, own in enumerate(moves):
        for s, to in own.items():
            if s < width:
                table[state, s] = to
    return table


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions (states x width, -1: none) of the automaton of all substrings; state 0 is its start."""
    return move_table(automaton_moves(symbols), width)


class CrossParser:
    """Automata of several languages, each over all letters of its own training text. A letter that a language lacks is one
    symbol that its automaton doesn't know, and everything that is no letter is one separator.

    The moves by a language's `alphabet` - 2 most frequent letters are a table, those by its other letters a sorted list."""

    def __init__(self, texts: dict[str, str], alphabet: int = ALPHABET):
        self.names = sorted(texts)
        own: list[list[str]] = []
        for name in self.names:
            counts = Counter(c for c in texts[name].lower() if c.isalpha())
            own.append(sorted(counts, key=lambda c: (-counts[c], c)))
        #: 0: a letter of no language; 1: separator.
        self.symbol = {ord(c): i + 2 for i, c in enumerate(sorted({c for letters in own for c in letters}))}
        self.kind = np.min_scalar_type(len(self.symbol) + 2)
        self.classes: np.ndarray | None = None
        self.tables, self.widths, self.locals, self.rare = [], [], [], []
        for name, letters in zip(self.names, own, strict=True):
            local = np.zeros(len(self.symbol) + 2, np.int32)
            local[1] = 1
            local[[self.symbol[ord(c)] for c in letters]] = np.arange(len(letters)) + 2
            width = min(len(letters), alphabet - 2) + 2
            moves = automaton_moves(local[self.symbols(texts[name])].tolist())
            table = move_table(moves, width)
            # A state without a move goes on from the start with a new phrase: marked by a bit.
            start = np.where(table[0] >= 0, table[0], 0)
            self.tables.append(np.where(table >= 0, table * 2, start[None, :] * 2 + 1).astype(np.int32).ravel())
            self.widths.append(width)
            self.locals.append(local)
            self.rare.append(self._rare_moves(moves, width, len(letters) + 2))

    @staticmethod
    def _rare_moves(moves: list[dict[int, int]], width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(state * size + symbol in order, state after it, state after each symbol from the start) for the symbols beyond the table."""
        if size == width:
            return None
        found = np.array(sorted((state * size + s, to) for state, own in enumerate(moves) for s, to in own.items() if s >= width), np.int64)
        return found[:, 0], found[:, 1].astype(np.int32), np.array([moves[0].get(s, 0) for s in range(size)], np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """1: separator; 0: a letter of no language; others: letters."""
        if self.classes is None:
            self.classes = np.zeros(0x3000, self.kind)
            for i in range(len(self.classes)):
                self.classes[i] = self._class(i)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.classes[np.minimum(codes, len(self.classes) - 1)]
        high = codes >= len(self.classes)
        if high.any():
            code, index = np.unique(codes[high], return_inverse=True)
            out[high] = np.array([self._class(c) for c in code.tolist()], self.kind)[index]
        # Runs of separators count as one.
        gap = out == 1
        return out[~(gap & np.concatenate([[False], gap[:-1]]))] if len(out) else out

    def _class(self, code: int) -> int:
        return self.symbol.get(code, 0) if chr(code).isalpha() else 1

    def _step(self, k: int, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """2 * state after the symbols in language k, + 1 where a new phrase begins."""
        local, width = self.locals[k][symbols], self.widths[k]
        if self.rare[k] is None:
            return self.tables[k][state * width + local]
        beyond = np.flatnonzero(local >= width)
        out = self.tables[k][state * width + np.where(local < width, local, 0)]
        if len(beyond):
            keys, after, start = self.rare[k]
            key = state[beyond].astype(np.int64) * len(start) + local[beyond]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[beyond] = np.where(keys[at] == key, after[at] * 2, start[local[beyond]] * 2 + 1)
        return out

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text by each language, letters of each text)."""
        parts = [self.symbols(t or "") for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        letters = np.array([int((p != 1).sum()) for p in parts], np.int64)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not len(owner):
            return out, letters
        blank = np.iinfo(self.kind).max
        grid = np.full(len(owner) * PIECE, blank, self.kind)
        flat, to = np.concatenate(parts), np.repeat((np.cumsum(pieces) - pieces) * PIECE - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        grid[to] = flat
        grid = grid.reshape(len(owner), PIECE)
        length = (grid != blank).sum(1)
        order = np.argsort(-length, kind="stable")
        columns, owner, length = np.ascontiguousarray(grid[order].T), owner[order], length[order]
        live = np.searchsorted(-length, -np.arange(PIECE), "left")
        for k in range(len(self.names)):
            state, count = np.zeros(len(owner), np.int32), np.ones(len(owner), np.int32)
            for i in range(PIECE):
                n = live[i]
                if not n:
                    break
                found = self._step(k, state[:n], columns[i, :n])
                count[:n] += found & 1
                state[:n] = found >> 1
            out[:, k] = np.bincount(owner, count, minlength=len(texts)).astype(np.int64)
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; score: 1 - phrases of the best / of the second, squashed to 0.5..1, or 0 for und."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        count, letters = self.phrases(texts)
        best = np.argmin(count, 1)
        ranked = np.sort(count, 1)
        second = ranked[:, min(1, ranked.shape[1] - 1)]
        share = np.where(letters > 0, second / np.maximum(1, second + ranked[:, 0]), 0.0)
        names = [self.names[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.minimum(1.0, share)


def fit(docs: DataFrame, chars: int = CHARS, rows: int = ROWS, row_chars: int = ROW_CHARS) -> CrossParser:
    """A parser of the languages of docs (doc_id, text, lang), from a bounded sample of each."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    size = F.length("text")
    row = F.struct((size > row_chars).alias("long"), F.crc32(F.concat(F.lit("fit "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"))
    # Only what orders the rows is shuffled. The first rows of each salt, then of each language: no task holds more than rows x salts of a language.
    picked = labelled.select("lang", row.alias("o"), size.alias("size")).distinct()
    for parts in (["lang", F.pmod(F.col("o.h"), F.lit(64))], ["lang"]):
        picked = picked.withColumn("r", F.row_number().over(Window.partitionBy(*parts).orderBy("o"))).where(F.col("r") <= rows).drop("r")
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("o"))
    chosen = picked.withColumn("all", before).where((F.col("all") <= chars) | (F.col("all") == F.col("size"))).select("lang", "o")
    texts: dict[str, list[str]] = {}
    for found in labelled.select("lang", row.alias("o"), "text").join(F.broadcast(chosen), ["lang", "o"]).dropDuplicates(["lang", "o"]).orderBy("lang", "o").collect():  # chars of each language, or one row
        texts.setdefault(found.lang, []).append(found.text)
    return CrossParser({k: "\n".join(v) for k, v in texts.items()})


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """docs with lang_pred and lang_score added."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    added = ["lang_pred", "lang_score"]
    docs = docs.drop(*added)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                names, scores = shared.value.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, *added])

    return docs.mapInArrow(predict, schema_with(docs, {"lang_pred": "string", "lang_score": "double"}))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_remainder(4) == 2
    parser = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), parser).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
