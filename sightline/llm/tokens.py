"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

A byte-level BPE never merges over the borders of its pre-tokens. A single blank or line end between
two characters that aren't white space is such a border, so the text is cut before each of them and
equal pieces are encoded once for a worker. The ids are those of the whole text."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from sightline.llm.common import BYTE_POWERS, BYTE_TABLE, SPACE, U64, mix

CACHED_PIECES = 2_500_000
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
#: A character that starts with one of these bytes may be white space beyond ASCII.
_MAYBE = SPACE.copy()
_MAYBE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Numbers 0, 1, ... of 64-bit keys, by linear probing over arrays."""

    def __init__(self) -> None:
        self.keys, self.numbers, self.size = np.zeros(1 << 16, U64), np.zeros(1 << 16, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is new. Keys aren't 0."""
        mask = U64(len(self.keys) - 1)
        out, at, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), keys & mask
        while len(at):
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.numbers[slot[hit]]
            on = ~hit & (there != 0)
            at, slot = at[on], (slot[on] + U64(1)) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Numbers for new, distinct keys, in order."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        if self.size * 2 > len(self.keys):
            old = self.keys != 0
            keys, numbers = np.concatenate([self.keys[old], keys]), np.concatenate([self.numbers[old], numbers])
            size = len(self.keys)
            while self.size * 3 > size:
                size *= 2
            self.keys, self.numbers = np.zeros(size, U64), np.zeros(size, np.int32)
        mask = U64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.numbers[slot[won]] = numbers[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + U64(1)) & mask


class PieceEncoder:
    """ids of runs of documents. path: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known = PieceTable()
        self.starts, self.sizes, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        n, total = self.known.size, int(sizes.sum())
        while n + len(out) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.starts[n : n + len(out)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(out)] = sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(out), np.uint32, total)
        self.used += total
        self.known.add(keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, n+1 offsets)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            before, after, at = data[:-2], data[2:], data[1:-1]
            plain = (before < 0x80) & ~_MAYBE[before]
            plain[1:] |= (before[1:] >= 0x80) & (data[:-3] >= 0xC3) & (data[:-3] < 0xE0)
            cut[1 : n - 1] = _BLANK[at] & plain & ~_MAYBE[after]
            for edge in (offsets - 1, offsets + 1):  # a neighbour of another document
                edge = edge[(edge > 0) & (edge < n)]
                cut[edge] = False
        cut[offsets] = True
        places = np.flatnonzero(cut)
        start, end = places[:-1], places[1:]
        up, down = BYTE_POWERS.get(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(BYTE_TABLE[data] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64)) | U64(1)
        at = self.known.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.known.size > CACHED_PIECES:
                self._forget()
                new = np.arange(len(h))
            keys, first = np.unique(h[new], return_index=True)
            first = new[first]
            raw = memoryview(data)
            self._add(keys, [str(raw[a:b], "utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            at[new] = self.known.find(h[new])
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, offsets)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
