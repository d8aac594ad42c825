"""Operator 10: license scans by MinHash bands over overlapping windows, verified by exact shingle containment.

Words are compared in lower case, bytes of punctuation being blanks; shingles have five words (a shorter template is one shingle).
Templates of about one size (within a quarter) share windows of the class's size and an eighth more, which overlap so that any place of a template
lies wholly in a window. A window of Jaccard J with a template agrees with it in a one-row band with probability J, and it is retrieved if one of
BANDS bands agrees. A window over 0.8 of a template's shingles has a J of 0.8 / (1.25 * 1.125 + 0.2) = 0.49 at least, so it is retrieved with a
probability of 1 - 0.51 ** BANDS = 0.9988 or more, a whole copy (J of 0.71) with 0.999995. In each document that a retrieved window
touches, the share of the template's shingles within the words around must then be CONTAINMENT or more.

Cases: null or empty texts have no match; equal templates are each reported; repeated rows give repeated rows; a null doc_id
is kept; of very long texts every window is looked at, a text in the memory of one task; of equally good places the first counts; an empty
table gives an empty one; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import U64, Words, arrow_rows, gram_hash, mix, per_chunk, read_table, sliding, text_of, within
from sightline.llm.decontaminate import plain_words

SHINGLE = 5
BANDS = 10
CONTAINMENT = 0.8

#: Public notices by which texts declare a license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _shingles(words: Words) -> np.ndarray:
    """The hash of the shingle at each word; the greatest number where it would leave the document."""
    grams = gram_hash(words.hash, SHINGLE)
    out = np.full(len(words), np.iinfo(np.uint64).max, U64)
    ok = words.doc[: len(grams)] == words.doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    out[: len(grams)][ok] = grams[ok]
    return out


def _salts(bands: int) -> np.ndarray:
    return mix(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


class Templates:
    def __init__(self, texts: dict[str, str], bands: int = BANDS):
        self.names = sorted(texts)
        raw = [texts[n].encode() for n in self.names]
        words = plain_words(np.frombuffer(b" ".join(raw) + b" ", np.uint8), np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64))
        grams, self.sets = _shingles(words), []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            own = grams[a : max(a, b - SHINGLE + 1)]
            self.sets.append(np.unique(own))
        # A template of fewer words is one shingle: its whole sequence, by its number of words.
        self.short: dict[int, list[tuple[np.uint64, int]]] = {}
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if 0 < b - a < SHINGLE:
                self.short.setdefault(b - a, []).append((gram_hash(words.hash[a:b], b - a)[0], i))
        self.salts = _salts(bands)
        # The largest template that has no class yet begins one, with all that have four fifths of its size or more.
        self.classes: dict[int, list[int]] = {}
        for i in sorted((i for i, s in enumerate(self.sets) if len(s)), key=lambda i: -len(self.sets[i])):
            size = next((k for k in self.classes if 5 * len(self.sets[i]) >= 4 * k), len(self.sets[i]))
            self.classes.setdefault(size, []).append(i)
        self.bands: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size, members in self.classes.items():
            self.bands[size] = []
            for salt in self.salts:
                key = np.array([(self.sets[i] * salt).min() for i in members])
                order = np.argsort(key, kind="stable")
                self.bands[size].append((key[order], np.array(members)[order]))


def _candidates(grams: np.ndarray, templates: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of the window, its shingles, template) of the windows that agree with a template in a band."""
    found = []
    scrambled = [grams * salt for salt in templates.salts]
    for size, bands in templates.bands.items():
        step = max(1, size // 8)
        width = max(1, size + step - 1)
        for own, (keys, members) in zip(scrambled, bands, strict=True):
            least = sliding(np.append(own, np.full(width - 1, np.iinfo(np.uint64).max, U64)), width)[::step]
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> U64(48)).astype(np.int64)] = True
            at = np.flatnonzero(seen[(least >> U64(48)).astype(np.int64)])
            a, b = np.searchsorted(keys, least[at], "left"), np.searchsorted(keys, least[at], "right")
            for i in np.flatnonzero(b > a).tolist():
                found += [(int(at[i]) * step, width, int(t)) for t in members[a[i] : b[i]]]
    pairs = np.unique(np.array(found, np.int64).reshape(-1, 3), axis=0)
    return pairs[:, 0], pairs[:, 1], pairs[:, 2]


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, windows): each document and template that it holds, at its best place, the first if several."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if texts is None else texts, bands))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        for batch, data, offsets in per_chunk(batches):
            words = plain_words(data, offsets)
            if not len(words):
                continue
            grams = _shingles(words)
            best: dict[tuple[int, int], list] = {}
            for at, width, t in zip(*(x.tolist() for x in _candidates(grams, templates)), strict=True):
                own = templates.sets[t]
                for d in range(int(words.doc[at]), int(words.doc[min(at + width - 1, len(words) - 1)]) + 1):
                    low, high = max(int(words.first[d]), at - len(own)), min(int(words.first[d + 1]), at + width + len(own))
                    hit = np.isin(grams[low:high], own)
                    share = len(np.unique(grams[low:high][hit])) / len(own)
                    if share >= containment:
                        place = low + int(np.argmax(hit)) - int(words.first[d])
                        old = best.setdefault((d, t), [0.0, 0, 0])
                        old[2] += 1
                        if (share, -place) > (old[0], -old[1]):
                            old[:2] = [share, place]
            for n, own in templates.short.items():
                whole = gram_hash(words.hash, n)
                inside = within(words.doc, n)
                for key, t in own:
                    for at in np.flatnonzero(inside & (whole == key)).tolist():
                        d = int(words.doc[at])
                        best.setdefault((d, t), [1.0, at - int(words.first[d]), 0])[2] += 1
            if best:
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([d for d, _ in keys])), pa.array([templates.names[t] for _, t in keys]), pa.array([round(best[k][0], 6) for k in keys]), pa.array([best[k][1] for k in keys], pa.int64()), pa.array([best[k][2] for k in keys], pa.int64())],
                    names=["doc_id", "license", "containment", "first_word", "windows"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scan, "doc_id long, license string, containment double, first_word long, windows long")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
