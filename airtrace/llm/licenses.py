"""License scan: MinHash bands over overlapping windows, then exact containment.

Templates are cut into five-word shingles and put into classes by length (the
next power of two, L). For each class a text is cut into blocks of L shingles.
Where a block's least value in a band is that of a template, each of the three
windows of three neighbouring blocks that hold it is confirmed on the words
themselves, so that an occurrence that an insertion has stretched over three
blocks lies in one window whole. A template has more than L/2 shingles; if 0.8
of them occur, its least value is among them with probability 0.8 and least in
its block, which has L shingles, with a third at least. So a band agrees with
probability 0.26, and none of 48 does with less than one in a million.

Many texts are hashed together: words once per batch, all bands of all blocks in
one array, halved from class to class.

Nulls, empty and odd input: a null or short text has no shingle and no license;
texts of any length are scanned whole, in pieces; rows are independent, so null
or repeated ids and further columns do not matter. A template without words is
an error.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from airtrace.llm.arrow import map_texts
from airtrace.llm.common import require

SHINGLE = 5
CONTAINED = 0.8
BANDS = 48
#: Blocks of a window, and words whose bands are computed together.
WINDOW, TOGETHER = 3, 30_000
WORD = re.compile(r"\w+")
REMEMBERED = 500_000

# Wordings of license notices, by identifier.
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. "
    ) + DISCLAIMER,
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. "
    ) + DISCLAIMER,
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely."
    ),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tuples_of(words: list[str]) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(SHINGLE))))


class Scanner:
    """The templates by class with their band values."""

    def __init__(self, templates: dict[str, str]):
        rng = np.random.default_rng(20_240_601)
        self.factors = rng.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}
        self.shingles: dict[str, set[tuple[str, ...]]] = {}
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in templates.items():
            words = words_of(text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.shingles[name] = set(tuples_of(words))
            size = 1 << (len(self.shingles[name]) - 1).bit_length()
            bands = self.mixed(self.hashes(words)).min(axis=1)
            self.classes.setdefault(size, []).append((name, bands))
        self.longest = max(self.classes)

    def hashes(self, words: list[str]) -> np.ndarray:
        """A 64-bit number per shingle."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
        out = h[:len(h) - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - SHINGLE + 1 + i]
        return out

    def mixed(self, h: np.ndarray) -> np.ndarray:
        """A row of values per band."""
        m = h[None, :] * self.factors[:, None]
        return m ^ (m >> np.uint64(32))

    def agreeing(self, pieces: list[list[str]]) -> set[tuple[int, str, int, int]]:
        """(piece, template, block, block size) where a block agrees with a template in a band."""
        sizes = np.array([len(p) for p in pieces])
        h = self.hashes([w for p in pieces for w in p])
        counts = sizes - SHINGLE + 1
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        offsets = np.r_[0, np.cumsum(counts)[:-1]]
        inside = np.arange(counts.sum()) + np.repeat(first - offsets, counts)  # no shingle across two pieces
        level, size = self.mixed(h[inside]), 1
        found: set[tuple[int, str, int, int]] = set()
        while True:
            for name, values in self.classes.get(size, ()):
                at = np.unique(np.nonzero(level == values[:, None])[1])
                piece = np.searchsorted(offsets, at, side="right") - 1
                found.update((p, name, b, size) for p, b in zip(piece.tolist(), (at - offsets[piece]).tolist()))
            if size >= self.longest:
                return found
            halved = (counts + 1) // 2
            starts = np.r_[0, np.cumsum(halved)[:-1]]
            pairs = np.repeat(offsets, halved) + 2 * (np.arange(halved.sum()) - np.repeat(starts, halved))
            level = np.minimum.reduceat(level, pairs, axis=1)
            counts, offsets, size = halved, starts, size * 2

    def confirmed(self, words: list[str], name: str, blocks: set[int], size: int) -> list[tuple[int, int]]:
        """First and end word of the windows around agreeing blocks that hold enough of a template."""
        wanted, spans = self.shingles[name], []
        for window in sorted({max(b - back, 0) for b in blocks for back in range(WINDOW)}):
            a = window * size
            here = tuples_of(words[a:a + WINDOW * size + SHINGLE - 1])
            hits = [i for i, s in enumerate(here) if s in wanted]
            if len({here[i] for i in hits}) >= CONTAINED * len(wanted):
                spans.append((a + hits[0], a + hits[-1] + SHINGLE))
        return spans

    def scan_all(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Per text the confirmed (template, first word, end word), overlapping ones together."""
        step, margin = 100_000, 2 * WINDOW * self.longest
        spans: list[dict[str, list[tuple[int, int]]]] = [{} for _ in texts]
        held: list[tuple[int, int, list[str]]] = []
        size = 0

        def settle() -> None:
            at: dict[tuple[int, str, int], set[int]] = {}
            for piece, name, block, length in self.agreeing([p for _, _, p in held]):
                at.setdefault((piece, name, length), set()).add(block)
            for (piece, name, length), blocks in at.items():
                text, start, words = held[piece]
                places = self.confirmed(words, name, blocks, length)
                if places:
                    spans[text].setdefault(name, []).extend((start + a, start + b) for a, b in places)
            held.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            for start in range(0, max(len(words) - SHINGLE + 1, 0), step):  # pieces overlap by more than a window
                part = words[start:start + step + margin + SHINGLE]
                if len(part) >= SHINGLE:
                    held.append((i, start, part))
                    size += len(part)
                    if size > TOGETHER:
                        settle()
                        size = 0
        if held:
            settle()
        return [self.merged(s) for s in spans]

    @staticmethod
    def merged(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        out = []
        for name, places in spans.items():
            places.sort()
            runs = [list(places[0])]
            for a, b in places[1:]:
                if a < runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            out += [(name, a, b) for a, b in runs]
        return sorted(out, key=lambda s: (s[1], s[0]))


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


FOUND = StructType([
    StructField("n_licenses", LongType()), StructField("licenses", ArrayType(StringType())), StructField("spans", StringType())])


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of text files, one license a file, named by the file without its ending."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    rows = spark.read.option("wholetext", True).text(folder).select(name.alias("name"), "value")
    return {r.name: r.value for r in rows.collect()}  # some hundred texts


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: confirmed places, distinct licenses and spans as name:first:end in words."""
    require(docs, "doc_id", "text")
    fixed = tuple(sorted((templates or TEMPLATES).items()))

    def run(texts: list[str]) -> dict[str, list]:
        found = scanner(fixed).scan_all(texts)
        return {
            "n_licenses": [len(f) for f in found],
            "licenses": [sorted({n for n, _, _ in f}) for f in found],
            "spans": [",".join(f"{n}:{a}:{b}" for n, a, b in f) for f in found],
        }

    return map_texts(docs.select("doc_id", "text"), "text", run, FOUND).drop("text")
