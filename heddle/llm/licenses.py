"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies (operator 4).

Words are lower-cased runs of letters and digits; a shingle is five words (of a shorter template: all of its words). A template
of s shingles is looked for in windows of s shingles that overlap by seven eighths at least (all windows where s < 16). A
window that holds a share `containment` of the template has a Jaccard similarity of some least value with it, from which the
number of bands follows: a collision has at least the probability `sure`. Each collision is verified on the window and a
quarter of its length around it: matched shingles of the template by all of them. Overlapping matches of a template are one.

An empty table gives no rows; other columns are not read, whatever their names. Templates are a parameter, MOST at most; their bands go to every task. Nothing is shuffled; texts are read whole, in blocks of
bounded size. Null and empty texts match nothing; a template without words is refused; each row of docs counts for itself.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
WIDTH, ROWS, BLOCK, MOST = 5, 2, 1 << 16, 5000

_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE{0}. IN NO EVENT SHALL {1} BE LIABLE FOR ANY {2} OTHER LIABILITY, WHETHER IN {3}CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Notices, openings and short whole texts of common licenses.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "rights reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0": _GNU.format("program", "General Public License", "2"),
    "LGPL-2.1": _GNU.format("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _GNU.format("program", "Lesser General Public License", "3"),
    "AGPL-3.0": _GNU.format("program", "Affero General Public License", "3"),
    "BSD-3-Clause": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
}
#: Whole texts of short licenses, but for their copyright lines.
TEMPLATES |= {
    "MIT text": f"{TEMPLATES['MIT']} {_AS_IS.format(' AND NONINFRINGEMENT', 'THE AUTHORS OR COPYRIGHT HOLDERS', 'CLAIM, DAMAGES OR', 'AN ACTION OF ')}",
    "BSD-2-Clause text": f"{TEMPLATES['BSD-2-Clause']} {_BSD_AS_IS}",
    "BSD-3-Clause text": f"{TEMPLATES['BSD-3-Clause']} {_BSD_AS_IS}",
    "ISC text": f"{TEMPLATES['ISC']} {_ISC_AS_IS}",
    "0BSD text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}",
    "BSL-1.0 text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
    + _AS_IS.format(", TITLE AND NON-INFRINGEMENT", "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE", "DAMAGES OR", ""),
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense text": f"{TEMPLATES['Unlicense']} In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS.format(' AND NONINFRINGEMENT', 'THE AUTHORS', 'CLAIM, DAMAGES OR', 'AN ACTION OF ')}",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    """word -> hash; forgets all at a limit."""

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh64_intdigest(word, 3)
        if len(word) <= 40:
            if len(self) >= 500_000:
                self.clear()
            self[word] = got
        return got


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words, from word hashes."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def bands_for(s: int, stride: int, containment: float, sure: float) -> int:
    """How many bands of ROWS hashes a window of s shingles needs; one is enough where all shingles must match."""
    m, off = math.ceil(containment * s - 1e-9), stride // 2
    least = max(m - off, 1) / (2 * s - m + off)
    return 1 if least >= 1 else math.ceil(math.log(1 - sure) / math.log(1 - least**ROWS))


def doubled(x: np.ndarray, s: int) -> list[np.ndarray]:
    """The least of each window of 1, 2, 4, .. up to s; windows end with x."""
    out = [x]
    while 2 << (len(out) - 1) <= s:
        last, step = out[-1], 1 << (len(out) - 1)
        new = last.copy()
        if step < len(x):
            np.minimum(last[:-step], last[step:], out=new[:-step])
        out.append(new)
    return out


def least_of(ladder: list[np.ndarray], starts: np.ndarray, s: int) -> np.ndarray:
    """The least of the windows of s that begin at starts, from doubled()."""
    k = s.bit_length() - 1
    return np.minimum(ladder[k][starts], ladder[k][starts + s - (1 << k)])


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, .. (sizes[0] of them), begins[1], .."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Index:
    """The templates' bands, by class: shingle width and count."""

    def __init__(self, templates: Mapping[str, str], containment: float, sure: float):
        if len(templates) > MOST:
            raise ValueError(f"more than {MOST} templates: scan for them in parts")
        self.containment, self.hashes = containment, _Hashes()
        seeds = np.random.default_rng(23)
        self.seeds = [(np.uint64(a | 1), np.uint64(b)) for a, b in seeds.integers(0, 1 << 63, (4096, 2), dtype=np.uint64).tolist()]
        self.sets: dict[str, np.ndarray] = {}
        self.classes: dict[tuple[int, int], tuple[int, int, list[dict[int, list[str]]]]] = {}
        by_class = defaultdict(list)
        for name, text in templates.items():
            w = words_of(text)
            if not w:
                raise ValueError(f"template {name} has no words")
            width = min(WIDTH, len(w))
            self.sets[name] = np.unique(shingles(self.of(w), width))
            by_class[width, len(w) - width + 1].append(name)
        for (width, s), names in by_class.items():
            stride = max(1, s // 8) if s >= 16 else 1
            n = bands_for(s, stride, containment, sure)
            if n * ROWS > len(self.seeds):
                raise ValueError("a lower containment than the seeds allow for")
            tables: list[dict[int, list[str]]] = [defaultdict(list) for _ in range(n)]
            for name in names:
                for table, key in zip(tables, self.bands(self.sets[name], n, lambda p: {0: p.min(keepdims=True)})):
                    table[int(key[0][0])].append(name)
            self.classes[width, s] = (stride, n, [dict(t) for t in tables])
        self.longest = max(w + s for w, s in self.classes)

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def bands(self, x: np.ndarray, n: int, least: Callable[[np.ndarray], dict]) -> Iterator[dict]:
        """n keys of each window, one after another. least: of hashes of x, by kind, the least of each of its windows."""
        for k in range(n):
            keys: dict = {}
            for r in range(ROWS):
                a, b = self.seeds[k * ROWS + r]
                p = (x ^ b) * a
                p ^= p >> np.uint64(32)
                for kind, m in least(p).items():
                    keys[kind] = (keys.get(kind, np.uint64(0)) ^ m) * np.uint64(0xBF58476D1CE4E5B9)
            yield keys

    def hits(self, x: np.ndarray, kinds: Iterable[tuple[int, int]], least: Callable[[np.ndarray], dict]) -> list[tuple[tuple[int, int], int, str]]:
        """(kind, window, template) of each collision in a band."""
        out = set()
        for k, keys in enumerate(self.bands(x, max(self.classes[c][1] for c in kinds), least)):
            for kind, own in keys.items():
                _, n, tables = self.classes[kind]
                table = tables[k] if k < n else {}
                some = np.fromiter(table, np.uint64, len(table))
                for i in np.flatnonzero(np.isin(own, some) if len(some) > 8 else np.logical_or.reduce([own == t for t in some])) if len(some) else ():
                    out |= {(kind, int(i), name) for name in table[int(own[i])]}
        return sorted(out)

    def found(self, texts: list[str]) -> Iterator[tuple[int, str, int, int, float]]:
        """(text's place, template, first word, last word + 1, share matched) of each match. Windows lie in one text each: they begin
        at multiples of their class's stride from the text's begin, and one ends with it; a shorter text is one window. So a match
        depends on its text alone."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        h = self.of([x for w in words for x in w])
        spans: dict[tuple[int, str], list[tuple[int, int, float]]] = defaultdict(list)
        windows = {}
        for (width, s), (stride, _, _) in self.classes.items():
            count = sizes - width + 1  # shingles
            long = np.flatnonzero(count >= s)
            each = (count[long] - s) // stride + 1
            starts = np.repeat(begins[long], each) + stride * runs(np.zeros(len(long), np.int64), each)
            windows[width, s] = np.unique(np.concatenate([starts, begins[long] + count[long] - s]))
            short = np.flatnonzero((count < s) & (count >= max(1, math.ceil(self.containment * s - 1e-9))))
            if len(short):
                x = shingles(h[runs(begins[short], sizes[short])], width)
                at = np.cumsum(sizes[short]) - sizes[short]
                x = x[runs(at, count[short])]  # none of two texts
                at = np.cumsum(count[short]) - count[short]
                kind = (width, s)
                for _, i, name in self.hits(x, [kind], lambda p, at=at, kind=kind: {kind: np.minimum.reduceat(p, at)}):
                    own = x[at[i] : at[i] + count[short[i]]]
                    if m := self.verified(own, 0, len(own), name):
                        spans[int(short[i]), name].append((m[0], m[1] + width, m[2]))
        for begin in range(0, len(h), BLOCK):
            lead = min(begin, self.longest)  # what lies around the block's windows
            first = begin - lead
            part = h[first : begin + BLOCK + 2 * self.longest]
            for width in {w for w, _ in windows}:
                some = {k: at[np.searchsorted(at, begin) : np.searchsorted(at, begin + BLOCK)] - first for k, at in windows.items() if k[0] == width}
                some = {k: at for k, at in some.items() if len(at)}
                if not some:
                    continue
                x, most = shingles(part, width), max(s for _, s in some)

                def least(p: np.ndarray, some=some, most=most) -> dict:
                    ladder = doubled(p, most)  # of all kinds
                    return {kind: least_of(ladder, at, kind[1]) for kind, at in some.items()}

                for (_, s), i, name in self.hits(x, some, least):
                    start = int(some[width, s][i])
                    doc = int(np.searchsorted(ends, start + first, side="right"))
                    low, high = max(start - s // 4, int(begins[doc]) - first), min(start + s + s // 4, int(ends[doc]) - width + 1 - first)
                    if m := self.verified(x, low, high, name):
                        base = first - int(begins[doc])
                        spans[doc, name].append((base + m[0], base + m[1] + width, m[2]))
        for (doc, name), some in sorted(spans.items()):
            some.sort()
            first, last, share = some[0]
            for a, b, c in some[1:]:
                if a < last:
                    last, share = max(last, b), max(share, c)
                else:
                    yield doc, name, first, last, share
                    first, last, share = a, b, c
            yield doc, name, first, last, share

    def best(self, found: list[tuple[int, str, int, int, float]]) -> list[tuple[int, str, int, int, float]]:
        """Of matches that overlap by half the shorter one, the one with most shingles matched, then of highest containment."""
        chosen: dict[int, list[tuple[int, str, int, int, float]]] = defaultdict(list)
        for x in sorted(found, key=lambda x: (-round(x[4] * len(self.sets[x[1]])), -x[4], x)):
            if all(2 * (min(x[3], y[3]) - max(x[2], y[2])) < min(x[3] - x[2], y[3] - y[2]) for y in chosen[x[0]]):
                chosen[x[0]].append(x)
        return sorted(x for some in chosen.values() for x in some)

    def verified(self, x: np.ndarray, low: int, high: int, name: str) -> tuple[int, int, float] | None:
        """The exact share among the shingles from low to high, a window and a quarter of its length around it; the first and last."""
        own = self.sets[name]
        at = low + np.flatnonzero(np.isin(x[low:high], own))
        share = len(np.unique(x[at])) / len(own)
        return (int(at[0]), int(at[-1]), share) if share >= self.containment else None


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = 0.8, sure: float = 0.999, doc_id: str = "doc_id", text: str = "text", best: bool = False) -> DataFrame:
    """(doc_id, license, start, stop, containment): a row a match; start and stop are code points of the text. best: of
    overlapping matches only Index.best()."""
    kinds = "doc_id long, license string, start long, stop long, containment double"
    names = [c.split()[0] for c in kinds.split(", ")]
    templates = dict(templates)
    Index(templates, containment, sure)  # fails here, not in a task

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, containment, sure)
        for b in batches:
            ids, texts, held = b.column(0).to_pylist(), [], 0
            begin = 0
            for i, t in enumerate(b.column(1)):
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held > 4_000_000 or i == len(ids) - 1:
                    rows = []
                    for k, name, first, last, share in index.best([*index.found(texts)]) if best else index.found(texts):
                        at = [(m.start(), m.end()) for m in WORD.finditer(texts[k].lower())]
                        rows.append((ids[begin + k], name, at[first][0], at[last - 1][1], share))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) if n != "doc_id" else pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))], names)
                    texts, held, begin = [], 0, i + 1

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(of, kinds)
