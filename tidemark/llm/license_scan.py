"""License scan: MinHash bands over text windows retrieve templates, containment verifies.

Text becomes words of letters and digits, lower case, then five-word shingles (a template of
fewer words is one shingle of its own length). Templates whose lengths differ by a quarter at most share
a tier; its windows are up to a quarter longer than its longest template, and overlap so that every
stretch as long as a template lies whole in some window. A window has ``BANDS`` minima, each under another hash,
and each one is a band. A window that holds ``SIMILAR`` of a template's shingles has a Jaccard
similarity of 0.45 with it at least, whatever else it holds (0.8 * 0.8 shingles in common of 1.25 + 0.2 * 0.8,
in lengths of the tier's longest), and so shares a band with probability 0.9999 at least. Retrieved
pairs are then decided by the exact share of the template's shingles that the window holds.
Scanning needs no shuffle; the templates, a list of fixed texts, travel with the tasks.

Defined cases: null and empty texts match nothing; a document matches a template once, at its
first best window, with the number of matching windows; ties go to the earlier word; null ids
and repeated rows pass through; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import NOT_ALNUM, U, column, mix, shingles, slices
from .workspace import small_batches

GRAM, SIMILAR = 5, 0.8
BANDS = 16
#: Templates of a tier are at most so many times as long as its shortest.
WIDTH = 1.25
SCHEMA = "doc_id long, license_id string, containment double, first_word long, windows long"

# Wording of public licences and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-3.0-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}


def _grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = column(pa.array(texts, pa.string()))
    h, first, _ = shingles(data, off, k, NOT_ALNUM)
    return h, first


#: An odd multiplier for every band: shingles are hashes, so products are ordered at random.
_FACTORS = mix(np.arange(1, BANDS + 1, dtype=U)) | U(1)


def _signature(h: np.ndarray, b: int) -> np.ndarray:
    return h * _FACTORS[b]


class Tier:
    """Templates whose windows have the same shape: gram words a shingle, window shingles, step between windows."""

    def __init__(self, gram: int, templates: dict[str, np.ndarray]) -> None:
        self.gram, self.templates = gram, templates
        longest = max(len(t) for t in templates.values())
        # Whole steps: at least longest + step - 1 shingles, at most 1.25 times longest (one more, if that is none).
        self.step = max(1, longest // 8)
        self.window = max(longest + 1, longest * 5 // 4 // self.step * self.step)
        self.bands = [{n: _signature(t, b).min() for n, t in templates.items()} for b in range(BANDS)]

    def blocks(self, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Window starts (indexes of shingles), and for each further step whether it is in the same row."""
        starts = np.concatenate([np.arange(a, b, self.step) for a, b in zip(first[:-1], first[1:], strict=True)])
        row = np.searchsorted(first, starts, "right") - 1
        return starts, [row[j:] == row[:-j] for j in range(1, min(-(-self.window // self.step), len(row)))]

    def windows(self, signature: np.ndarray, starts: np.ndarray, same: list[np.ndarray]) -> np.ndarray:
        """The least signature of each window."""
        m = signature if self.step == 1 else np.minimum.reduceat(signature, starts)
        if not same:
            return m
        w = m.copy()
        for j, inside in enumerate(same, 1):
            np.minimum(w[:-j], m[j:], out=w[:-j], where=inside)
        return w


def candidates(held: list[Tier], h: np.ndarray, first: np.ndarray) -> list[tuple[Tier, str, np.ndarray]]:
    """(tier, template, starts of the windows that share a band with it); tiers of one gram length."""
    if not len(h):
        return []
    shapes = [tier.blocks(first) for tier in held]
    found = {(i, n): np.zeros(len(shapes[i][0]), bool) for i, tier in enumerate(held) for n in tier.templates}
    for b in range(BANDS):
        signature = _signature(h, b)
        for i, tier in enumerate(held):
            key = tier.windows(signature, *shapes[i])
            for n, k in tier.bands[b].items():
                found[i, n] |= key == k
    return [(held[i], n, shapes[i][0][f]) for (i, n), f in found.items() if f.any()]


def tiers(templates: dict[str, str]) -> list[Tier]:
    sets: dict[int, dict[str, np.ndarray]] = {}
    for name, text in templates.items():
        words = _grams([text], 1)[1][-1]
        gram = int(min(GRAM, words))
        if gram:
            sets.setdefault(gram, {})[name] = np.unique(_grams([text], gram)[0])
    out = []
    for gram, held in sorted(sets.items()):
        names = sorted(held, key=lambda n: (len(held[n]), n))
        while names:
            own = [n for n in names if len(held[n]) <= WIDTH * len(held[names[0]])]
            out.append(Tier(gram, {n: held[n] for n in own}))
            names = names[len(own) :]
    return out


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tiers(templates)
        for batch in slices(batches, "text"):
            data, off = column(batch.column("text"))
            ids, out = batch.column("doc_id").to_pylist(), []
            for gram in sorted({t.gram for t in held}):
                h, first, count = shingles(data, off, gram, NOT_ALNUM)
                keep = np.repeat(count >= gram, np.diff(first))  # a text of fewer words has no shingle of this length
                first = np.concatenate([[0], np.cumsum(np.where(count >= gram, np.diff(first), 0))])
                h = h[keep]
                for tier, name, starts in candidates([t for t in held if t.gram == gram], h, first):
                    want, best = tier.templates[name], {}
                    for s in starts:
                        row = int(np.searchsorted(first, s, "right")) - 1
                        part = h[s : min(int(first[row + 1]), s + -(-tier.window // tier.step) * tier.step)]
                        hit = np.isin(part, want)
                        share = len(np.unique(part[hit])) / len(want)
                        if share >= SIMILAR:
                            word = int(s - first[row] + np.flatnonzero(hit)[0])
                            old = best.get(row)
                            best[row] = (share, word, 1) if old is None else (*max(old[:2], (share, word), key=lambda x: (x[0], -x[1])), old[2] + 1)
                    out += [(ids[row], name, *b) for row, b in best.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license_id", "containment", "first_word", "windows"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template that it holds: SCHEMA."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates), SCHEMA)
