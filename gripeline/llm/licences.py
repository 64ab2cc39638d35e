"""Operator 5: licence scans.

Every text is cut into windows of 1, 3, 6, 12 and 24 consecutive lines that hold words, and the whole text is one more. Each window
is compared with all templates by the cosine of sparse TF-IDF vectors (words are runs of ASCII letters and digits, so comment marks
and punctuation fall away); a text's own licence is that of its most similar window, if that reaches ``threshold``. Ties: fewer
lines, the earlier line, the earlier template. A file that says nothing itself inherits the licence of the nearest directory above
it that holds a licence file, found by joining directory paths.

Templates are short statements made by rule from names, notices as they stand in headers, and whole texts of short licences and the
openings of long ones; ``templates`` takes others, such as the complete texts of a licence list. A licence file is one with such a
name (LICENSE, LICENCE, COPYING, UNLICENSE, with any suffix) or one of whose words half or more stand in windows that match. Of
several in a directory those with such a name count first, then the most similar, then the first by licence.

Nulls and texts without words have no licence of their own; a null path is in no directory; each row is scanned by itself, whatever
its id, which may be null or repeated; a text of any length is scanned whole, in one task; an empty table gives an empty result.
Columns of the input are kept; those added here win over input columns of the same name.

No window is compared that cannot match: products with the templates add up over lines, and the square of a window's length is no
less than the sum of those of its lines, so the quotient bounds its cosine from above.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lm import word_hashes
from .shared import Cuts, parts, small_batches

#: Licences by SPDX identifier, and the names that go by.
NAMES_OF = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-style license"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal public domain dedication"],
    "Unlicense": ["The Unlicense"],
}
#: How a file says what it is licensed under.
FORMS = ("SPDX-License-Identifier: {id}", "{name}", "licensed under the {name}", "released under the {name}", "this work is licensed under the {name}", "distributed under the {name}, see the file LICENSE for details")

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software."
)
_MIT_END = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software "
    "Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. You should have "
    "received a copy of the GNU {kind} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
#: Notices and licence texts (public texts, as their licences word them).
TEXTS = [
    ("MIT", "MIT License Copyright (c) " + _MIT_GRANT + " " + _MIT_END),
    ("MIT", _MIT_GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
     "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information "
     "regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms "
     "and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. Licensor shall mean the copyright owner or entity authorized by the copyright owner "
     "that is granting the License. Legal Entity shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity."),
    *((f"{short}-{v}.0", _GNU.format(kind=kind, v=v)) for short, kind, v in (("GPL", "General", 2), ("GPL", "General", 3), ("LGPL", "Lesser General", 3), ("AGPL", "Affero General", 3))),
    ("LGPL-2.1", _GNU.format(kind="Lesser General", v="2.1").replace("program", "library")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
     "document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
     "document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
     "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
     "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
]
TEMPLATES = [(i, f.format(id=i, name=n)) for i, names in NAMES_OF.items() for n in names for f in FORMS] + TEXTS
THRESHOLD = 0.6
FILE_SHARE = 0.5
#: Lines of a window, and how far windows of so many lines stand apart.
WINDOWS = {1: 1, 3: 1, 6: 2, 12: 4, 24: 8}
NAMES = r"(?i)(^|/)(un)?licen[sc]e[^/]*$|(^|/)copying[^/]*$"
_PLAIN = bytes(c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    return text.encode().translate(_PLAIN).decode().split()


def idfs(templates=None) -> dict[str, float]:
    templates = TEMPLATES if templates is None else templates
    df = Counter(w for _, t in templates for w in set(words_of(t)))
    return {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in sorted(df.items())}


def vectors(templates=None) -> tuple[list[tuple[int, str, str, float]], float]:
    """(template, licence, word, weight) with weights of unit length, and the idf of a word that no template has."""
    templates = TEMPLATES if templates is None else templates
    idf, out = idfs(templates), []
    for i, (name, text) in enumerate(templates):
        c = Counter(words_of(text))
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        out += [(i, name, w, n * idf[w] / norm) for w, n in sorted(c.items())]
    return out, math.log(1 + len(templates)) + 1


class _Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        found, self.unknown = vectors(templates)
        idf = idfs(templates)
        hashes, _ = word_hashes([w.encode() for w in idf])
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], np.array(list(idf.values()))[order]
        at = {w: k for k, w in enumerate(np.array(list(idf))[order].tolist())}
        self.weights = np.zeros((len(at), len(templates)))
        for i, _, w, x in found:
            self.weights[at[w], i] = x
        self.licences, self.threshold = [n for n, _ in templates], threshold

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes of words the place among known ones (where there is none, any) and the idf."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        there = self.hashes[at] == h
        return np.where(there, at, -1), np.where(there, self.idf[at], self.unknown)

    def exact(self, h: np.ndarray) -> tuple[float, int]:
        """The largest cosine of the words h with a template, and that template."""
        h, c = np.unique(h, return_counts=True)
        at, idf = self.known(h)
        w = c * idf
        there = at >= 0
        cos = np.round((w[there, None] * self.weights[at[there]]).sum(0) / math.sqrt((w * w).sum()), 6)
        return float(cos.max()), int(cos.argmax())

    def scan(self, texts: list[bytes | None]) -> list[tuple[str | None, float | None, float | None]]:
        """(licence, similarity, share of words in windows that match) of each text."""
        lines = [t.translate(_PLAIN).split(b"\n") if t else [] for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
        h, size = word_hashes([x for ls in lines for x in ls])
        doc, size = doc[size > 0], size[size > 0]
        out: list[tuple] = [(None, None, None)] * len(texts)
        if not len(h):
            return out
        ends = np.cumsum(size)
        line = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((h, line))
        new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])])
        count = np.diff(np.append(new, len(h)))
        at, idf = self.known(h[order][new])
        w, of = count * idf, line[order][new]
        square = np.concatenate([[0.0], np.cumsum(np.bincount(of, w * w, len(size)))])
        dots = np.zeros((len(size) + 1, len(self.licences)))
        there = np.flatnonzero(at >= 0)
        for a in range(0, len(there), 4096):
            k = there[a : a + 4096]
            first = np.flatnonzero(np.r_[True, of[k][1:] != of[k][:-1]])
            dots[of[k][first] + 1] += np.add.reduceat(w[k, None] * self.weights[at[k]], first)
        dots = np.cumsum(dots, axis=0)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        n = np.diff(np.append(first, len(doc)))
        found: dict[int, list[tuple]] = {}
        for lines_, step in [*WINDOWS.items(), (0, 1)]:
            if lines_:
                many = np.where(n >= lines_, (n - lines_) // step + 1, 0)
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                x = np.repeat(first, many) + nth * step
                y = x + lines_
            else:
                x, y = first, first + n
            for a in range(0, len(x), 4096):
                p, q = x[a : a + 4096], y[a : a + 4096]
                bound = (dots[q] - dots[p]).max(1) / np.sqrt(square[q] - square[p])
                for i, j in zip(p[bound >= self.threshold - 1e-5].tolist(), q[bound >= self.threshold - 1e-5].tolist(), strict=True):
                    cos, t = self.exact(h[ends[i] - size[i] : ends[j - 1]])
                    if cos >= self.threshold:
                        found.setdefault(int(doc[i]), []).append((-cos, j - i, i, t, j))
        for d, hits in found.items():
            covered = {k for _, _, i, _, j in hits for k in range(i, j)}
            cos, _, _, t, _ = min(hits)
            mine = size[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            out[d] = self.licences[t], -cos, sum(int(size[k]) for k in covered) / int(mine.sum())
        return out


def own_licences(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` without its text, with licence, similarity and share: of each row what its own text says."""
    small_batches(docs.sparkSession)
    new = ("licence", "similarity", "share")
    keep = [c for c in docs.columns if c != text_col and c not in new]
    fixed = list(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(fixed, threshold)
        for b in parts(batches, text_col, 1 << 20):
            found = scanner.scan([t if t is None else t.encode() for t in b.column(text_col).to_pylist()])
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *new])

    kind = T.StructType([*(docs.schema[c] for c in keep), T.StructField("licence", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("share", T.DoubleType())])
    return docs.select(*keep, text_col).mapInArrow(run, kind)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, as array<struct<depth, dir>>; the root is the empty string at depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))


def scan(
    docs: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """``docs`` without its text, with licence, similarity, origin ('own', 'inherited' or null) and from_dir."""
    cuts = Cuts(docs.sparkSession, "licences")
    new = ("licence", "similarity", "origin", "from_dir")
    keep = [c for c in docs.columns if c != text_col and c not in new]
    own = own_licences(docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text")), "text", threshold, templates)
    path = F.col(f"c{keep.index(path_col)}")
    at = F.filter(F.split(path, "/"), lambda x: x != "")
    files = cuts.cut(own.select("*", F.array_join(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), "/").alias("_dir"), F.coalesce(F.rlike(path, F.lit(NAMES)), F.lit(False)).alias("_named")))
    of_file = F.col("licence").isNotNull() & F.col("_dir").isNotNull() & (F.col("_named") | (F.col("share") >= FILE_SHARE))
    first = F.min(F.struct((~F.col("_named")).alias("n"), (F.lit(0) - F.col("similarity")).alias("s"), "licence")).alias("b")
    of_dir = files.where(of_file).groupBy(F.col("_dir").alias("dir")).agg(first).select("dir", "b.licence", (F.lit(0) - F.col("b.s")).alias("similarity"))
    up = files.where("_dir is not null").select("_dir").distinct().select("_dir", F.explode(ancestors(F.col("_dir"))).alias("a")).select("_dir", "a.depth", "a.dir")
    near = cuts.cut(up.join(of_dir, "dir").groupBy("_dir").agg(F.max(F.struct("depth", "dir", F.col("licence").alias("l"), F.col("similarity").alias("s"))).alias("up")))
    has = F.col("licence").isNotNull()
    return files.join(near, "_dir", "left").select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.coalesce("licence", "up.l").alias("licence"), F.coalesce("similarity", "up.s").alias("similarity"),
        F.when(has, "own").when(F.col("up").isNotNull(), "inherited").alias("origin"), F.when(~has, F.col("up.dir")).alias("from_dir"),
    )
