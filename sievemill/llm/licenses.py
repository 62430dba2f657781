"""License scans: winnowed fingerprints of license templates in an inverted index pick candidate
places, banded sequence alignment then measures how much of a template stands there.

Words that no template has cannot match, so a text is read as the templates' word numbers and
all steps are on numbers. The index is broadcast: templates are an argument, at most MAX_WORDS of them."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, byte_rows

#: Words of a fingerprint, and fingerprints of which one at least is kept: any GRAM + WINDOW - 1
#: words in common are found.
GRAM, WINDOW = 3, 3
#: Insertions and deletions that an alignment may have beside its diagonal: a share of the
#: template's words, and at least so many.
BAND_SHARE, BAND_LEAST = 0.1, 4
#: Share of a template's words that has to be matched.
COVERAGE = 0.8
MAX_WORDS = 2_000_000

# The notices' own words.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("LGPL-2.1-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]


def hashed(ids: np.ndarray) -> np.ndarray:
    """A number for each run of GRAM words; the largest where a word is 0."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        word = ids[k : k + n].astype(np.uint64)
        out = (out * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        known &= ids[k : k + n] > 0
    return np.where(known, out, np.uint64(2**64 - 1))


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the kept fingerprints: the least of each window, the last if several are;
    all there is of fewer than a window."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = min(WINDOW, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.unique(np.arange(len(windows)) + width - 1 - windows.argmin(axis=1))


class Templates:
    """Templates as word numbers, and the inverted index of their fingerprints."""

    def __init__(self, rows: Sequence[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        texts = {(name, tuple(number(w, len(self.vocabulary) + 1) for w in alnum_words(text.encode()))) for name, text in rows if name is not None and text}
        texts = sorted((t for t in texts if t[1]), key=lambda t: (t[0], t[1]))
        if sum(len(t[1]) for t in texts) > MAX_WORDS:
            raise ValueError(f"templates of more than {MAX_WORDS} words")
        self.names, self.words = [t[0] for t in texts], [np.array(t[1], np.int32) for t in texts]
        found = [(h, i, p) for i, w in enumerate(self.words) for h, p in self._prints(w)]
        found.sort()
        self.hashes = np.array([f[0] for f in found], np.uint64)
        self.template = np.array([f[1] for f in found], np.int64)
        self.place = np.array([f[2] for f in found], np.int64)
        self.short = [i for i, w in enumerate(self.words) if len(w) < GRAM]

    @staticmethod
    def _prints(words: np.ndarray) -> list[tuple[int, int]]:
        hashes = hashed(words)
        return [(int(hashes[p]), int(p)) for p in winnowed(hashes)]


def aligned(template: np.ndarray, words: np.ndarray, diagonal: int, band: int, least: float = 0, first: int = 0, end: int | None = None) -> tuple[int, int, int]:
    """Best alignment of a whole template within ``band`` of a diagonal (text place minus
    template place): matched words, first and end place in the text. Words count for
    the alignment only if they are equal and in order; of equal scores the shorter span stands. Only text places from ``first`` to
    ``end`` count. Without a chance of ``least`` matched words it gives none."""
    m, width = len(template), 2 * band + 1
    end = len(words) if end is None else min(end, len(words))
    matched = np.zeros(width, np.int64)  # by offset from the diagonal, after i template words
    start = np.full(width, -1, np.int64)  # first matched place, negative if none
    stop = np.full(width, -1, np.int64)
    offsets, order = np.arange(width) - band, np.arange(width)

    def key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return a * (1 << 32) - (c - b)

    for i in range(m):
        at = diagonal + i + offsets
        ok = (at >= first) & (at < end)
        equal = np.zeros(width, bool)
        equal[ok] = words[at[ok]] == template[i]
        new = matched + equal, np.where(equal & (start < 0), at, start), np.where(equal, at + 1, stop)
        # leaving out a template word moves one offset down, a text word one up
        down = [np.append(x[1:], y) for x, y in ((matched, 0), (start, -1), (stop, -1))]
        better = key(*down) > key(*new)
        new = [np.where(better, d, n) for d, n in zip(down, new, strict=True)]
        value = key(*new)
        highest = np.maximum.accumulate(value)
        own = np.append(True, value[1:] >= highest[:-1])  # none before it is better: it keeps its own
        taken = np.maximum.accumulate(np.where(own, order, 0))
        matched, start, stop = (x[taken] for x in new)
        if matched.max() + m - 1 - i < least:
            return 0, -1, -1
    best = int(key(matched, start, stop).argmax())
    return int(matched[best]), int(start[best]), int(stop[best])


def reach(size: int, band: int, coverage: float) -> int:
    """How far an alignment can get from the diagonal of one of its words: by all template words that may be missing, and by as many others and
    ``band`` more that its span has room for."""
    return size - int(coverage * size) + band


def placed(template: np.ndarray, words: np.ndarray, diagonal: int, band: int, least: float, limit: int) -> tuple[int, int, int] | None:
    """The best alignment of at least ``least`` words that spans at most ``limit``, None if there is none.

    If the best one of all is wider, some of its words stand apart: each window of ``limit`` words about it is aligned for itself, and
    the best of these stands."""
    found = aligned(template, words, diagonal, band, least)
    if found[0] == 0 or found[0] < least:
        return None
    if found[2] - found[1] <= limit:
        return found
    narrow = [aligned(template, words, diagonal, band, least, a, a + limit) for a in range(max(0, found[1] - band), found[2] - limit + band + 1)]
    narrow = [f for f in narrow if f[0] and f[0] >= least]
    return min(narrow, key=lambda f: (-f[0], f[2] - f[1], f[1])) if narrow else None


def scan(text: bytes | None, templates: Templates, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, first word, end word, matched words) of each place where enough of a template
    stands; of overlapping places of one template the best, of equal ones the first."""
    words = alnum_words(text or b"")
    ids = np.fromiter(map(templates.vocabulary.get, words, repeat(0)), np.int32, len(words))
    out: list[tuple[int, int, int, int]] = []
    hashes = hashed(ids)
    kept = np.flatnonzero(np.isin(hashes, templates.hashes)) if len(hashes) and len(templates.hashes) else np.zeros(0, np.int64)
    candidates: set[tuple[int, int]] = {(i, int(p)) for i in templates.short for p in np.flatnonzero(ids == templates.words[i][0])}
    if len(kept):
        near = np.zeros(len(hashes), bool)  # windows that may keep a template's fingerprint
        for k in range(-WINDOW + 1, WINDOW):
            near[np.clip(kept + k, 0, len(hashes) - 1)] = True
        own = np.intersect1d(winnowed(np.where(near, hashes, np.uint64(2**64 - 1))), kept)
        low, high = np.searchsorted(templates.hashes, hashes[own], "left"), np.searchsorted(templates.hashes, hashes[own], "right")
        count = high - low
        slot = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        candidates |= set(zip(templates.template[slot].tolist(), (np.repeat(own, count) - templates.place[slot]).tolist(), strict=True))
    for i, diagonal in list(candidates):
        band = max(BAND_LEAST, int(BAND_SHARE * len(templates.words[i])))
        if len(templates.words[i]) <= 3 * band:  # several copies may stand within a band
            candidates |= {(i, diagonal + k) for k in range(-band, band + 1)}
    places: list[tuple[int, int, int]] = []  # template, first and last diagonal of candidates that are aligned together
    for i, diagonal in sorted(candidates):
        band = max(BAND_LEAST, int(BAND_SHARE * len(templates.words[i])))
        if len(templates.words[i]) <= 3 * band:
            places.append((i, diagonal, diagonal))
            continue
        if places and places[-1][0] == i and diagonal - places[-1][1] <= band // 2:
            places[-1] = (i, places[-1][1], diagonal)
        else:
            places.append((i, diagonal, diagonal))
    seen: set[tuple[int, int, int, int]] = set()
    for i, first, last in places:
        template = templates.words[i]
        band = max(BAND_LEAST, int(BAND_SHARE * len(template)))
        # the reach of each of the diagonals lies within that about the middle
        found = placed(template, ids, (first + last) // 2, reach(len(template), band, coverage) + (last - first + 1) // 2, coverage * len(template), len(template) + band)
        if found:
            seen.add((i, found[1], found[2], found[0]))
    out += seen
    best: list[tuple[int, int, int, int]] = []
    spans: dict[int, list[tuple[int, int]]] = {}  # of each template, apart from each other and in order
    for found in sorted(out, key=lambda f: (f[0], -f[3], f[2] - f[1], f[1])):
        own = spans.setdefault(found[0], [])
        at = bisect.bisect(own, (found[1], found[2]))
        if (at == 0 or own[at - 1][1] <= found[1]) and (at == len(own) or found[2] <= own[at][0]):
            own.insert(at, (found[1], found[2]))
            best.append(found)
    return sorted(best, key=lambda f: (f[1], f[2], f[0]))


_MATCH = "struct<license:string,coverage:double,start:int,stop:int>"


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """All columns of ``docs`` and license_matches array<struct<license, coverage, start, stop>>:
    templates of which at least ``coverage`` of the words stand in the text in order, and the words
    (from 0) they span, by place.

    Null and empty texts have none. Texts of any length are read whole. Templates without a name or words
    are left out; two texts under one name are two templates. Repeated documents give a row each. No rows: no
    rows. A column named license_matches is replaced."""
    base = docs.drop("license_matches")
    shared, spot = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates)), base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("license_matches", T._parse_datatype_string(f"array<{_MATCH}>"))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [
                [{"license": own.names[i], "coverage": matched / len(own.words[i]), "start": a, "stop": b} for i, a, b, matched in scan(t, own, coverage)]
                for t in byte_rows(batch.column(spot))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], schema.names)

    return base.mapInArrow(run, schema)


def license_rows(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each match: doc_id, license, coverage, start, stop."""
    found = scan_licenses(docs, **options)
    return found.select(F.col(doc_id).alias("doc_id"), F.explode("license_matches").alias("m")).select("doc_id", "m.*")
