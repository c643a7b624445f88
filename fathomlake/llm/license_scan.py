"""License scan: templates found by MinHash bands over overlapping windows, verified by containment.

A document and the templates are sequences of five-word shingles (words: runs of letters and
digits, lower-cased). Templates are classed by length, up to C = 1, 2, 4, ... shingles; a class is
looked for in windows of 2 C shingles that begin every C, so that any run of a template's length
lies in one window. A window that holds 80 % of a template has a Jaccard similarity of 0.19 or
more with it; with BANDS bands of one row each they collide in at least one with a probability of
1 - (1 - 0.19) ** 64 > 0.99999. Windows that collide are compared shingle by shingle. A block that
holds no shingle of any template is passed over first.

Templates of fewer than five words are taken on request (``short``): each is one shingle of all its
words, and found wherever these stand in a row.

The values of all bands of a class are one sorted array: a window is looked up in it band by band, behind
a sieve of the values' low bits, so the work for a window does not grow with the number of templates.

Templates are given, and each document is scanned by itself, block by block: no shuffle, memory
bounded by a block and TOGETHER templates. More templates are scanned for in further passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import shingle_sequence

SIZE, PERCENT, BANDS = 5, 80, 64
BLOCK = 1 << 15
#: Templates that one pass over the documents carries to its tasks.
TOGETHER = 2000

#: Public licence notices. Any other table of (id, text) can be scanned for.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
)

#: More license bodies and notices.
MORE = (
    ("BSD-conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                       "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                       "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                        "products derived from this software without specific prior written permission."),
    ("BSD-disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                       "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                       "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                       "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
                       "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
                       "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
                       "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her "
                "rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
)
#: Notices of fewer than five words.
SHORT = (
    ("all-rights-reserved", "All rights reserved."), ("MIT-short", "MIT License"), ("Apache-short", "Apache License"), ("BSD-short", "BSD License"),
    ("ISC-short", "ISC License"), ("GPL-short", "GNU General Public License"), ("MPL-short", "Mozilla Public License"),
    ("Unlicense-SPDX", "SPDX-License-Identifier: Unlicense"), ("MIT-SPDX", "SPDX-License-Identifier: MIT"), ("ISC-SPDX", "SPDX-License-Identifier: ISC"),
)
#: SPDX lines of more words than four.
SPDX = tuple(
    (f"{name}-SPDX", f"SPDX-License-Identifier: {name}")
    for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0")
)
#: All that is scanned for by the query; with ``short``.
ALL = (*TEMPLATES, *MORE, *SPDX, *SHORT)

SCHEMA = "license_id string, matched long, shingles long, containment double, start_word long, end_word long"
_word = re.compile(r"\w+").findall
_rng = np.random.RandomState(20240101)
_A = (_rng.randint(0, 1 << 31, BANDS).astype(np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
_B = _rng.randint(0, 1 << 31, BANDS).astype(np.uint32)[None, :]
_BAND = np.arange(BANDS, dtype=np.uint64)


def sequence(text: str, size: int) -> np.ndarray:
    """The shingles of a text in order, none if it has fewer words."""
    words = [w.encode() for w in _word(text.lower())]
    return shingle_sequence(words, size) if len(words) >= size else np.zeros(0, np.uint64)


def _hashed(shingles: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes per shingle, whose minima over a set are its MinHash."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None] * _A + _B
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


class _Bands:
    """The index of a class: which templates have a value of a band. ``least`` is a row of BANDS minima per template."""

    def __init__(self, least: np.ndarray):
        values = (_BAND << np.uint64(32) | least).ravel()
        order = np.argsort(values, kind="stable")
        self._values, self._templates = values[order], order // BANDS
        self._low = np.uint32((1 << max(12, len(least).bit_length() + 6)) - 1)
        self._sieve = np.zeros((BANDS, int(self._low) + 1), bool)
        self._sieve[_BAND.astype(np.intp), least & self._low] = True

    def collisions(self, windows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, window) of each pair that shares a value in a band or more, in order."""
        window, band = np.nonzero(self._sieve[_BAND.astype(np.intp), windows & self._low])
        if not len(window):
            return iter(())
        asked = band.astype(np.uint64) << np.uint64(32) | windows[window, band]
        first, end = (np.searchsorted(self._values, asked, side) for side in ("left", "right"))
        n = end - first
        place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        pairs = np.unique(np.stack([self._templates[place], np.repeat(window, n)]), axis=1)
        return zip(*pairs.tolist(), strict=True)


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], size: int = SIZE, percent: int = PERCENT, short: bool = False):
        self.size, self.percent, self.classes, self.short = size, percent, {}, []
        for name, text in templates:
            found = np.unique(sequence(text, size))
            words = _word(text.lower())
            if short and 0 < len(words) < size:
                self.short.append((name, f" {' '.join(words)} ", len(words)))
                continue
            if not len(found):
                raise ValueError(f"template {name!r} has fewer than {size} words")
            c = 1 << (len(found) - 1).bit_length()
            self.classes.setdefault(c, []).append((name, found))
        self.bands = {c: _Bands(np.stack([_hashed(t[1]).min(axis=0) for t in ts])) for c, ts in self.classes.items()}
        self.known = np.unique(np.concatenate([t[1] for ts in self.classes.values() for t in ts] or [np.zeros(0, np.uint64)]))

    def _short(self, text: str) -> list[tuple]:
        low = text.lower()
        said = None
        found = []
        for name, wanted, n in self.short:
            if not all(w in low for w in wanted.split()):
                continue
            said = f" {' '.join(_word(low))} " if said is None else said
            at = said.find(wanted)
            start, last = 0, 0
            while at >= 0:
                start, last = start + said.count(" ", last, at), at
                found.append((name, 1, 1, 1.0, start, start + n))
                at = said.find(wanted, at + len(wanted) - 1)  # the space between two matches is of both
        return found

    def _places(self, hits: dict[int, int], name: str, n: int, reach: int) -> list[tuple]:
        """Every match among ``hits`` (shingles by place), none of which overlap: runs of up to ``reach`` places."""
        found: list[tuple] = []
        run: dict[int, int] = {}  # places by shingle, in order of place
        free = 0

        def close() -> bool:
            nonlocal run, free
            if 100 * len(run) < self.percent * n:
                return False
            places = list(run.values())
            free = places[-1] + self.size
            found.append((name, len(run), n, len(run) / n, places[0], free))
            run = {}
            return True

        for at, shingle in sorted(hits.items()):
            if shingle in run or (run and at - next(iter(run.values())) >= reach):
                if not close():
                    run.pop(shingle, None)
                    while run and at - next(iter(run.values())) >= reach:
                        del run[next(iter(run))]
            if at >= free:
                run[shingle] = at
        close()
        return found

    def scan(self, text: str) -> list[tuple]:
        """(id, matched, shingles, containment, start word, end word) of each template's matches."""
        shingles = sequence(text, self.size)
        hits: dict[tuple, dict[int, int]] = {}
        longest = max(self.classes, default=1)
        step = max(BLOCK, longest)  # a power of 2, so that every class has windows that begin with the block
        for at in range(0, len(shingles), step):
            block = shingles[at : at + step + longest]
            if not np.isin(block, self.known).any():
                continue
            all_hashed = _hashed(block)
            for c, templates in self.classes.items():
                part, hashed = block[: step + c], all_hashed[: step + c]
                chunks = np.minimum.reduceat(hashed, np.arange(0, len(part), c), axis=0)
                windows = chunks.copy()
                np.minimum(windows[:-1], chunks[1:], out=windows[:-1])
                for t, k in self.bands[c].collisions(windows):
                    name, wanted = templates[t]
                    held = part[k * c : (k + 2) * c]
                    isin = np.isin(held, wanted)
                    if 100 * len(np.unique(held[isin])) >= self.percent * len(wanted):
                        where = np.flatnonzero(isin)
                        hits.setdefault((name, len(wanted), 2 * c), {}).update(zip((where + (at + k * c)).tolist(), held[where].tolist(), strict=True))
        found = [x for (name, n, reach), where in hits.items() for x in self._places(where, name, n, reach)]
        return sorted([*found, *self._short(text)])


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
    size: int = SIZE, percent: int = PERCENT, short: bool = False,
) -> DataFrame:
    """A row per document, template and place where it holds it: ``id_col`` and SCHEMA.

    ``matched`` of the template's ``shingles`` stand there; start_word and end_word (exclusive) bound
    them in the document. Places of one template do not overlap. Null and empty texts hold
    none; very long texts are scanned whole, in blocks; repeated rows and null ids give rows of their
    own; other columns play no part; an empty table gives an empty one. Templates of fewer than ``size``
    words are refused unless ``short``; without words they are refused.
    """
    if len(templates) > TOGETHER:  # what a template's matches are does not depend on other templates
        parts = (scan_licenses(docs, templates[k : k + TOGETHER], id_col, text_col, size, percent, short) for k in range(0, len(templates), TOGETHER))
        return reduce(DataFrame.unionByName, parts)
    Scanner(templates, size, percent, short)  # refuses bad templates here rather than in a task
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, size, percent, short)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = [
                    (i, *found)
                    for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
                    for found in scanner.scan(text or "")
                ]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, {SCHEMA}")
