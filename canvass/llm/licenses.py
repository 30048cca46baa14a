"""Licence texts found in documents: runs of words pick candidates, banded alignment confirms them.

Templates and texts are winnowed: of each ``WINDOW`` neighbouring runs of ``GRAM`` words only those with
the smallest hash are fingerprints, so whatever shares GRAM + WINDOW - 1 = 4 words in a row shares a
fingerprint. The templates' fingerprints are an inverted index, which travels to the tasks. A match that
lacks few enough words of a template for a coverage of 0.8 still has 4 of them in a row if the template
has 16 words or more, and at some lengths below. Where no such run is certain, and at lower coverages,
a template is indexed by every run of the length that a match must have.

A fingerprint that text and template share fixes a diagonal. Neighbouring diagonals are chained, as far as
words put into a match can lead from one to the next, and an alignment in a band about the chain finds how
many words of the template occur in order, and from where to where. Words of punctuation only, such
as the marks of comment lines, are left out of both. Words put in after every second one leave no
run of 4: a match then depends on single runs of two whose hashes are smallest in both.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import col

GRAM, WINDOW, COVERAGE = 2, 3, 0.8
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = b"\"'`.,;:!?()[]{}<>*#/|-"
REMEMBERED = 400_000

# Published licence notices, headers and texts. Of the longest texts (GPL family, Apache, MPL, CC0) the title.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
_CLAUSE_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. ")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software")
_HEADER = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public "
    "License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any "
    "later version.")
_GNU = {"GPL-2.0": ("program", "", "2"), "GPL-3.0": ("program", "", "3"), "LGPL-2.0": ("library", "Library ", "2"),
        "LGPL-2.1": ("library", "Lesser ", "2.1"), "LGPL-3.0": ("library", "Lesser ", "3"), "AGPL-3.0": ("program", "Affero ", "3")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
         "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
         "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT + ".",
    "MIT-full": _MIT + (
        ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Apache-2.0-release": "Released under the Apache License 2.0.",
    "Apache-2.0-title": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, "
        "AND DISTRIBUTION"),
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause-text": _BSD + _AS_IS,
    "BSD-3-Clause-text": _BSD + _CLAUSE_3 + _AS_IS,
    "BSD-2-Clause-conditions": _BSD.strip(),
    "BSD-3-Clause-conditions": (_BSD + _CLAUSE_3).strip(),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "CC0-1.0-notice": "This work is licensed under CC0 1.0 Universal.",
    "CC0-1.0-title": "Creative Commons Legal Code CC0 1.0 Universal",
    "GPL-2.0-only-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation."),
    "ISC": "Released under the ISC License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."),
    "MPL-2.0-title": "Mozilla Public License Version 2.0 1. Definitions",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    **{f"{name}-header": _HEADER.format(what=what, kind=kind, version=version, mark=":;"[version < "3"], comma=",;"[version < "3"])
       for name, (what, kind, version) in _GNU.items()},
    **{f"CC-{short}-{version}": f"Licensed under CC {short} {version}." for short in _CC for version in ("3.0", "4.0")},
    **{f"CC-{short}-4.0-notice": f"This work is licensed under a Creative Commons {name} 4.0 International License." for short, name in _CC.items()},
    **{f"CC-{short}-3.0-notice": f"This work is licensed under a Creative Commons {name} 3.0 Unported License." for short, name in _CC.items()},
    **{f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in _SPDX},
}
#: Words that name a licence; a match has all of its template's, and all version numbers with a dot.
TELLING = {"affero", "apache", "bsd", "bsd-style", "cc", "cc0", "commons", "creative", "gnu", "isc", "lesser", "mit", "mozilla", "mpl"}
VERSION = re.compile(rb"\d+(\.\d+)+")


def word_hash(word: bytes) -> int:
    """Of the word without punctuation around it; -1 for a word of punctuation only."""
    bare = word.strip(EDGE)
    return xxhash.xxh64_intdigest(bare) >> 1 if bare else -1


def run_of(words: int, coverage: float) -> int:
    """The longest run that a match at the coverage has at least, if it only lacks words or has others for them."""
    need = min(max(math.ceil(coverage * words - 1e-9), 1), words)
    return -(-need // (words - need + 1))


def grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of each run of so many words."""
    out = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        out = (out * np.uint64(0x9E3779B97F4A7C15) + h[k: k + len(out)].astype(np.uint64))
        out ^= out >> np.uint64(29)
    return out


def fingerprints(h: np.ndarray) -> np.ndarray:
    """Places whose hash is the smallest of some window of neighbours (of all, if there are fewer)."""
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(WINDOW, len(h))
    low = np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)
    chosen = np.zeros(len(h), bool)
    for k in range(width):
        chosen[k: k + len(low)] |= h[k: k + len(low)] == low
    return np.flatnonzero(chosen)


class Index:
    """Templates, their runs by length with template and place, and a filter on the low bits of a run's hash.

    ``must`` has words that tell a template from others, and how many of them a match needs: all words of TELLING and
    VERSION, and those that a sibling lacks, a template whose text would reach the coverage. Of up to four such words
    the naming ones are needed, or all if none of them is one; of more, the share that is the coverage.
    """

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE) -> None:
        hashes = {n: np.array([word_hash(w) for w in t.encode().lower().split()], np.int64) for n, t in sorted(templates.items())}
        self.words = {n: h[h >= 0] for n, h in hashes.items() if (h >= 0).any()}
        self.places, self.low, self.thinned = {}, {}, set()
        naming = {word_hash(w) for t in templates.values() for w in t.encode().lower().split()
                  if w.strip(EDGE).decode() in TELLING or VERSION.fullmatch(w.strip(EDGE)) or w.strip(EDGE).isdigit()}
        whole = {word_hash(w) for t in templates.values() for w in t.encode().lower().split() if w.strip(EDGE).isdigit()}
        counts = {n: Counter(h.tolist()) for n, h in self.words.items()}
        self.must = {}
        for name, h in self.words.items():
            needs = [(np.array([w for w in counts[name] if w in naming - whole], np.int64), 1.0)]
            for other, have in counts.items():
                lacks = np.array(list((counts[name] - have).elements()), np.int64)
                if other != name and 0 < len(lacks) <= (1 - coverage) * len(h) + 1e-9:
                    told = lacks[[w in naming for w in lacks.tolist()]]
                    needs.append((lacks, coverage) if len(lacks) > 4 else (told if len(told) else lacks, 1.0))
            self.must[name] = list({(tuple(sorted(w.tolist())), c): (w, c) for w, c in needs if len(w)}.values())
        for name, h in self.words.items():
            run = run_of(len(h), coverage)
            thin = run >= GRAM + WINDOW - 1
            size = GRAM if thin else min(run, GRAM + 1)
            g = grams(h, size)
            if thin:
                self.thinned.add(name)
            places = self.places.setdefault((size, thin), defaultdict(list))
            for k in fingerprints(g).tolist() if thin else range(len(g)):
                places[int(g[k])].append((name, k))
        for key, places in self.places.items():
            self.low[key] = np.zeros(1 << 16, bool)
            self.low[key][[p & 0xFFFF for p in places]] = True

    def candidates(self, h: np.ndarray) -> dict[str, list[tuple[int, int]]]:
        """Per template the places in the text where it may begin, and how far its diagonal may drift from there."""
        found = defaultdict(set)
        for (size, thin), places in self.places.items():
            g = grams(h, size)
            hit = self.low[size, thin][(g & np.uint64(0xFFFF)).astype(np.int64)]
            if thin and hit.any():
                chosen = np.zeros(len(g), bool)
                chosen[fingerprints(g)] = True
                hit &= chosen
            for k in np.flatnonzero(hit).tolist():
                for name, place in places.get(int(g[k]), ()):
                    found[name].add(k - place)
        return {name: chains(sorted(begins), len(self.words[name])) for name, begins in found.items()}


def band_of(words: int) -> int:
    """Words by which an alignment may leave its diagonal: a quarter of the template's, 2 at least."""
    return max(2, words // 4)


def chains(begins: list[int], words: int) -> list[tuple[int, int]]:
    """Sorted diagonals as chains: middle and half width. Neighbours in a chain are half a band apart at most.

    A chain drifts by as many words as the template has at most; a longer one becomes several that overlap by half.
    """
    out, step, at = [], band_of(words) // 2, 0
    for k in range(1, len(begins) + 1):
        if k == len(begins) or begins[k] - begins[k - 1] > step:
            low, high = begins[at], begins[k - 1]
            while high - low > words:
                out.append((low + words // 2, words // 2 + 1))
                low += words // 2 + 1
            out.append(((low + high) // 2, (high - low + 1) // 2))
            at = k
    return out


def shared(template: np.ndarray, text: np.ndarray) -> int:
    """Words that both have, in any order."""
    have = Counter(text.tolist())
    return sum(min(n, have[w]) for w, n in Counter(template.tolist()).items())


def align(template: np.ndarray, text: np.ndarray, begin: int, band: int) -> tuple[int, int, int]:
    """Words of the template that occur in order near the diagonal that begins at ``begin``; first word and last + 1.

    The best alignment has the most matches, then the shortest span, then the beginning nearest the diagonal.
    """
    lowest, width = begin - band, 2 * band + 1
    none = (0, 0, -1, -1)
    row = [none] * width  # cell d of row i stands for text position lowest + i + d
    best = none
    at = {k: int(text[k]) for k in range(max(lowest, 0), min(lowest + len(template) + width, len(text)))}
    for i, word in enumerate(template.tolist()):
        new = []
        for d in range(width):
            j = lowest + i + d
            # row[d] is (i - 1, j - 1), row[d + 1] is (i - 1, j), new[d - 1] is (i, j - 1)
            options = [row[d]] if j >= 0 else [none]
            if at.get(j) == word:
                m, g, first, _ = options[0]
                options.append((m + 1, g, j if first < 0 else first, j + 1))
            if d + 1 < width:
                options.append(row[d + 1])
            if new:
                m, g, first, last = new[-1]
                options.append((m, g - (first >= 0), first, last))
            new.append(max(options, key=lambda o: (o[0], o[1], -o[3])))
        row = new
        top = max(row, key=lambda o: (o[0], -(o[3] - o[2]), -abs(o[2] - begin)))
        best = max(best, top, key=lambda o: (o[0], -(o[3] - o[2]), -abs(o[2] - begin)))
    return best[0], best[2], best[3]


class Scanner:
    def __init__(self, index: Index, coverage: float) -> None:
        self.index, self.coverage, self.known = index, coverage, {}

    def hashes(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in text.encode().lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = word_hash(w)
            out.append(h)
        return np.array(out, np.int64)

    def __call__(self, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
        """Template, coverage, matched words, words of the template, first and last + 1 code point."""
        if not text:
            return []
        h = self.hashes(text)
        word = np.flatnonzero(h >= 0)
        h = h[word]
        found = []
        for name, begins in self.index.candidates(h).items():
            template = self.index.words[name]
            need = self.coverage * len(template)
            for begin, drift in begins:
                band = band_of(len(template)) + drift
                if shared(template, h[max(begin - band, 0): max(begin + len(template) + band + 1, 0)]) < need:
                    continue
                matched, first, last = align(template, h, begin, band)
                if matched >= need and all(shared(w, h[first:last]) >= c * len(w) for w, c in self.index.must[name]):
                    found.append((matched / len(template), matched, name, first, last))
        # Of overlapping finds the one with more matched words counts, unless its coverage is lower.
        found.sort(key=lambda f: (-f[0], -f[1], f[2], f[3]))
        taken = []
        for f in sorted(found, key=lambda f: (-f[1] * f[0], f[2], f[3])):
            if all(f[4] <= t[3] or f[3] >= t[4] for t in taken):
                taken.append(f)
        if not taken:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        return [(n, c, m, len(self.index.words[n]), spans[word[a]][0], spans[word[b - 1]][1]) for c, m, n, a, b in sorted(taken, key=lambda f: f[3])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence found: doc_id, license, coverage, matched, template_words, start, stop.

    Whole texts are scanned; ``start`` and ``stop`` count code points. A template without
    words is never found; texts without licences, null and empty ones give no row; repeated rows give
    repeated results. Other columns are not read.
    """
    index = Index(TEMPLATES if templates is None else templates, coverage)
    schema = "array<struct<license string, coverage double, matched int, template_words int, start int, stop int>>"

    @F.pandas_udf(schema)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(index, coverage)
        names = ("license", "coverage", "matched", "template_words", "start", "stop")
        for texts in batches:
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in scanner(t)] for t in texts], dtype=object)

    return docs.select(col(id_col).alias("doc_id"), find(col(text_col)).alias("finds")).select("doc_id", F.inline("finds"))
