"""License scan by patience alignment.

Words (ASCII letters and digits, all non-ASCII; A-Z lower-cased) of a text are
aligned with each license template: words that occur once in both are anchors,
the longest increasing subsequence of their places is kept, and the gaps between
them are aligned in the same way; a gap without anchors matches its common
prefix and suffix.  Coverage is the matched share of the template's words; a
region with at least ``COVERAGE`` is a finding if it also bears the license's name:
the phrases in ``REQUIRED`` stand in it word for word, none in ``FORBIDDEN`` does
(so "GNU Lesser General Public License, version 3" is no finding of the GPL).

Which regions to align follows from the threshold alone: a region of at most
``STRETCH`` times the template's length that covers it must hold that many words
of the template's vocabulary, so stretches with fewer are skipped.  Findings of
one template do not overlap; the leftmost region comes first.

The templates are a parameter (name -> text); their vocabulary goes to every
task.  Texts are scanned whole, each within its partition, without a shuffle.

Defined results: null and empty texts have no findings (n_licenses 0, empty
strings).  Templates without words are ignored.  A null doc_id stays null,
repeated rows are scanned each.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import Slice, signed, slices
from .common import small_batches, table
from .quality_classifier import _NOT_WORD

COVERAGE = 0.8
STRETCH = 1.5

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software.")
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
_BSD_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                "that the following conditions are met:")
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission.")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(kind: str, work: str, version: str) -> str:
    return (f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later "
            f"version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
            f"GNU {kind} License for more details.")


# Public license statements and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT + " " + _AS_IS + (
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."),
    "MIT-permission": _MIT,
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."),
    "ISC": "Released under the ISC License.",
    "BSD-2-Clause": f"{_BSD_OPENING} {_BSD_TWO} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_OPENING} {_BSD_TWO} {_BSD_NAME} {_BSD_END}",
    "BSD-opening": _BSD_OPENING,
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-notice": _gnu("General Public", "program", "2"),
    "GPL-3.0-notice": _gnu("General Public", "program", "3"),
    "LGPL-2.1-notice": _gnu("Lesser General Public", "library", "2.1"),
    "LGPL-3.0-notice": _gnu("Lesser General Public", "library", "3"),
    "AGPL-3.0-notice": _gnu("Affero General Public", "program", "3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
}
# Phrases that have to stand in a finding word for word, and such that may not.
REQUIRED = {
    "Apache-2.0": ["apache license version 2 0"], "Apache-2.0-header": ["apache license version 2 0"],
    "MIT": ["mit license"], "ISC": ["isc license"], "MPL-2.0": ["mozilla public license"],
    "GPL-2.0": ["gnu general public license version 2"], "GPL-3.0": ["gnu general public license version 3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1"], "LGPL-3.0": ["gnu lesser general public license version 3"],
    "AGPL-3.0": ["gnu affero general public license version 3"],
    "GPL-2.0-notice": ["gnu general public license", "version 2 of"], "GPL-3.0-notice": ["gnu general public license", "version 3 of"],
    "LGPL-2.1-notice": ["gnu lesser general public license", "version 2 1 of"],
    "LGPL-3.0-notice": ["gnu lesser general public license", "version 3 of"],
    "AGPL-3.0-notice": ["gnu affero general public license", "version 3 of"],
    "CC-BY-4.0": ["creative commons attribution 4 0"], "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0"],
    "CC-BY-NC-4.0-name": ["creative commons attribution noncommercial 4 0"], "CC-BY-NC-4.0": ["cc by nc 4 0"],
    "CC-BY-4.0-short": ["cc by 4 0"], "CC-BY-SA-4.0-short": ["cc by sa 4 0"], "BSD-3-Clause": ["neither the name"],
}
FORBIDDEN = {"BSD-2-Clause": ["neither the name"]}


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, int] = {}
        for k in range(a0, a1):
            once[a[k]] = -1 if a[k] in once else k
        places: dict[int, int] = {}
        for k in range(b0, b1):
            places[b[k]] = -1 if b[k] in places else k
        pairs = [(k, once[w]) for w, k in places.items() if k >= 0 and once.get(w, -1) >= 0]
        pairs.sort()
        tops: list[int] = []                       # patience piles: least last place in a
        ends: list[int] = []
        back = [-1] * len(pairs)
        for n, (_, x) in enumerate(pairs):
            pile = bisect.bisect_left(tops, x)
            back[n] = ends[pile - 1] if pile else -1
            tops[pile:pile + 1], ends[pile:pile + 1] = [x], [n]
        anchors = []
        n = ends[-1] if ends else -1
        while n >= 0:
            anchors.append((pairs[n][1], pairs[n][0]))
            n = back[n]
        if not anchors:
            continue
        anchors.reverse()
        out += anchors
        left = (a0, b0)
        for x, y in [*anchors, (a1, b1)]:
            todo.append((left[0], x, left[1], y))
            left = (x + 1, y + 1)
    return sorted(out)


class Templates:
    def __init__(self, templates: dict[str, str], coverage: float, stretch: float, required: dict[str, list[str]],
                 forbidden: dict[str, list[str]]):
        self.names, self.words = [], []
        for name, own in zip(templates, _hashed(list(templates.values())), strict=True):
            if own:
                self.names.append(name)
                self.words.append(own)
        self.required, self.forbidden = ([_hashed(phrases.get(n, [])) for n in self.names] for phrases in (required, forbidden))
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], np.int64))
        self.member = np.zeros((len(self.names), len(self.vocabulary)), bool)
        for k, t in enumerate(self.words):
            self.member[k, np.searchsorted(self.vocabulary, t)] = True
        self.least = [math.ceil(coverage * len(t)) for t in self.words]
        self.span = [math.ceil(stretch * len(t)) for t in self.words]
        self.coverage = coverage


    def bears_name(self, k: int, region: list[int]) -> bool:
        def has(phrase: list[int]) -> bool:
            return any(region[i:i + len(phrase)] == phrase for i in range(len(region) - len(phrase) + 1))

        return all(map(has, self.required[k])) and not any(map(has, self.forbidden[k]))


def _hashed(texts: list[str]) -> list[list[int]]:
    """The words of each text."""
    out = []
    for s in slices([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})], limit=1 << 30):
        h, _, _, first = _words(s)
        out += [h[first[k]:first[k + 1]].tolist() for k in range(s.n)]
    return out


def _words(s: Slice):
    s.lower()
    starts, ends, first = s.segments(_NOT_WORD)
    return signed(s.hashes(starts, ends)), starts, ends, first


def _findings(t: Templates, h: np.ndarray, first: np.ndarray):
    """(row, template, first word, last word + 1, coverage) per finding."""
    if not len(t.vocabulary) or not len(h):
        return
    code = np.minimum(np.searchsorted(t.vocabulary, h), len(t.vocabulary) - 1)
    place = np.flatnonzero(t.vocabulary[code] == h)
    code = code[place]
    for k, least in enumerate(t.least):
        own = place[t.member[k, code]]
        if len(own) < least:
            continue
        dense = np.flatnonzero(own[least - 1:] - own[:len(own) - least + 1] < t.span[k])
        rows = np.searchsorted(first, own[dense], "right") - 1
        done = -1
        for at, row in zip(own[dense].tolist(), rows.tolist(), strict=True):
            if at < done:
                continue
            end = min(at + t.span[k], int(first[row + 1]))
            pairs = align(h[at:end].tolist(), t.words[k])
            share = len(pairs) / len(t.words[k])
            if share >= t.coverage:
                first_word, last = at + pairs[0][0], at + pairs[-1][0] + 1
                if t.bears_name(k, h[first_word:last].tolist()):
                    done = last
                    yield row, k, first_word, done, share


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE,
         stretch: float = STRETCH, required: dict[str, list[str]] | None = None, forbidden: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (distinct names,
    sorted), spans (name:start:end:coverage in percent by start, code points),
    best_coverage."""
    model = Templates(TEMPLATES if templates is None else templates, coverage, stretch,
                      REQUIRED if required is None else required, FORBIDDEN if forbidden is None else forbidden)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        t = shared.value
        for s in slices(batches):
            h, starts, ends, first = _words(s)
            found: dict[int, list] = {}
            for row, k, a, b, share in _findings(t, h, first):
                base = int(s.off[row])
                lo = int(((s.buf[base:starts[a]] & 0xC0) != 0x80).sum())
                hi = lo + int(((s.buf[starts[a]:ends[b - 1]] & 0xC0) != 0x80).sum())
                found.setdefault(row, []).append((lo, t.names[k], hi, share))
            each = [sorted(found.get(r, ())) for r in range(s.n)]
            yield pa.RecordBatch.from_arrays([
                s.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in each], pa.int64()),
                pa.array([",".join(sorted({y[1] for y in x})) for x in each]),
                pa.array([",".join(f"{n}:{lo}:{hi}:{round(100 * c)}" for lo, n, hi, c in x) for x in each]),
                pa.array([max((y[3] for y in x), default=0.0) for x in each])],
                ["doc_id", "n_licenses", "licenses", "spans", "best_coverage"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_licenses long, licenses string, spans string, best_coverage double")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
