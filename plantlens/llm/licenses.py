"""License scan by patience alignment.

Words are runs of ASCII letters and digits (A-Z folded) and non-ASCII bytes; "licence" counts as "license". Two tables are searched:

* TEMPLATES: whole license texts and the headers that licenses ask for. A template of L words is aligned with windows of 2 L words, one
  starting at every L-th word of a text, so each contiguous copy lies in a window, and with windows of 5/4 L words inside those, which
  hold one whole copy at most. In a window, words that occur once in both sides are anchors; the longest run of anchors that rises on
  both sides is kept, and the gaps between them are aligned the same way, after equal words at their ends. Only windows with enough
  words of the template's vocabulary are aligned, which drops no window that could reach ``least``. The phrases in MUST tell a text
  from its relatives (name, version, a clause of its own) and have to be matched without a gap.
* NAMES: the names of licenses, with their versions, for notices of a line. A notice is a whole name, its words side by side, behind one of
  LEADS, of which a part may be missing but not "under", or an SPDX identifier. Of the names at a place the longest counts; a
  name that goes on after a point or hyphen (3.1 for 3, MIT-0 for MIT) is another one.

Coverage is the share of template words that are matched; a template is found where it reaches ``least``. Every place is returned; a word of the
text belongs to one place only, first to those with the most matched and the fewest foreign words, so a notice inside a whole text is
part of that text.

Defined results: null text has no words; a text without a found template has an empty list; a license is one entry of the list, with its
place of the highest coverage (the first of equal ones) and all its places in order; repeated rows get equal results; an empty table gives no
rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEXTS
from .words import ALNUM, GRAM, Words, flat, slices, text_of

LEAST = 0.8
PLACE = "coverage double, start int, end int, matched int"
FOUND = f"doc_id bigint, n_words bigint, found array<struct<license string, {PLACE}, places array<struct<{PLACE}>>>>"
SLACK = 2  # foreign words inside a lead
SAME = {"licence": "license", "licenced": "licensed"}


def _gnu(kind: str, short: str, versions: str) -> dict[str, list[str]]:
    named = {f"{short}-{v}.0" if "." not in v else f"{short}-{v}": [v, f"{v}.0"] if "." not in v else [v] for v in versions.split()}
    full = [f"GNU {kind} License", f"GNU {short}", short]
    out = {name: [f"{f} {mark}{v}" for f in full for v in spelt for mark in ("", "v", "version ")] + [f"{short}v{v}" for v in spelt] + [f"GNU {short}v{v}" for v in spelt] for name, spelt in named.items()}
    return out | {short: [f"GNU {kind} License", f"GNU {short}", f"{short} license"]}


def _cc() -> dict[str, list[str]]:
    words = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    split = {"NonCommercial": "Non Commercial", "ShareAlike": "Share Alike", "NoDerivatives": "No Derivatives"}
    out = {}
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        long = " ".join(words[k] for k in kind.split("-"))
        apart = " ".join(split.get(words[k], words[k]) for k in kind.split("-"))
        names = [f"CC {kind}", *(f"Creative Commons {x}" for x in dict.fromkeys([long, apart, apart.replace("Derivatives", "Derivs"), kind]))]
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            tails = ["", " International", " Unported", " Generic"]
            out[f"CC-{kind}-{v}"] = [f"{n} {s}" for n in names for s in (*(v + x for x in tails), f"License {v}", f"License version {v}", f"version {v}")]
        out[f"CC-{kind}"] = names
    return out


# names as notices write them; those without a version stand for the family
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache Software License, Version 2.0", "Apache Software License 2.0", "Apache 2.0", "Apache-2.0 license", "Apache License, Version 2", "Apache License v2"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache License 1.1", "Apache Software License, Version 1.1", "Apache Software License 1.1"],
    "Apache-1.0": ["Apache License, Version 1.0", "Apache License 1.0", "Apache Software License, Version 1.0"],
    "Apache": ["Apache License", "Apache Software License"],
    "MIT": ["MIT License", "MIT/X11 License", "MIT/Expat License", "Expat License", "X11 License"],
    "MIT-0": ["MIT-0 License", "MIT No Attribution License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "two-clause BSD License", "BSD 2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "three-clause BSD License", "BSD 3-Clause"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License", "BSD 4-Clause"],
    "0BSD": ["0BSD License", "BSD Zero Clause License", "Zero-Clause BSD License"],
    "BSD": ["BSD License", "BSD-style License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons CC0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic License, Version 1.0"],
    "Artistic": ["Artistic License"],
    "MS-PL": ["Microsoft Public License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "SIL Open Font License"],
    "PSF-2.0": ["Python Software Foundation License, Version 2", "Python Software Foundation License"],
    "ODbL-1.0": ["Open Database License", "Open Database License 1.0", "ODbL 1.0", "Open Data Commons Open Database License"],
    **{f"{s}-{v}": [f"{n} {m}{v}" for n in (f"{full} License", s) for m in ("", "v", "version ")] for s, full, vs in (
        ("MPL", "Mozilla Public", "1.0 1.1 2.0"), ("EPL", "Eclipse Public", "1.0 2.0"), ("CDDL", "Common Development and Distribution", "1.0 1.1"),
        ("EUPL", "European Union Public", "1.1 1.2")) for v in vs.split()},
    "MPL": ["Mozilla Public License"],
    "EPL": ["Eclipse Public License"],
    "CDDL": ["Common Development and Distribution License"],
    "EUPL": ["European Union Public License"],
    **_gnu("General Public", "GPL", "1 2 3"),
    **_gnu("Lesser General Public", "LGPL", "2.1 3"),
    "LGPL-2.0": ["GNU Library General Public License", "GNU Library General Public License version 2", "GNU Lesser General Public License version 2", "LGPL v2", "LGPLv2", "LGPL 2.0"],
    **_gnu("Affero General Public", "AGPL", "1 3"),
    **_gnu("Free Documentation", "GFDL", "1.1 1.2 1.3"),
    **_cc(),
}
LEADS = [
    f"{who}{verb} under{what}"
    for who in ("", "This work is ", "This program is ", "This software is ", "This project is ", "This file is ")
    for verb in ("Licensed", "Released", "Distributed", "Published", "Available", "Made available", "Provided")
    for what in ("", " the", " a", " the terms of the", " the terms and conditions of the")
]
SPDX = "SPDX-License-Identifier:"

# phrases of a template that its relatives lack
MUST = {
    "MIT": ["shall be included in all"],
    "MIT-0": ["and to permit persons to whom the Software is furnished to do so. THE SOFTWARE"],
    "ISC": ["provided that the above copyright notice"],
    "0BSD": ["is hereby granted. THE SOFTWARE IS"],
    "BSD-3-Clause": ["Neither the name of"],
    "BSD-4-Clause": ["All advertising materials", "Neither the name of"],
    "Apache-2.0-header": ["Apache License, Version 2.0"],
    **{f"{short}-{v}-header": [f"GNU {kind} License as published", f"version {v.removesuffix('.0')} of the License"] for short, kind, vs in (
        ("GPL", "General Public", "2.0 3.0"), ("LGPL", "Lesser General Public", "2.1 3.0"), ("AGPL", "Affero General Public", "3.0")) for v in vs.split()},
    "MPL-2.0-header": ["Mozilla Public License, v. 2.0"],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE Version 1"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3"],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3"],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3"],
    "Apache-2.0": ["Apache License Version 2.0"],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}


def _gnu_header(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {kind} License for more details."
    )


def _bsd(third: str, fourth: str = "") -> str:
    return (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        f"documentation and/or other materials provided with the distribution. {third} {fourth} "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )


NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

# the public texts of licenses and of their headers
TEMPLATES = {
    **TEXTS,
    "BSD-2-Clause": _bsd(""),
    "BSD-3-Clause": _bsd("3. " + NO_NAMES),
    "BSD-4-Clause": _bsd("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
                         "This product includes software developed by the organization.", "4. " + NO_NAMES),
    "GPL-2.0-header": _gnu_header("General Public", "2"),
    "LGPL-2.1-header": _gnu_header("Lesser General Public", "2.1"),
    "LGPL-3.0-header": _gnu_header("Lesser General Public", "3"),
    "AGPL-3.0-header": _gnu_header("Affero General Public", "3"),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                      "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-0": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence, by piles of a patience game."""
    tops, piles, back = [], [], []
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        back.append(piles[pile - 1] if pile else -1)
        tops[pile : pile + 1], piles[pile : pile + 1] = [value], [i]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, rising on both sides."""
    matched, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if left[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if right[w] == 1 and w in place]
        anchors = [anchors[i] for i in rising([p for p, _ in anchors])]
        matched += anchors
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:])]
    return sorted(matched)


def hashes(words: Words) -> np.ndarray:
    """Word hashes, equal for the spellings in SAME."""
    plain = Words(*flat(pa.array([f"{a} {b}" for a, b in SAME.items()])), ALNUM).hash
    out = words.hash
    for other, usual in plain.reshape(-1, 2):
        out = np.where(out == other, usual, out)
    return out


def words_of(texts: list[str]) -> list[tuple[int, ...]]:
    words = Words(*flat(pa.array(texts)), ALNUM)
    known = hashes(words)
    return [tuple(known[a:b].tolist()) for a, b in zip(words.first[:-1], words.first[1:])]


def place_in(part: tuple, whole: tuple) -> int:
    return next(i for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part)


def together(found: list[tuple[int, int]], low: int, size: int) -> bool:
    """Whether the template words low .. low + size are matched side by side."""
    text = [p for p, r in found if low <= r < low + size]
    return len(text) == size and text[-1] - text[0] == size - 1


class Notices:
    """Names of licenses behind leads, and SPDX identifiers."""

    def __init__(self, names: dict[str, list[str]]):
        self.leads = words_of(LEADS)
        (self.under,) = words_of(["under"])[0]
        plain = [(license, name) for license, spelt in names.items() for name in spelt]
        tagged = [(license, f"{SPDX} {license}{end}") for license in names for end in ("", "-only", "-or-later")]
        self.known: dict[tuple[int, int], dict[tuple, tuple[str, bool]]] = {}
        self.single: dict[int, tuple[str, bool]] = {}
        for free, pairs in ((False, plain), (True, tagged)):
            for (license, _), phrase in zip(pairs, words_of([name for _, name in pairs])):
                if len(phrase) == 1:
                    self.single.setdefault(phrase[0], (license, free))
                else:
                    self.known.setdefault(phrase[:2], {}).setdefault(phrase, (license, free))
        self.firsts = np.unique(np.array([*(a for a, _ in self.known), *self.single], np.uint64))
        self.pairs = np.unique(np.array([self._pair(np.uint64(a), np.uint64(b)) for a, b in self.known], np.uint64))
        self.ones = np.unique(np.array(list(self.single), np.uint64))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return a * GRAM + b

    def _within(self, values: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values

    def scan(self, words: Words, hashed: np.ndarray, least: float) -> Iterator[tuple[int, str, int, list[int]]]:
        """(text, template, words of the template, places of the matched words in the text)."""
        at = np.flatnonzero(self._within(hashed, self.firsts))
        if not len(at):
            return
        after = hashed[np.minimum(at + 1, len(hashed) - 1)]
        at = at[self._within(self._pair(hashed[at], after), self.pairs) | self._within(hashed[at], self.ones)]
        docs, busy = np.searchsorted(words.first, at, "right") - 1, 0
        for p, d in zip(at.tolist(), docs.tolist()):
            low, high = int(words.first[d]), int(words.first[d + 1])
            if p < busy:
                continue
            near = tuple(hashed[p : min(high, p + 16)].tolist())
            fits = [(len(n), *what) for n, what in self.known.get(near[:2], {}).items() if near[: len(n)] == n]
            if near[0] in self.single:
                fits.append((1, *self.single[near[0]]))
            fits = [f for f in sorted(fits, reverse=True) if not self._goes_on(words, p + f[0], high)]
            if not fits:
                continue
            size, license, free = fits[0]
            places = list(range(p, p + size))
            best = (len(places), 1.0, size, places) if free else None
            before = max(low, busy)
            for lead in self.leads if not free else ():
                start = max(before, p - len(lead) - SLACK)
                found = patience(hashed[start:p].tolist(), list(lead))
                coverage = (len(found) + size) / (len(lead) + size)
                if coverage >= least and any(lead[r] == self.under for _, r in found):
                    got = (len(found) + size, coverage, len(lead) + size, [start + q for q, _ in found] + places)
                    best = got if best is None or got[:2] > best[:2] else best
            if best:
                busy = p + size
                yield d, license + "-notice", best[2], [q - low for q in best[3]]

    @staticmethod
    def _goes_on(words: Words, i: int, high: int) -> bool:
        """Whether word i is tied to the word before it: by a point and a digit, or by a hyphen."""
        if i >= high or words.start[i] != words.end[i - 1] + 1:
            return False
        mark, byte = words.data[words.end[i - 1]], words.data[words.start[i]]
        return bool(mark == 0x2D or mark == 0x2E and 0x30 <= byte <= 0x39)


class Templates:
    """Templates as word hashes, with which words of the common vocabulary each one has."""

    def __init__(self, texts: dict[str, str], names: dict[str, list[str]]):
        self.names = list(texts)
        self.words = words_of(list(texts.values()))
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], np.uint64))
        self.member = np.array([np.isin(self.vocabulary, np.array(w, np.uint64)) for w in self.words])
        self.must = [[(place_in(m, t), len(m)) for m in words_of(MUST[n])] if n in MUST else [] for n, t in zip(self.names, self.words)]
        self.notices = Notices(names)

    def _texts(self, words: Words, hashed: np.ndarray, least: float) -> Iterator[tuple[int, str, int, list[int]]]:
        """(text, template, words of the template, places of the matched words in the text) of every window that reaches ``least``."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        spot = np.flatnonzero(self.vocabulary[at] == hashed)
        doc = np.searchsorted(words.first, spot, "right") - 1
        inside, at = spot - words.first[doc], at[spot]
        held = np.bincount(doc, minlength=len(words.first) - 1)[doc]
        for name, template, member, must in zip(self.names, self.words, self.member, self.must):
            size = len(template)
            needs, full = -(-least * size // 1), Counter(template)
            mine = np.flatnonzero(held >= needs)
            mine = mine[member[at[mine]]]
            # windows k and k - 1 hold a word of block k
            block, owner = inside[mine] // size, doc[mine]
            both, count = np.unique(np.concatenate([owner << 32 | block, (owner << 32 | block - 1)[block > 0]]), return_counts=True)
            for key in both[count >= needs].tolist():
                d, start = key >> 32, (key & 0xFFFFFFFF) * size
                low, end = int(words.first[d]), int(words.first[d + 1])
                for step, length in ((0, 2 * size), *((q * size // 4, size + -(-size // 4)) for q in range(4))):
                    begin = low + start + step
                    window = hashed[begin : min(begin + length, end)].tolist()
                    if sum((Counter(window) & full).values()) < needs:
                        if not step and length == 2 * size:
                            break
                        continue
                    found = patience(window, list(template))
                    if len(found) >= needs and all(together(found, a, n) for a, n in must):
                        yield d, name, size, [start + step + p for p, _ in found]

    def scan(self, words: Words, least: float) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(text, name, coverage, first word, end, matched) of every place of each template in each text."""
        hashed = hashes(words)
        found: dict[int, list] = {}
        for part in (self._texts(words, hashed, least), self.notices.scan(words, hashed, least)):
            for d, name, size, places in part:
                foreign = places[-1] + 1 - places[0] - len(places)
                found.setdefault(d, []).append((foreign - len(places), places[0], name, size, places))
        for d, several in found.items():
            taken: set[int] = set()
            for _, _, name, size, places in sorted(several):
                if len(several) > 1:
                    if sum(p not in taken for p in places) < least * size:
                        continue
                    taken.update(places)
                yield d, name, len(places) / size, places[0], places[-1] + 1, len(places)


def _scan(templates: dict[str, str], names: dict[str, list[str]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, names)
        place = [("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32())]
        kind = pa.list_(pa.struct([("license", pa.string()), *place, ("places", pa.list_(pa.struct(place)))]))
        for batch in slices(batches):
            words = Words(*flat(text_of(batch)), ALNUM)
            rows: list[dict[str, list]] = [{} for _ in range(batch.num_rows)]
            for d, name, coverage, start, end, matched in known.scan(words, least):
                rows[d].setdefault(name, []).append({"coverage": round(coverage, 4), "start": start, "end": end, "matched": matched})
            found = []
            for row in rows:
                placed = {name: sorted(row[name], key=lambda x: x["start"]) for name in sorted(row)}
                found.append([{"license": name, **max(some, key=lambda x: x["coverage"]), "places": some} for name, some in placed.items()])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "found"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, names: dict[str, list[str]] = NAMES) -> DataFrame:
    """doc_id, n_words and ``found``: license, coverage, matched words and their range, and all places, for each template found, by name."""
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(_scan(templates, names, least), FOUND)
