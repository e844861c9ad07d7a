"""License scan: normalised text compared to licence templates by Dice coefficient over word bigrams.

A notice may be a sentence, stand in a line, run over a paragraph, or be the whole text; each of these is
compared. Texts are lower-cased in A-Z and cut into words of ASCII letters and digits. For bigram counts a and b
the Dice coefficient is at most 2 min(a, b) / (a + b), so a threshold t leaves a template of b
bigrams only to segments of t / (2 - t) to (2 - t) / t times b: the size bounds that prune templates before
any bigram is compared, and segments before their bigrams are made. A text without a single bigram of any
template is done after one pass over its words.

Licences of one family differ in few words, so some decide: the numbers of a template must all stand in the
segment, the versions that the template names must be those that the segment names, and it must have just
those of the family words that the template has.

Defined results: a licence counts once for a text, as the segment and template with the most common bigrams
show it, however many others do; a text is named by the licence with the most common bigrams, then the
higher score, then the identifier that sorts first; null and empty texts have no licence; repeated rows are scanned alike; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import map_arrow

THRESHOLD = 0.8
#: Words that tell licences of one family apart.
FAMILY = ("affero", "appear", "lesser", "library", "nc", "nd", "neither", "noncommercial", "noderivatives", "sa", "sharealike")
#: Bytes whose words are looked at together when a text is searched for any bigram of a template.
BLOCK = 1 << 16

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str, program: str) -> str:
    """The notice that files under a licence of the GNU family begin with."""
    return f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Texts of public licences by SPDX identifier. Short licences are whole; of long ones, the title
#: that the text begins with, the notice that files carry, and one-line references.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (f"{_ISC}. {_ISC_WARRANTY}", f"{_ISC}."),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _gnu("Affero General Public License", "3", "This program")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_WARRANTY}", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_WARRANTY}"),
    "BSD-3-Clause": (f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_WARRANTY}", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_WARRANTY}", _BSD_3),
    "BSD-style": (_BSD,),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal"),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("General Public License", "2", "This program")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("General Public License", "3", "This program")),
    "ISC": (f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.0": ("This work is licensed under the GNU Library General Public License, version 2.", "GNU Lesser General Public License, version 2.", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("Library General Public License", "2", "This library")),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _gnu("Lesser General Public License", "2.1", "This library")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("Lesser General Public License", "3", "This library")),
    "MIT": ("Released under the MIT License.", f"{_MIT} {_WARRANTY}", _MIT, _MIT[: _MIT.index(": The above")]),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}

_WORD = re.compile(rb"[a-z0-9]+")
#: A version in words that are joined by spaces.
VERSION = " (?:version|v) ([0-9]{1,3}(?: [0-9]{1,3})?) "
_VERSION = re.compile(VERSION.encode())
#: What separates lines, paragraphs, and sentences within either.
LINE, PARAGRAPH, SENTENCE = "\n", r"\n[ \t\r]*\n", r"[.!?;][ \t\r\n]+"


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def decisive(words: list[bytes]) -> tuple[frozenset[bytes], frozenset[bytes], frozenset[bytes]]:
    """The numbers but 0 among the words, the versions, and the family words."""
    numbers = frozenset(w for w in words if w.isdigit() and w != b"0")
    versions = frozenset(v.removesuffix(b" 0") for v in _VERSION.findall(b" " + b" ".join(words) + b" "))
    return numbers, versions, frozenset(w for w in words if w.decode() in FAMILY)


class Scanner:
    """Templates by bigram count, so that a segment meets only those within its size bounds."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float) -> None:
        self.t = threshold
        all_ = [(w := words_of(text), name) for name, texts in templates.items() for text in texts]
        self.templates = [(len(w) - 1, name, Counter(zip(w, w[1:], strict=False)), *decisive(w)) for w, name in all_]
        self.known = {g for x in self.templates for g in x[2]}
        self.vocabulary = {w for g in self.known for w in g}
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        most = int(max((x[0] for x in self.templates), default=0) * high) + 1
        self.by_size = [[x for x in self.templates if x[0] and low * x[0] <= n + 1e-9 and n <= high * x[0] + 1e-9] for n in range(most + 1)]
        #: A segment of fewer characters than this has too few words for any template.
        self.least = 2 * next((n for n, x in enumerate(self.by_size) if x), 0) + 1

    def may_match(self, text: str) -> bool:
        """Whether any bigram of any template stands in the text. Its words are made a block at a time."""
        data, at, last = text.encode("utf-8", "surrogatepass").lower(), 0, None
        while at < len(data):
            # A block ends at a space, if there is one.
            end = len(data) if at + BLOCK >= len(data) else max(data.rfind(b" ", at, at + BLOCK), data.rfind(b"\n", at, at + BLOCK)) + 1 or at + BLOCK
            words = _WORD.findall(data, at, end)
            if last is not None:
                words.insert(0, last)
            own = self.vocabulary.intersection(words)
            if len(own) > 1 and not self.known.isdisjoint(zip(words, words[1:], strict=False)):
                return True
            last, at = (words[-1] if words else last), max(end, at + 1)
        return False

    def best(self, segment: str) -> Iterator[tuple[str, int, float]]:
        """(name, common bigrams, score) of the templates at or over the threshold. Words are counted up to the largest bound, before any bigram is made."""
        if len(segment) < self.least:
            return
        most = len(self.by_size)
        words = [m[0] for m in islice(_WORD.finditer(segment.encode("utf-8", "surrogatepass").lower()), most + 2)]
        n = len(words) - 1
        if n < 1 or n >= most or not self.by_size[n]:
            return
        own = Counter(g for g in zip(words, words[1:], strict=False) if g in self.known)
        if not own:
            return
        seen, held = None, set(words)
        for b, name, template, numbers, versions, family in self.by_size[n]:
            common = sum(min(k, own[g]) for g, k in template.items() if g in own)
            if 2 * common / (n + b) < self.t:
                continue
            seen = decisive(words) if seen is None else seen
            if numbers <= held and versions in (frozenset(), seen[1]) and family == seen[2]:
                yield name, common, 2 * common / (n + b)

    def scan(self, text: str | None) -> dict[str, tuple[int, float]]:
        """The most common bigrams of each licence in the text, with the score."""
        out: dict[str, tuple[int, float]] = {}
        if not text or not self.may_match(text):
            return out
        larger = [*re.split(PARAGRAPH, text), *text.split(LINE)]
        for s in {text, *larger, *(x for s in larger for x in re.split(SENTENCE, s))}:
            for name, common, score in self.best(s):
                out[name] = max((common, score), out.get(name, (0, 0.0)))
        return out


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, score, n_licenses, licenses: the best licence, its score rounded to 9 places, and all in order of their names, comma-joined."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column(1)]
            best = [min(((-c, -v, k) for k, (c, v) in f.items()), default=None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x and x[2] for x in best], pa.string()), pa.array([x and round(-x[1], 9) for x in best], pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted(f)) for f in found], pa.string())],
                names=["doc_id", "license_id", "score", "n_licenses", "licenses"],
            )

    return map_arrow(slim, run, f"doc_id {kind}, license_id string, score double, n_licenses bigint, licenses string")
