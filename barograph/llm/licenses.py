"""License scan: Dice coefficient of word bigrams between normalised text and license templates.

Text is lower-cased and everything but letters and digits is white space. A candidate is any run of words, whatever lines it
stands on. A template is compared only with runs whose number of distinct bigrams lies within the bounds that the coefficient
leaves, and only in documents that hold enough of its bigrams. A best run begins and ends on a bigram of the template that it
holds once, as a shorter run were as good or better otherwise; so a begin looks no further than to its own next occurrence,
and the work for a text is at most its length times the widest template's bound, whatever it repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import common as C

DICE = 0.8
#: Well-known public licenses, full texts of the short ones and the notices of the long ones.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, library: bool = False) -> str:
    what, kind = ("library", "GNU Lesser General Public License") if library else ("program", name)
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by
    the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
    or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details."""


_GPL, _AGPL = "GNU General Public License", "GNU Affero General Public License"
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. """ + _AS_IS,
    ),
    "BSD-2-Clause": (f"{_BSD_HEAD} {_BSD_TAIL}",),
    "BSD-3-Clause": (f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    "BSL-1.0": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
        is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
        including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
        Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely
        in the form of machine-executable object code generated by a source language processor.""",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _gnu(_GPL, "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _gnu(_GPL, "3")),
    "LGPL-2.1": (_gnu(_GPL, "2.1", library=True),),
    "LGPL-3.0": (_gnu(_GPL, "3", library=True),),
    "AGPL-3.0": (_gnu(_AGPL, "3"),),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",),
    "all-rights-reserved": ("All rights reserved.",),
}

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def bigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line of the first word, line of the second word, hash) of the bigrams inside rows."""
    folded = _FOLD[buf]
    start, end, row = C.words(folded, offs)
    one = C.span_digests(C.lanes(folded), folded, start, end)
    lines = np.cumsum(buf == 10)
    line = lines[start] if len(start) else start
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    return row[pair], line[pair - 1], line[pair], C.mix(one[pair - 1] * np.uint64(0xA24BAED4963EE407) + one[pair])


def distinct_bigrams(text: str) -> frozenset[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return frozenset(bigrams(raw, np.array([0, len(raw)]))[3].tolist())


def bounds(size: int, dice: float) -> tuple[float, float]:
    """Sizes of the sets whose coefficient with a set of `size` can reach `dice`."""
    return size * dice / (2 - dice) - 1e-9, size * (2 - dice) / dice + 1e-9


def best_run(hashes: np.ndarray, following: np.ndarray, before: np.ndarray, hit: np.ndarray, size: int, dice: float) -> tuple[float, int, int] | None:
    """(coefficient, first bigram, one behind the last) of a template's best run in one document, the first among equals.

    `following` and `before` are the next and the last place of each bigram, `hit` marks those of the template, which has `size`.
    """
    low, high = bounds(size, dice)
    least = int(np.ceil(dice * size / (2 - dice) - 1e-9))  # hits that a run needs
    begins = np.flatnonzero(hit)
    best: tuple[float, int, int] | None = None
    seen: set[bytes] = set()
    for n, begin in enumerate(begins.tolist()):
        if len(begins) - n < least or (best and best[0] >= 1.0):
            break
        stop, step = int(following[begin]), int(2 * high) + 8
        while True:  # up to the next occurrence, or until there are too many distinct bigrams
            to = min(stop, begin + step)
            fresh = before[begin:to] < begin
            if to == stop or int(fresh.sum()) > high:
                break
            step *= 4
        at = np.flatnonzero(fresh)[: int(high) + 1]  # where a bigram is new to the run
        good = hit[begin + at]
        if int(good.sum()) < least:
            continue
        if len(begins) > 1000:  # a text that repeats itself: the same run is looked at once
            key = hashlib.blake2b(hashes[begin + at].tobytes(), digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
        distinct = np.arange(1, len(at) + 1)
        value = np.where(good & (distinct >= low) & (distinct <= high), 2 * np.cumsum(good) / (distinct + size), 0.0)
        top = int(value.argmax())
        if value[top] >= dice and (best is None or value[top] > best[0] + 1e-12):
            best = (float(value[top]), begin, begin + int(at[top]) + 1)
    return best


def neighbours(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next place, last place) of each value; the length and -1 where there is none."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    following, before = np.full(len(hashes), len(hashes)), np.full(len(hashes), -1)
    following[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    return following, before


class Templates:
    """Bigram sets of license texts, with a table from bigram to the templates that hold it."""

    def __init__(self, templates: dict[str, tuple[str, ...]], dice: float):
        self.dice = dice
        sets = [(name, distinct_bigrams(text)) for name, texts in templates.items() for text in texts]
        self.names = [name for name, grams in sets if grams]
        self.sets = [grams for _, grams in sets if grams]
        self.known = np.array(sorted(set().union(*self.sets)), np.uint64)
        self.sizes = np.array([len(g) for g in self.sets], np.int64)
        self.member = np.zeros((len(self.known), len(self.sets)), bool)
        for t, grams in enumerate(self.sets):
            self.member[np.searchsorted(self.known, np.array(sorted(grams), np.uint64)), t] = True
        self.least = np.ceil(dice * self.sizes / (2 - dice) - 1e-9).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each known bigram, -1 for others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def best_runs(self, hashes: np.ndarray, place: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, coefficient, first bigram, last bigram) of each license's best run in one document."""
        held = np.unique(place[place >= 0])
        wanted = np.flatnonzero(self.member[held].sum(axis=0) >= self.least)
        best: dict[str, tuple[float, int, int]] = {}
        if len(wanted):
            following, before = neighbours(hashes)
        for t in wanted.tolist():
            hit = np.zeros(len(place), bool)
            hit[place >= 0] = self.member[place[place >= 0], t]
            run = best_run(hashes, following, before, hit, int(self.sizes[t]), self.dice)
            if run and run[0] > best.get(self.names[t], (0.0,))[0] + 1e-12:
                best[self.names[t]] = run
        return sorted(((n, v, a, b - 1) for n, (v, a, b) in best.items()), key=lambda x: (-x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """(doc_id, license, dice, licenses) for every row: the best license (null if none), its coefficient (0 if none), and all
    found, as (license, dice, first_line, last_line), lines counted from 0.

    Null and empty texts have none. Ties go to the smaller name. Repeated rows and null ids are kept; other columns are not
    used; an empty input gives an empty result. Templates of fewer than two words are never found.
    """
    known = Templates(templates, dice)
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in C.text_chunks(batch):
                row, line1, line2, hashes = bigrams(buf, offs)
                place = known.places(hashes)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                found: list[list] = [[] for _ in range(part.num_rows)]
                breaks = np.flatnonzero(buf == 10)
                for i in np.unique(row[place >= 0]).tolist():
                    s = slice(cut[i], cut[i + 1])
                    base = int(np.searchsorted(breaks, offs[i]))
                    found[i] = [(n, v, int(line1[s][a]) - base, int(line2[s][b]) - base) for n, v, a, b in known.best_runs(hashes[s], place[s])]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([f[0][0] if f else None for f in found], pa.string()), pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()), pa.array(found, kind),
                ], ["doc_id", "license", "dice", "licenses"])

    schema = "doc_id long, license string, dice double, licenses array<struct<license:string,dice:double,first_line:int,last_line:int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(C.tidy(run), schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(C.table(spark, sf_dir, "documents")).select("doc_id", "license", F.round("dice", 9).alias("dice"))
