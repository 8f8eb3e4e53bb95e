"""Licence scan: passages compared to licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised (A-Z lower-cased, words of ASCII letters, digits and other characters beyond ASCII). A passage
with t template bigrams can reach the threshold d only if it has between t*d/(2-d) and t*(2-d)/d bigrams, and shares at
least t*d/(2-d) with the template; these bounds drop templates for a text, and passages of a template, before any coefficient
is computed. Passages start and end on bigrams of the template, so licences inside longer texts are found where they stand.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import texts
from tidelog.llm.decontamination import fold_words

DICE = 0.8

# Public licence texts (their operative passages) and the usual short notices.
_NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}


def templates() -> list[tuple[str, str]]:
    """(licence, template text); those of one family that differ by version or clause are made by rule."""
    out = [(name, text) for name, all_ in _NOTICES.items() for text in all_]
    for short, family in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")):
        for version in ("2", "2.1", "3"):
            name = f"{short}-{version if '.' in version else version + '.0'}"
            out.append((name, f"This work is licensed under the {family}, version {version}."))
            out.append((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the {family} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."))
    words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for clauses in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spelled = "-".join(words[c] for c in clauses.split("-"))
            kind = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            out.append((f"CC-{clauses}-{version}", f"This work is licensed under a Creative Commons {spelled} {version} {kind} License."))
            out.append((f"CC-{clauses}-{version}", f"This work is licensed under the Creative Commons {spelled} {version} {kind} License. To view a copy of this license, visit http://creativecommons.org/licenses/{clauses.lower()}/{version}/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."))
            out.append((f"CC-{clauses}-{version}", f"Licensed under CC {clauses} {version}."))
    return out


class DiceScanner:
    def __init__(self, known: list[tuple[str, str]], dice: float = DICE):
        if not 0 < dice <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.dice = dice
        self.names: list[str] = []
        self.sets: list[frozenset[tuple[bytes, bytes]]] = []
        for name, text in known:
            words = fold_words(text.encode())
            if len(words) > 1:
                self.names.append(name)
                self.sets.append(frozenset(zip(words, words[1:])))
        self.of: dict[tuple[bytes, bytes], list[int]] = {}
        for k, s in enumerate(self.sets):
            for b in s:
                self.of.setdefault(b, []).append(k)
        low, high = dice / (2 - dice), (2 - dice) / dice
        self.least = [math.ceil(len(s) * low - 1e-9) for s in self.sets]
        self.most = [int(len(s) * high + 1e-9) for s in self.sets]

    def passages(self, body: bytes | None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first word, end word) of the best passages, none overlapping, in text order."""
        words = fold_words(body)
        hits: dict[int, list[int]] = {}
        of = self.of.get
        for i, b in enumerate(zip(words, words[1:])):
            if found := of(b):
                for k in found:
                    hits.setdefault(k, []).append(i)
        scored = []
        for k, at in hits.items():
            if len(at) >= self.least[k]:
                scored += self._best(words, k, at)
        starts: list[int] = []  # of the passages chosen so far, sorted
        chosen: dict[int, tuple[str, float, int, int]] = {}
        for score, start, end, name in sorted(scored, key=lambda s: (-s[0], s[1], -s[2], s[3])):
            i = bisect_left(starts, start)
            if (i == 0 or chosen[starts[i - 1]][3] <= start) and (i == len(starts) or end <= starts[i]):
                starts.insert(i, start)
                chosen[start] = (name, score, start, end)
        return [chosen[s] for s in starts]

    def _best(self, words: list[bytes], k: int, at: list[int]) -> list[tuple[float, int, int, str]]:
        """The best passage from each start that reaches the threshold; of overlapping ones the best stays.

        A passage has at most ``most`` distinct bigrams, however often they repeat. One that holds its first bigram again is no better than the one that begins
        at the next hit (which lacks, at most, bigrams that aren't the template's), so a start is followed up to the next place of its bigram only; this
        keeps the steps in proportion to the text. In the end a passage takes in what stands right before it and is repeated in it.
        """
        target, least, most = self.sets[k], self.least[k], self.most[k]
        n = len(words) - 1
        again: dict[int, int] = {}  # the next place of the bigram that begins at a hit
        last: dict[tuple[bytes, bytes], int] = {}
        for start in reversed(at):
            b = (words[start], words[start + 1])
            again[start] = last.get(b, n)
            last[b] = start
        out: list[tuple[float, int, int, str]] = []
        inside: dict[tuple[bytes, bytes], int] = {}  # bigrams from the present start up to ``far``, the first place with too many distinct ones
        far = low = 0
        for first, start in enumerate(at):
            while low < start:
                if low < far:
                    b = (words[low], words[low + 1])
                    inside[b] -= 1
                    if not inside[b]:
                        del inside[b]
                low += 1
            far = max(far, start)
            while far < n and (len(inside) < most or (words[far], words[far + 1]) in inside):
                b = (words[far], words[far + 1])
                inside[b] = inside.get(b, 0) + 1
                far += 1
            stop = bisect_left(at, min(far, again[start]))
            if stop - first < least:
                continue
            seen: set[tuple[bytes, bytes]] = set()
            shared, best, upto = 0, (0.0, 0), start
            for j in range(first, stop):
                while upto <= at[j]:
                    b = (words[upto], words[upto + 1])
                    if b not in seen:
                        seen.add(b)
                        shared += b in target
                    upto += 1
                score = 2 * shared / (len(seen) + len(target))
                if score > best[0]:
                    best = score, upto
            if best[0] >= self.dice - 1e-12:
                if start and (words[start - 1], words[start]) in target:
                    own = target.intersection(zip(words[start : best[1]], words[start + 1 : best[1] + 1]))
                    while start and (words[start - 1], words[start]) in own:
                        start -= 1
                one = (best[0], start, best[1] + 1, self.names[k])
                if out and out[-1][2] > start:
                    if one[0] > out[-1][0]:
                        out[-1] = one
                else:
                    out.append(one)
        return out


def license_matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """Per row: id, ``license`` (of the best passage, the first on ties; else null), ``dice`` (its coefficient, else 0), ``n_passages``, and
    ``passages`` (licence, coefficient, first and end word of each, in text order).

    Null and empty texts match nothing; whole texts are read. Repeated rows are scanned each; extra columns are left out. A narrow map; the templates
    are parameters and travel with the function.
    """
    known = templates() if known is None else known
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = DiceScanner(known, dice)
        for b in batches:
            found = [scan.passages(body) for body in b.column(1).to_pylist()]
            best = [max(f, key=lambda x: x[1]) if f else (None, 0.0) for f in found]
            listed = [[{"license": n, "dice": d, "start": s, "end": e} for n, d, s, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array(listed, kind)], ["id", "license", "dice", "n_passages", "passages"])

    schema = "id bigint, license string, dice double, n_passages bigint, passages array<struct<license:string,dice:double,start:int,end:int>>"
    return texts(df, id_col, text_col)[0].mapInArrow(run, schema).withColumnRenamed("id", id_col)
