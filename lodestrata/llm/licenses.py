"""Licence scans: parts of a text against licence templates, by Dice coefficient over word bigrams.

The parts of a text are its lines with words, its paragraphs (lines between blank ones) and the whole. A
part of a bigrams can only reach a coefficient t with a template of b bigrams if a lies between
b * t / (2 - t) and b * (2 - t) / t, so sorted sizes leave few templates to compare.

Licences inside longer texts are found by windows: runs of words anywhere in the text, of any size within
these bounds. The best ones begin and end with a bigram of the template, and hold at least b * t / (2 - t)
of them, so only places where these stand that close together are looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import pick, table

#: Public licence texts, notices and one-line statements.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-statement": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
}
THRESHOLD = 0.8
#: Templates are sent to every executor; more text than this is refused.
MAX_TEMPLATE_BYTES = 64 << 20
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters and digits."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams over all of both, repeats counted."""
    both = sum(a.values()) + sum(b.values())
    if len(a) > len(b):
        a, b = b, a
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / both if both else 0.0


def parts(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """First and last line (from 0) and words of each line, paragraph of several lines, and text of several paragraphs."""
    lines = [normalised(x) for x in text.split("\n")]
    spans, begin = [], None
    for i, words in enumerate([*lines, []]):
        if words:
            yield i, i, words
            begin = i if begin is None else begin
        elif begin is not None:
            spans.append((begin, i - 1))
            begin = None
    for a, b in spans:
        if b > a:
            yield a, b, [w for x in lines[a : b + 1] for w in x]
    if len(spans) > 1:
        a, b = spans[0][0], spans[-1][1]
        yield a, b, [w for x in lines[a : b + 1] for w in x]


class Templates:
    """Templates by size, to be asked for those that a number of bigrams can match."""

    def __init__(self, texts: dict[str, str], threshold: float) -> None:
        grams = sorted(((name, bigrams(normalised(t))) for name, t in texts.items()), key=lambda x: (sum(x[1].values()), x[0]))
        self.all = [(n, g) for n, g in grams if g]
        self.sizes = [sum(g.values()) for _, g in self.all]
        self.threshold, self.known = threshold, {g for _, c in self.all for g in c}
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, grams) in enumerate(self.all):
            for g in grams:
                self.holders.setdefault(g, []).append(k)

    def windows(self, text: str) -> list[tuple[str, float, int, int]]:
        """License, coefficient, first and last line of the best windows that reach the threshold; those of a template don't overlap."""
        lines = [normalised(x) for x in text.split("\n")]
        words = [w for x in lines for w in x]
        hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for i, g in enumerate(zip(words, words[1:], strict=False)):
            for k in self.holders.get(g, ()):
                hits.setdefault(k, []).append((i, g))
        out, line = [], None
        for k, own in hits.items():
            name, grams = self.all[k]
            b, found = self.sizes[k], []
            least, most = max(1, ceil(b * self.low - 1e-9)), int(b * self.high + 1e-9)
            for x in range(len(own) - least + 1):
                begin = own[x][0]
                if own[x + least - 1][0] - begin >= most:
                    continue
                left, common, best = dict(grams), 0, (0.0, 0)
                for y in range(x, len(own)):
                    i, g = own[y]
                    if i - begin >= most:
                        break
                    if left[g]:
                        left[g] -= 1
                        common += 1
                        best = max(best, (2 * common / (i - begin + 1 + b), i))
                if best[0] >= self.threshold:
                    found.append((-best[0], begin, best[1]))
            # Taken windows don't overlap, so their ends are in the order of their beginnings.
            taken: list[tuple[int, int]] = []
            for score, begin, end in sorted(found):
                at = bisect_left(taken, (begin, end))
                if (at == 0 or taken[at - 1][1] < begin) and (at == len(taken) or end < taken[at][0]):
                    taken.insert(at, (begin, end))
                    line = line or [no for no, x in enumerate(lines) for _ in x]
                    out.append((name, -score, line[begin], line[end + 1]))
        return out

    def find_all(self, text: str) -> list[tuple[str, float, int, int]]:
        """find(), and the windows that are better than all of these that share a line with them."""
        out = self.find(text)
        return out + [(n, d, a, b) for n, d, a, b in self.windows(text) if not any(n == m and d <= e + 1e-12 and a <= z and y <= b for m, e, y, z in out)]

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """License, coefficient, first and last line of all parts that reach the threshold."""
        out = []
        for first, last, words in parts(text):
            n = len(words) - 1
            # Rounding must not leave a template out that lies on the bound.
            lo, hi = bisect_left(self.sizes, n * self.low - 1e-9), bisect_right(self.sizes, n * self.high + 1e-9)
            if n < 1 or lo == hi or self.known.isdisjoint(zip(words, words[1:], strict=False)):
                continue
            own = bigrams(words)
            for name, grams in self.all[lo:hi]:
                if (score := dice(own, grams)) >= self.threshold:
                    out.append((name, score, first, last))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", embedded: bool = False) -> DataFrame:
    """One row per row of docs: id and matches (license, dice, first_line, last_line), the best first.

    embedded: windows of words are compared as well as the parts of a text.
    Equal coefficients are in the order of names and lines. Null, empty and blank texts have no match, nor
    has anything without templates. Ids may repeat or be null. Each text is scanned as a whole, by itself.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_BYTES} bytes")
    own = pick(docs, id=id_col, text=text_col)
    fields = [pa.field("license", pa.string()), pa.field("dice", pa.float64()), pa.field("first_line", pa.int64()), pa.field("last_line", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        find = known.find_all if embedded else known.find
        for batch in batches:
            found = [sorted(find(t.as_py() or ""), key=lambda m: (-m[1], m[0], m[2], m[3])) for t in batch.column(1)]
            rows = [[dict(zip(("license", "dice", "first_line", "last_line"), m, strict=True)) for m in each] for each in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct(fields)))], ["id", "matches"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, matches array<struct<license:string,dice:double,first_line:bigint,last_line:bigint>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_matches, licenses (names in order, comma-joined), best_license, best_dice."""
    out = scan(table(spark, sf_dir, "documents"), embedded=True)
    best = F.get("matches", F.lit(0))
    return out.select(
        F.col("id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), best["license"].alias("best_license"), best["dice"].alias("best_dice")
    )
