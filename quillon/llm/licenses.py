"""License scans by conditional compression.

A block is the run of text around a cue word (license, copyright, ...): the line it stands in, cut at
sentence ends when the line is long; blocks that meet are one, and a block grows to a notice that
runs over its edges. Each license has several wordings. Windows of the words around a block are compressed with zstandard
once alone and once with each wording as raw dictionary; a wording that the text quotes makes them
shrink. Wordings are ranked by the bytes that they save, and confirmed from the top: the wording's words are
aligned with the text's, and the words that differ are counted. None of them may be a distinctive
word, such as Affero or a version. The first wording of a license that is confirmed names it, and the license's others are not looked at.

Windows hold a wording's rarest word of the block (each place of it) and as many words on both sides as the wording
has, so that a short name is as large a part of its window as a full text is.

Defined results: null and empty texts have no blocks; a block has one row for each license confirmed
in it, by its wording that saves the most bytes; a block that no wording explains is counted and left unnamed;
Proprietary is the notice that all rights are reserved, wherever it stands; repeated rows repeat; long
texts are scanned whole; an input column with the result's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import table

#: Names and notices to look for: fixed wordings in common use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "Copyright. All rights reserved.",
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""


def _gnu(kind: str, short: str, version: int) -> tuple[str, ...]:
    return (
        f"GNU {kind}, version {version}",
        f"GNU {kind} v{version}",
        f"version {version} of the GNU {kind}",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"{short} v{version}",
        f"{short}v{version}",
        f"{short} {version}",
        f"{short} version {version}",
    )


def _cc(names: tuple[str, ...], short: str) -> tuple[str, ...]:
    return (*(f"Creative Commons {n} 4.0" for n in names), f"CC {short} 4.0", f"creativecommons.org/licenses/{short.lower()}/4.0")


#: Further wordings of each: full texts of short licenses, and how notices and the titles of the full texts of long ones name them.
WORDINGS = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2 license", "Apache License v2", "Apache License v2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "MIT": ("MIT License", "MIT licensed", "licensed under MIT", "SPDX-License-Identifier: MIT", "MIT OR Apache", "Apache-2.0 OR MIT", "opensource.org/licenses/MIT", _MIT),
    "GPL-3.0": _gnu("General Public License", "GPL", 3),
    "GPL-2.0": _gnu("General Public License", "GPL", 2),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", 3),
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", 3),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL v2.0"),
    "BSD": ("BSD License", "BSD-style license", "2-Clause BSD", "3-Clause BSD", "BSD 2-Clause", "BSD 3-Clause", "Redistribution and use in source and binary forms, with or without modification", f"{_BSD_START} {_BSD_END}", f"{_BSD_START} {_BSD_NAMES} {_BSD_END}"),
    "CC-BY-4.0": _cc(("Attribution",), "BY"),
    "CC-BY-SA-4.0": _cc(("Attribution-ShareAlike", "Attribution Share Alike"), "BY-SA"),
    "CC-BY-NC-4.0": _cc(("Attribution-NonCommercial", "Attribution Non-Commercial"), "BY-NC"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "creativecommons.org/publicdomain/zero/1.0"),
    "Unlicense": ("The Unlicense", "SPDX-License-Identifier: Unlicense", "unlicense.org", _UNLICENSE),
    "Proprietary": ("All rights reserved.",),
}
CUES = re.compile(rb"licen[sc]e|copyright|all\s+rights\s+reserved|public\s+domain|redistribut|\(c\)|\xc2\xa9|creative\s*commons|\bcc[ -]?(?:by|0)|permission\s+is\s+hereby|provided\s+(?:by[^.]{1,80}\s+)?\W?as\s+is\b|\b[al]?gpl|\bmpl\b", re.I)
SENTENCE = re.compile(rb"[.!?:;]\s")
#: Bytes on each side of a cue within which a block ends.
REACH = 400
#: Bytes on each side of a block that are looked at for notices that run over its edges; more than the longest wording.
AROUND = 3000
#: A wording must save at least this share of what it saves of itself, less the bytes that one match may cost. Names that
#: save no more of themselves than that are ranked last rather than left out, as zstandard cannot tell.
LEAST_SAVED = 0.2
MATCH_COST = 4
#: Raw dictionaries are as long as this at least: a wording is repeated until it is.
DICTIONARY = 64
#: Share of a wording's words that may differ, one at least; those below SHORT words must be there in full.
MOST_DIFFERENT = 0.1
SHORT = 5
#: Words that tell licenses apart, as do numbers: in wordings of up to NOTICE words they never differ.
DISTINCTIVE = frozenset("mit apache gnu gpl lgpl agpl affero lesser library mozilla mpl bsd cc cc0 attribution sharealike share alike noncommercial non commercial noderivatives noderivs nc nd sa not no public domain reserved unencumbered".split())
NOTICE = 80
_WORD = re.compile(r"[^\W_]+")


def blocks(raw: bytes) -> Iterator[tuple[int, int]]:
    """(first byte, end) of each block; blocks that meet are one."""
    last = None
    for cue in CUES.finditer(raw):
        a = max(raw.rfind(b"\n", 0, cue.start()) + 1, 0)
        b = raw.find(b"\n", cue.end())
        b = len(raw) if b < 0 else b
        if cue.start() - a > REACH:
            ends = [m.end() for m in SENTENCE.finditer(raw, cue.start() - REACH, cue.start())]
            a = ends[-1] if ends else cue.start() - REACH
        if b - cue.end() > REACH:
            end = SENTENCE.search(raw, cue.end() + REACH // 2, cue.end() + REACH)
            b = end.start() + 1 if end else cue.end() + REACH
        if last and a < last[1]:
            a, b = last[0], max(b, last[1])
        elif last:
            yield last
        last = (a, b)
    if last:
        yield last


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def differences(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(words of the template that are changed, missing or added in the block's best matching stretch, its first word, its end)."""
    # edit distance of the template to any stretch of the block: a start is free, so is an end
    row = [(0, j) for j in range(len(block) + 1)]
    for i, w in enumerate(template, 1):
        new = [(i, 0)]
        for j, v in enumerate(block, 1):
            new.append(min((row[j - 1][0] + (w != v), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    cost, end = min((c[0], j) for j, c in enumerate(row))
    return cost, row[end][1], end


def stretches(template: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As differences, for each end in the block: (words that differ, first word) of the best stretch that ends there."""
    n = len(block) + 1
    row, steps = np.arange(n), np.arange(n) * n
    for i, w in enumerate(template.tolist(), 1):
        new = row + n
        new[1:] = np.minimum(new[1:], row[:-1] + (block != w) * n)
        new[0] = i * n
        row = np.minimum.accumulate(new - steps) + steps
    return row // n, row % n


def _distinctive(words: list[str]) -> list[str]:
    return [w for w in words if w in DISTINCTIVE or any(c.isdigit() for c in w)]


def _compressor(dictionary: zstandard.ZstdCompressionDict | None = None) -> zstandard.ZstdCompressor:
    """Short matches count, and equal texts have equal sizes whatever the machine."""
    how = zstandard.ZstdCompressionParameters(window_log=15, chain_log=13, hash_log=12, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=dictionary)


def _padded(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


class _Wording:
    def __init__(self, license: str, text: str, plain: zstandard.ZstdCompressor):
        self.license, self.words = license, words_of(text)
        self.distinct, self.keys = frozenset(self.words), _distinctive(self.words)
        self.most = 0 if len(self.words) < SHORT else max(1, int(MOST_DIFFERENT * len(self.words)))
        own = _padded(self.words)
        self.given = _compressor(zstandard.ZstdCompressionDict(own * -(-DICTIONARY // len(own)), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.size = max(len(plain.compress(own)) - len(self.given.compress(own)), 1)
        self.least = LEAST_SAVED * self.size - MATCH_COST

    def saved(self, words: list[str], places: dict[str, list[int]], first: int, end: int, plain: zstandard.ZstdCompressor) -> int:
        """Most bytes that the wording saves in a window that it may share with the words from first to end; places: where each word stands."""
        # a window that quotes the wording has all but `most` of its words, so one of any `most` + 1
        rare = sorted(self.distinct, key=lambda w: (len(places.get(w, ())), w))[: self.most + 1]
        reach, best, last = len(self.words) + self.most, 0, -1
        for k in sorted({k for w in rare for k in places.get(w, ())}):
            if not first - reach <= k < end + reach or (last >= 0 and k - last < reach // 2):
                continue
            last = k
            window = _padded(words[max(k - reach, 0) : k + reach + 1])
            best = max(best, len(plain.compress(window)) - len(self.given.compress(window)))
        return best


class Scanner:
    def __init__(self, templates: dict[str, str | Iterable[str]]):
        self.plain = _compressor()
        self.wordings = [_Wording(name, text, self.plain) for name, texts in sorted(templates.items()) for text in ((texts,) if isinstance(texts, str) else texts)]
        self.wordings = [w for w in self.wordings if w.words]

    def _confirmed(self, wording: _Wording, words: list[str], ids: np.ndarray, number: dict[str, int], first: int, end: int) -> tuple[int, int, int] | None:
        """(words that differ, first word, end) of the wording's best stretch that has a word of those from first to end."""
        margin = len(wording.words) + wording.most
        low, high = max(first - margin, 0), min(end + margin, len(words))
        differ, starts = stretches(np.array([number.get(w, -1) for w in wording.words]), ids[low:high])
        ends = np.flatnonzero(differ <= wording.most)
        for e in ends[np.argsort(differ[ends], kind="stable")].tolist():
            a, b = low + int(starts[e]), low + e
            if a < end and b > first and (len(wording.words) > NOTICE or _distinctive(words[a:b]) == wording.keys):
                return int(differ[e]), a, b
        return None

    def scan(self, raw: bytes) -> list[dict]:
        """One row for each license of a block, or one without license, in order of blocks and licenses."""
        found: list[tuple[int, int, dict, float]] = []
        for a, b in blocks(raw):
            low, high = max(a - AROUND, 0), min(b + AROUND, len(raw))
            while low < a and raw[low] & 0xC0 == 0x80:
                low += 1
            while high < len(raw) and raw[high] & 0xC0 == 0x80:
                high += 1
            around = raw[low:high].decode("utf-8", "replace")
            spans = [m.span() for m in _WORD.finditer(around)]
            words = [around[i:j].lower() for i, j in spans]
            # places in bytes of the words' ends
            at = np.arange(len(around) + 1)
            if not around.isascii():
                c = np.frombuffer(around.encode("utf-32-le", "surrogatepass"), "<u4")
                at = np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])
            firsts, ends = (low + at[[x[k] for x in spans]] if spans else np.zeros(0, np.int64) for k in (0, 1))
            first, end = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(firsts, b, "left"))
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids = np.array([number[w] for w in words], np.int64)
            places: dict[str, list[int]] = {}
            for k, x in enumerate(words):
                places.setdefault(x, []).append(k)
            named: dict[str, tuple[int, int, float]] = {}
            ranked = sorted(((-w.saved(words, places, first, end, self.plain), -len(w.words), n) for n, w in enumerate(self.wordings) if sum(x not in number for x in w.distinct) <= w.most))
            for saved, _, n in ranked:
                w = self.wordings[n]
                if -saved < w.least or w.license in named:
                    continue
                hit = self._confirmed(w, words, ids, number, first, end)
                if hit:
                    d, i, j = hit
                    a, b = min(a, int(firsts[i])), max(b, int(ends[j - 1]))
                    named[w.license] = (saved, d, -saved / w.size)
            best = 0.0 if named else max((-s / self.wordings[n].size for s, _, n in ranked), default=0.0)
            while found and a < found[-1][1]:
                a0, b0, more, s = found.pop()
                a, b, best = min(a, a0), max(b, b0), max(best, s)
                for name, x in more.items():
                    named[name] = min(named.get(name, x), x)
            found.append((a, b, named, best))
        rows = []
        for a, b, named, best in found:
            for name, (_, d, s) in sorted(named.items()) or ((None, (0, None, best)),):
                rows.append({"first": a, "last": b, "license": name, "saved": s, "differences": d})
        return rows


FOUND = "array<struct<first:bigint,last:bigint,license:string,saved:double,differences:bigint>>"
_FOUND = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("differences", pa.int64())]))


def scan(docs: DataFrame, *, text: str = "text", templates: dict[str, str | Iterable[str]] | None = None, out: str = "licenses") -> DataFrame:
    """docs with an array of their blocks' licenses: the block's byte span, license or null, bytes saved as a share of what the wording saves of itself, words that differ."""
    known = {name: (text, *WORDINGS[name]) for name, text in TEMPLATES.items()} if templates is None else dict(templates)
    at = docs.columns.index(text)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known) if known else None
        for batch in batches:
            found = []
            for value in batch.column(0).field(at):
                raw = value.as_buffer() if value.is_valid else None
                rows = []
                if raw is not None and scanner:
                    rows = scanner.scan(raw.to_pybytes())
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], ["row", "found"])

    found = whole.mapInArrow(tc.tidied_batches(run), "row " + docs.schema.simpleString() + f", found {FOUND}")
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != out], F.col("found").alias(out))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    named = F.filter("licenses", lambda x: x["license"].isNotNull())
    n_of = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["first"]))).cast("long")
    names = F.array_sort(F.array_distinct(F.transform(named, lambda x: x["license"])))
    return d.select("doc_id", n_of("licenses").alias("n_blocks"), n_of(named).alias("n_confirmed"), F.array_join(names, ",").alias("licenses"), F.array_max(F.transform("licenses", lambda x: x["saved"])).alias("most_saved"), F.aggregate(named, F.lit(0).cast("long"), lambda a, x: a + x["differences"]).alias("n_differences"))
