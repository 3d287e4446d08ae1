"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates and texts are word sequences. Hashes of ``k`` words in a row are winnowed: of every ``w`` in a row
the smallest is kept, so a run of ``k + w - 1`` common words always shares a fingerprint. Fingerprints of the
templates form an inverted index. Hits of a text on diagonals at most ``band`` words apart are a candidate place;
there the template is aligned with the text within a band of ``band`` words around the diagonals hit, and words
matched in the best alignment give coverage and span. Hits before and after it are aligned again among
themselves, so notices that follow each other are all found. A short notice needs more than coverage: the words that tell it from
others, its name and version, all have to be matched. Of places that overlap, whatever their templates, the one with most words matched
counts. The index is small and the same in all tasks, so
texts are never shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_batches

# Standard notices and texts, by SPDX identifier and, where there are several, the kind of text.
_TEXTS = {
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
        "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
}
_FREE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free "
    "Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_MOZILLA = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = {"GPL": ("2.0", "3.0"), "LGPL": ("2.1", "3.0"), "AGPL": ("3.0",)}
_NAMED = {
    "Apache": ("Apache License", ("1.1", "2.0")),
    "EPL": ("Eclipse Public License", ("1.0", "2.0")),
    "MPL": ("Mozilla Public License", ("1.1", "2.0")),
    "CDDL": ("Common Development and Distribution License", ("1.0", "1.1")),
}
_TERMS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_CREATIVE = [f"BY{more}" for more in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND")]
#: Words that many notices have: all others, names and numbers of versions, have to be there.
_COMMON = set("a any at by copy file international is license licensed of or released software the this to under v version work 0".split())
_SHORT = 16


def _notices() -> dict[str, str]:
    """Notices of one sentence for each licence and version, and the texts."""
    out = {"MIT": "Released under the MIT License.", "ISC": "Released under the ISC License."}
    for n in (2, 3):
        out[f"BSD-{n}-Clause"] = f"Released under the BSD {n}-Clause License."
    for short, (name, versions) in _NAMED.items():
        out |= {f"{short}-{v}": f"Licensed under the {name}, Version {v}." for v in versions}
    for short, name in _GNU.items():
        for v in _GNU_VERSIONS[short]:
            number = v.removesuffix(".0")
            out[f"{short}-{v}"] = f"This work is licensed under the {name}, version {number}."
            out[f"{short}-{v}-header"] = _FREE.format(name=name, version=number)
    for kind in _CREATIVE:
        for v in ("3.0", "4.0"):
            out[f"CC-{kind}-{v}"] = f"Licensed under CC {kind} {v}."
            terms = "-".join(_TERMS[t] for t in kind.split("-"))
            out[f"CC-{kind}-{v}-notice"] = f"This work is licensed under a Creative Commons {terms} {v} International License."
    return out | {"MPL-2.0-header": _MOZILLA} | _TEXTS


TEMPLATES = _notices()
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LicenseScan:
    k: int = 3
    w: int = 2
    band: int = 8
    coverage: float = 0.6


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 250_000 and len(word) < 64:
            self[word] = value
        return value


def fingerprints(words: list[str], spec: LicenseScan, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes and their positions. A sequence too short for a window has all its hashes."""
    if len(words) < spec.k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - spec.k + 1
    z = np.zeros(n, np.uint64)
    for i in range(spec.k):
        z = (z ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
    if n <= spec.w:
        return z, np.arange(n)
    # The last of equal minima, as winnowing has it: look at the window backwards.
    windows = np.lib.stride_tricks.sliding_window_view(z, spec.w)[:, ::-1]
    at = np.unique(np.arange(n - spec.w + 1) + spec.w - 1 - windows.argmin(axis=1))
    return z[at], at


def telling(templates: dict[str, list[str]]) -> dict[str, Counter]:
    """The words each template cannot do without: of a notice its name and version, of a header those of the
    notice it is named after."""
    own = lambda name: [w for w in templates[name] if w not in _COMMON] if len(templates[name]) <= _SHORT else []
    return {name: Counter(own(base if (base := name.removesuffix("-header")) in templates else name)) for name in templates}


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """The most template words matched in order, with the first and last (exclusive) word of the text that
    matches. Template word i may match text words i + low to i + high; among equals the shortest span."""
    # State of a band cell: (matched, start), so that of equal matches the latest start goes on; ends are read off
    # the best cell.
    width = high - low + 1
    row, best = [(0, 0)] * width, (0, 0, 0, 0)
    for i, word in enumerate(template):
        new = []
        for d in range(width):
            j = i + low + d
            up = row[d + 1] if d + 1 < width else (0, 0)
            left = new[d - 1] if d else (0, 0)
            cell = max(up, left)
            if 0 <= j < len(words) and words[j] == word:
                matched, start = row[d]
                step = (matched + 1, start if matched else j)
                if step > cell:
                    cell = step
                    best = max(best, (cell[0], cell[1] - j - 1, -j, cell[1]))
            new.append(cell)
        row = new
    matched, _, minus_end, start = best
    return (matched, start, 1 - minus_end) if matched else (0, 0, 0)


def occurrences(
    template: list[str], words: list[str], hits: list[tuple[int, int]], spec: LicenseScan, needed: Counter = Counter()
) -> list[tuple[int, int, int]]:
    """``(matched, first, last)`` of the places around hits ``(diagonal, position)``, sorted and close together:
    the best alignment, and those of the hits wholly before and wholly after it. Places without the words ``needed`` are left out."""
    found, work = [], [(0, len(words), hits)]
    while work:
        first, last, hits = work.pop()
        low, high = hits[0][0] - spec.band, hits[-1][0] + spec.band
        start = max(first, low)
        matched, a, b = align(template, words[start : min(last, high + len(template))], low - start, high - start)
        if matched < spec.coverage * len(template):
            continue
        a, b = a + start, b + start
        if not needed - Counter(words[a:b]):
            found.append((matched, a, b))
        if before := [h for h in hits if h[1] + spec.k <= a]:
            work.append((first, a, before))
        if after := [h for h in hits if h[1] >= b]:
            work.append((b, last, after))
    return found


def best_apart(places: list[tuple]) -> list[tuple]:
    """Places ``(matched, first, last, coverage, name)`` by position, without those that overlap one with more words matched, or as
    many and, in this order, a shorter span, a higher coverage, further left, or a name that sorts first."""
    taken: list[tuple] = []
    for matched, a, b, coverage, name in sorted(set(places), key=lambda p: (-p[0], p[2] - p[1], -p[3], p[1], p[4])):
        at = bisect.bisect_left(taken, (a,))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b, matched, coverage, name))
    return [(matched, a, b, coverage, name) for a, b, matched, coverage, name in taken]


def license_spans(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    spec: LicenseScan = LicenseScan(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, license, coverage, matched, start, end)``: a row for every place where at least
    ``spec.coverage`` of a template's words are matched, in code points, end exclusive. The id keeps its name.

    Of places that overlap the best is reported, whatever their templates; places that do not are all reported. Of templates matched alike, as
    a notice that is part of another's words, the first by name. Long texts are scanned whole. NULL and
    empty texts, and texts without a license, give no row. A repeated row gives its rows again; a NULL id is passed on. Templates with fewer than
    ``k`` words are refused. Other columns are not read.
    """
    spelled = {name: _WORD.findall(text.lower()) for name, text in templates.items()}
    if short := [name for name, words in spelled.items() if len(words) < spec.k]:
        raise ValueError(f"templates with too few words: {short}")
    needed = telling(spelled)

    def start():
        hashes = _Hashes()
        index: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, words in spelled.items():
            for h, at in zip(*fingerprints(words, spec, hashes), strict=True):
                index[int(h)].append((name, int(at)))
        known = np.array(sorted(index), np.uint64)

        def places(text: str):
            low = text.lower()
            words = _WORD.findall(low)
            found, at = fingerprints(words, spec, hashes)
            hit = np.isin(found, known, kind="sort") if len(found) else np.empty(0, bool)
            if not hit.any():
                return
            # Lower-casing may change the length of a text; words are found again in the text itself.
            spans = [m.span() for m in _WORD.finditer(text)]
            if len(spans) != len(words):
                words = [text[a:b].lower() for a, b in spans]
                found, at = fingerprints(words, spec, hashes)
                hit = np.isin(found, known, kind="sort") if len(found) else np.empty(0, bool)
            hits = defaultdict(list)
            for h, j in zip(found[hit].tolist(), at[hit].tolist(), strict=True):
                for name, i in index[h]:
                    hits[name].append((j - i, j))
            chosen, there = [], set(words)
            for name, of_template in hits.items():
                template, group = spelled[name], []
                if not there.issuperset(needed[name]):
                    continue
                for one in [*sorted(of_template), None]:
                    if group and (one is None or one[0] - group[0][0] > spec.band):
                        chosen += [(m, a, b, m / len(template), name) for m, a, b in occurrences(template, words, group, spec, needed[name])]
                        group = []
                    group.append(one)
            for matched, a, b, coverage, name in best_apart(chosen):
                yield name, coverage, matched, spans[a][0], spans[b - 1][1]

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for place in places(text) if text else ():
                    rows.append(i)
                    found.append(place)
            columns = list(zip(*found, strict=True)) or [()] * 5
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            names = ("license", "coverage", "matched", "start", "end")
            return pa.RecordBatch.from_pydict(
                {"id": batch.column(0).take(pa.array(rows, pa.int64()))}
                | {n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}
            )

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, license string, coverage double, matched bigint, start bigint, end bigint"
    return map_batches(texts, start, schema).withColumnRenamed("id", id_col)
