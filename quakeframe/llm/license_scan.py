"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are cut into tokens (runs of ASCII letters and digits, and of other characters), and into
shingles of five tokens. Windows of several lengths overlap so far that a copy of a template lies whole in a window
of its size class, which has under four times the template's shingles (the smallest class: eight shingles for a
template of up to five). Windows and templates have a signature of 48 minima, one row to a band: a window retrieves a
template when the signatures agree in a band. A window that holds a share c of the template's shingles resembles it
by c / (5 - c) at least, so a whole copy collides with probability 1 - (3/4)^48, over 0.999998, and one of 0.8 with
1 - (1 - 0.8/4.2)^48, over 0.9999 (a template of one shingle in a window of eight: over 0.998). Verification is exact:
the share of the template's distinct shingles that the window holds must reach CONTAINMENT.

Overlapping windows of a template are one region, in which each copy is placed by itself: spans of the template's
length first, then a quarter longer, then up to a window's, each time those of the largest containment that no copy
before them holds, and that agree with the template in most places. So copies next to each other are rows of their own. Where templates share most of their shingles, a match that overlaps one of more shingles is left out: a text of three clauses is not also one of two.

Defined results: null, empty and short texts (under five tokens) hold nothing; rows repeated with one id each get
their own result rows; templates of equal text are all reported; an empty table gives an empty result; other columns
are ignored. Templates are a parameter, few and fixed (TEMPLATE_TOKENS together at most).
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import text_batches

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 48
TEMPLATE_TOKENS = 500_000
STEP = 4  # tokens between the smallest windows; the others' steps are multiples of it

#: Notices by which texts state their license.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MULTIPLY = (np.random.default_rng(20240101).integers(0, 2**64, BANDS, dtype=np.uint64) | np.uint64(1)).tolist()


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_TABLE).split()


def token_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w, 5)
        out.append(h)
    if len(cache) > 500_000:
        cache.clear()
    return np.array(out, dtype=np.uint64)


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE tokens."""
    if len(h) < SHINGLE:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return out ^ (out >> np.uint64(32))


@dataclass
class Index:
    """Templates by number: name, distinct shingles, all shingles in order, number of tokens; the bands of each class; which other templates share most of each."""

    names: list[str]
    sets: list[np.ndarray]
    runs: list[np.ndarray]
    sizes: list[int]
    wanted: dict[int, dict[tuple[int, int], list[int]]]  # class (windows of 2^class blocks) -> band and minimum -> templates
    bits: np.ndarray  # of the low 16 bits of all shingles
    minima: np.ndarray  # of the low 16 bits of the shingles in signatures
    within: list[set[int]]

    @property
    def classes(self) -> list[int]:
        return sorted(self.wanted)


def window_class(size: int) -> int:
    """Smallest k such that windows of STEP * 2^k shingles, half of it apart, hold a run of the template's shingles somewhere."""
    k, need = 1, size - SHINGLE + 1
    while STEP * 2**k - STEP * 2 ** (k - 1) + 1 < need:
        k += 1
    return k


def index(templates: Mapping[str, str] = TEMPLATES) -> Index:
    cache: dict[bytes, int] = {}
    out = Index([], [], [], [], defaultdict(lambda: defaultdict(list)), np.zeros(65536, dtype=bool), np.zeros(65536, dtype=bool), [])
    for name, text in sorted(templates.items()):
        words = tokens(text)
        run = shingles(token_hashes(words, cache))
        s = np.unique(run)
        if not len(s):
            raise ValueError(f"template {name} has fewer than {SHINGLE} tokens")
        k = window_class(len(words))
        for band, m in enumerate(_MULTIPLY):
            x = s[np.argmin(s * np.uint64(m))]
            out.wanted[k][band, int(x)].append(len(out.names))
            out.minima[int(x) & 0xFFFF] = True
        out.bits[(s & np.uint64(0xFFFF)).astype(np.int64)] = True
        out.names.append(name)
        out.sets.append(s)
        out.runs.append(run)
        out.sizes.append(len(words))
    for k, s in enumerate(out.sets):
        out.within.append({j for j, t in enumerate(out.sets) if j != k and np.isin(s, t).mean() >= CONTAINMENT / 1.25})
    if sum(out.sizes) > TEMPLATE_TOKENS:
        raise ValueError(f"templates of over {TEMPLATE_TOKENS} tokens do not go to every task")
    out.wanted = {k: dict(v) for k, v in out.wanted.items()}
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """For each band, the shingle of the smallest permuted hash in every block of STEP shingles (blocks x bands).

    A permutation is a multiplication by an odd number; multiplied by its inverse, the minimum gives the shingle back.
    """
    n = -(-len(s) // STEP)
    padded = np.concatenate([s, np.repeat(s[-1:], n * STEP - len(s))]).reshape(n, STEP)
    return np.stack([(padded * np.uint64(m)).min(axis=1) for m in _MULTIPLY], axis=1)


_INVERSE = np.array([pow(m, -1, 2**64) for m in _MULTIPLY], dtype=np.uint64)


def scan_text(ix: Index, words: list[bytes], cache: dict[bytes, int]) -> list[tuple[int, float, int, int]]:
    """(template, containment, first token, tokens) of the matches in a text, for each template one per run of overlapping matches."""
    s = shingles(token_hashes(words, cache))
    if not len(s):
        return []
    possible = ix.bits[(s & np.uint64(0xFFFF)).astype(np.int64)]
    if not possible.any():  # no window can retrieve anything
        return []
    mins = minima(s)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    size = 1  # blocks of which ``mins`` has the minima, starting at every ``size`` blocks' half
    level = mins
    for k in range(1, max(ix.classes) + 1):
        # windows of 2^k blocks start every 2^(k-1) blocks: two halves next to each other
        window = np.minimum(level[:-1], level[1:]) if len(level) > 1 else level
        if k in ix.wanted:
            wanted = ix.wanted[k]
            back = window * _INVERSE
            likely = ix.minima[(back & np.uint64(0xFFFF)).astype(np.int64)]
            for w in np.flatnonzero(likely.any(axis=1)).tolist():
                bands = np.flatnonzero(likely[w]).tolist()
                near = {t for b, x in zip(bands, back[w][likely[w]].tolist(), strict=True) for t in wanted.get((b, x), ())}
                first = w * size * STEP
                inside = s[first : first + STEP * 2**k]
                for t in near:
                    if len(np.unique(inside[np.isin(inside, ix.sets[t])])) >= CONTAINMENT * len(ix.sets[t]):
                        found[t].append((first, first + len(inside)))
        if k < max(ix.classes):  # halves of the next class: disjoint pairs
            if len(level) % 2:
                level = np.concatenate([level, level[-1:]])
            level = np.minimum(level[0::2], level[1::2])
            size *= 2
    once: list[tuple[int, float, int, int]] = []
    for t, windows in sorted(found.items()):
        for lo, hi in _regions(windows):
            have = lo + np.flatnonzero(np.isin(s[lo:hi], ix.sets[t]))
            once += [(t, n / len(ix.sets[t]), int(a), int(z - a) + SHINGLE) for n, a, z in _copies(s, have, ix.runs[t], len(ix.sets[t]))]
    held: dict[int, list[tuple[int, float, int, int]]] = defaultdict(list)
    for m in once:
        held[m[0]].append(m)
    weight = lambda m: (m[1] * len(ix.sets[m[0]]), m[0])
    kept = [m for m in once if not any(weight(o) > weight(m) for t in ix.within[m[0]] for o in _overlapping(held.get(t, []), m))]
    return sorted(kept, key=lambda m: (m[2], m[0]))


def _regions(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping windows joined, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(windows):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _copies(s: np.ndarray, at: np.ndarray, run: np.ndarray, distinct: int) -> list[tuple[int, int, int]]:
    """(distinct shingles held, first and last place) of each copy of a template (its shingles in order: ``run``) among the places ``at`` of its shingles in ``s``; copies do not overlap.

    Of spans that hold as many, the one that agrees with the template in most places comes first: where a template says
    a thing twice, the end of one copy and the start of the next hold all of it too.
    """
    out: list[tuple[int, int, int]] = []
    places: dict[int, list[int]] = defaultdict(list)
    for k, x in enumerate(run.tolist()):
        places[x].append(k)

    def agreeing(a: int, z: int) -> int:
        along = [(s[a : z + 1], run[k : k + z + 1 - a]) for k in places[int(s[a])]]
        return max(int((x[: len(y)] == y).sum()) for x, y in along)

    for width in (len(run), len(run) + len(run) // 4 + SHINGLE, 4 * len(run)):
        while True:
            new = []
            for n, a, z in sorted(_spans(at, s[at], width, CONTAINMENT * distinct), key=lambda x: (-x[0], -agreeing(x[1], x[2]), x[2] - x[1], x[1])):
                k = bisect.bisect_left(out, z + 1, key=lambda m: m[1])
                if not (k and out[k - 1][2] >= a):
                    out.insert(k, (n, a, z))
                    new.append((a, z))
            if not new:
                break
            free = np.ones(len(at), dtype=bool)
            for a, z in new:
                free &= (at < a) | (at > z)
            at = at[free]
    return out


def _spans(at: np.ndarray, shingle: np.ndarray, width: int, least: float) -> list[tuple[int, int, int]]:
    """From each place, what a span of up to ``width`` holds: distinct shingles and the last place that adds one; those of ``least`` or more."""
    places, kinds = at.tolist(), shingle.tolist()
    out, end = [], 0
    count: dict[int, int] = defaultdict(int)
    for k, a in enumerate(places):
        while end < len(places) and places[end] < a + width:
            count[kinds[end]] += 1
            end += 1
        if len(count) >= least:
            last = end - 1
            spare = dict.fromkeys(count, 0)
            while count[kinds[last]] - spare[kinds[last]] > 1:  # it adds nothing
                spare[kinds[last]] += 1
                last -= 1
            out.append((len(count), a, places[last]))
        count[kinds[k]] -= 1
        if not count[kinds[k]]:
            del count[kinds[k]]
    return out


def _overlapping(matches: list[tuple[int, float, int, int]], of: tuple[int, float, int, int]) -> list[tuple[int, float, int, int]]:
    """Of one template's matches in their order, which do not overlap each other, those that overlap another match."""
    lo = bisect.bisect_right(matches, of[2], key=lambda m: m[2])
    hi = bisect.bisect_left(matches, of[2] + of[3], key=lambda m: m[2])
    return [m for m in matches[max(lo - 1, 0) : hi] if m[2] + m[3] > of[2]]


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_token, n_tokens of every match. Every row is scanned where it is read; nothing is shuffled."""
    shipped = documents.sparkSession.sparkContext.broadcast(index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, cache = shipped.value, {}
        for rest, texts in text_batches(batches):
            rows = [(doc, *m) for doc, text in zip(rest["doc_id"], texts, strict=True) for m in scan_text(ix, tokens(text), cache)]
            doc, t, share, first, n = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([ix.names[k] for k in t], pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "license", "containment", "first_token", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, containment double, first_token int, n_tokens int")


def exact(words: list[bytes], template: list[bytes]) -> float:
    """The largest share of a template's distinct shingles in a window of twice its length, by trying every window (for tests)."""
    grams = lambda w: [tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)]
    want, have = set(grams(template)), grams(words)
    width = 2 * len(template)
    return max((len(want & set(have[k : k + width])) / len(want) for k in range(max(1, len(have) - width + 1))), default=0.0)


