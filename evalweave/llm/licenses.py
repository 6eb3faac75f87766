"""License scans: fingerprints pick candidates, alignment decides.

Texts and templates are words in lower case. Hashes of GRAM words in a row are winnowed: of every WINNOW
neighbouring hashes the least is kept, so a run of GRAM + WINNOW - 1 words that a text shares with a template
shares a kept hash. An inverted index from kept hashes to places in templates turns a text's hits into
(template, diagonal) candidates. Short templates, of which an edit may leave no such run, are indexed by all their
pairs of words instead, and texts are looked up pair by pair. Each candidate is aligned in a band around its diagonals; what part of the template's
words match, and where the first and last of them stand in the text, is reported.

Of detections that overlap in a text, the one with more matched words stands (of equal ones the one with the
larger coverage).

Templates are a small table that every task holds. Defined cases: a null or empty text has no detection;
repeated rows are reported each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import batch_of, id_text, map_slices
from .words import flat_words

GRAM, WINNOW, LEAST_COVERAGE, SLACK = 3, 2, 0.8, 0.2
#: Templates of fewer words are short: with LEAST_COVERAGE of them in place, two in a row are left, but maybe no more.
SHORT, PAIR = 14, 2
#: A template of many fingerprints is a candidate from so large a part of them on.
LEAST_HITS = 0.1

#: Public notices and licence texts by which works name their terms.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved-notice": "All rights reserved.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_WORD = re.compile(r"[^\W_]+")


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case and where they stand in the text."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def gram_hashes(hashes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """One hash for each ``gram`` words in a row."""
    n = max(0, len(hashes) - gram + 1)
    out = np.full(n, gram, np.uint64)
    for k in range(gram):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : k + n]
        out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


def winnow(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the kept hashes: of each WINNOW neighbours of one owner the least, the first of equals.
    An owner with fewer keeps its least."""
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    kept = np.zeros(n, bool)
    largest = np.uint64(2**64 - 1)
    ahead = np.full((WINNOW, n), largest)
    for k in range(WINNOW):
        ahead[k, : n - k] = np.where(owner[: n - k] == owner[k:], grams[k:], largest)
    # windows that reach past their owner's end only count if they are the owner's only one
    whole = np.zeros(n, bool)
    whole[: max(0, n - WINNOW + 1)] = owner[: max(0, n - WINNOW + 1)] == owner[WINNOW - 1 :]
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    use = np.flatnonzero(whole | first)
    kept[use + ahead[:, use].argmin(0)] = True
    return np.flatnonzero(kept)


@dataclass
class Index:
    """Templates' words, and (template, place) by kept hash."""

    names: list[str]
    words: list[list[str]]
    places: dict[int, list[tuple[int, int]]]
    hashes: np.ndarray
    kept: list[int]


@cache
def build_index(templates: tuple[tuple[str, str], ...]) -> Index:
    names, words, places, kept = [], [], defaultdict(list), []
    for t, (name, text) in enumerate(templates):
        own = words_at(text)[0]
        short = len(own) < SHORT
        grams = gram_hashes(np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64), PAIR if short else GRAM)
        picked = np.arange(len(grams)) if short else winnow(grams, np.zeros(len(grams), np.int64))
        for at in picked.tolist():
            places[int(grams[at])].append((t, at))
        names.append(name)
        words.append(own)
        kept.append(len(picked))
    return Index(names, words, dict(places), np.array(sorted(places), np.uint64), kept)


def align(template: list[str], text: list[str], low: int, high: int) -> tuple[int, int, int] | None:
    """(matched words, first, end) of the best local alignment with text place - template place in low..high.

    A match is worth 2; a word without a partner on either side, or two that differ, cost 1. The first and
    last pair of a best alignment always match.
    """
    width = high - low + 1
    before = [(0, 0, 0)] * width  # (score, matched, first) for each diagonal
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        row = [(0, 0, 0)] * width
        for d in range(width):
            j = i + low + d
            if not 0 <= j < len(text):
                continue
            score, matched, first = before[d]
            if word == text[j]:
                top = (score + 2, matched + 1, first if matched else j)
            else:
                top = (score - 1, matched, first)
            if d + 1 < width and before[d + 1][0] - 1 > top[0]:  # a template word without a partner
                top = (before[d + 1][0] - 1, *before[d + 1][1:])
            if d and row[d - 1][0] - 1 > top[0]:  # a text word without a partner
                top = (row[d - 1][0] - 1, *row[d - 1][1:])
            if top[0] > 0:
                row[d] = top
                if top[0] > best[0]:
                    best = (top[0], top[1], top[2], j + 1)
        before = row
    return best[1:] if best[0] else None


def candidates(hits: list[tuple[int, int]], index: Index) -> list[tuple[int, int, int]]:
    """(template, least diagonal, largest diagonal) of hits (text place, hash) that lie near one another."""
    by: dict[int, list[int]] = defaultdict(list)
    for at, value in hits:
        for t, place in index.places[value]:
            by[t].append(at - place)
    out = []
    for t, diagonals in by.items():
        slack = max(1, int(SLACK * len(index.words[t])))
        diagonals.sort()
        group = [diagonals[0]]
        for d in [*diagonals[1:], None]:
            if d is not None and d - group[-1] <= slack:
                group.append(d)
                continue
            if len(group) >= LEAST_HITS * index.kept[t]:
                out.append((t, group[0] - slack, group[-1] + slack))
            group = [d]
    return out


def detections(text: str, index: Index, hits: list[tuple[int, int]]) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) with places in characters of the text."""
    words, spans = words_at(text)
    found = []
    for t, low, high in candidates(hits, index):
        own = index.words[t]
        # only the words that the band can reach
        begin, end = max(0, low), min(len(words), len(own) + high)
        best = align(own, words[begin:end], low - begin, high - begin)
        if best and best[0] >= LEAST_COVERAGE * len(own):
            matched, a, b = best
            found.append((matched / len(own), matched, spans[begin + a][0], spans[begin + b - 1][1], index.names[t]))
    return standing(found)


def standing(found: list[tuple[float, int, int, int, str]]) -> list[tuple[str, float, int, int, int]]:
    """Detections without those that overlap a better one."""
    kept: list[tuple] = []
    for coverage, matched, start, end, name in sorted(found, key=lambda x: (-x[1], -x[0], x[2], x[4])):
        if all(end <= a or b <= start for _, _, _, a, b in kept):
            kept.append((name, coverage, matched, start, end))
    return sorted(kept, key=lambda x: x[3])


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, matched_words, start, end): a row for each detection in the whole texts."""
    table = tuple(templates.items())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = build_index(table)
        texts = batch.column("text")
        starts, place, words = flat_words(texts)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[place] if len(place) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gram in (PAIR, GRAM):
            grams = gram_hashes(hashes, gram)
            inside = np.flatnonzero(owner[: len(grams)] == owner[gram - 1 :]) if len(grams) else np.empty(0, np.int64)
            picked = inside if gram == PAIR else inside[winnow(grams[inside], owner[inside])]
            near = np.minimum(np.searchsorted(index.hashes, grams[picked]), len(index.hashes) - 1)
            picked = picked[index.hashes[near] == grams[picked]] if len(index.hashes) else picked[:0]
            for at in picked.tolist():
                hits[int(owner[at])].append((at - int(starts[owner[at]]), int(grams[at])))
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[i], *found) for i, own in hits.items() for found in detections(texts[i].as_py(), index, own)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = {"doc_id": pa.int64(), "license": pa.string(), "coverage": pa.float64(), "matched_words": pa.int32(), "start": pa.int64(), "end": pa.int64()}
        return batch_of(**{name: (list(values), kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)})

    return map_slices(id_text(df, id_col, text_col), run, "doc_id long, license string, coverage double, matched_words int, start long, end long", "text")
