"""Licence scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and texts are cut into words; hashes of ``GRAM`` neighbouring words, of which
winnowing keeps the least of every ``KEEP`` in a row, are the fingerprints.  Those of the
templates form an inverted index (bounded by the templates, which are a parameter).  Every
fingerprint that a text shares with a template votes for a diagonal of their alignment;
around each diagonal with votes the template is aligned once, in a band, unless too few of its
words are there at all.  All alignments with one template run together, row by row, and what
is found is reported with its coverage and span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm import textkernel as K
from volpanel.llm.frames import arrow_map

GRAM = 3
KEEP = 2
BAND = 12
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_COVERAGE = 0.7
SPANS = "array<struct<license:string,start:long,end:long,coverage:double>>"
SPAN_TYPE = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

#: Notices by which common licences are given, and paragraphs of their texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD": "Released under the BSD License.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "Released under the Unlicense.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MIT-terms": "Distributed under the terms of the MIT License.",
    "Apache-2.0-applies": "The Apache 2.0 license applies.",
    "GPL-2.0-name": "GNU General Public License v2.0 or later",
    "GPL-3.0-name": "GNU General Public License v3.0 or later",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

#: Of the short notices, the words without which a span is not theirs: names and versions.
REQUIRED = {
    "MIT": "mit", "BSD": "bsd", "ISC": "isc", "Unlicense": "unlicense", "Apache-2.0": "apache 2 0", "MPL-2.0": "mozilla 2 0",
    "GPL-2.0": "gnu 2", "GPL-3.0": "gnu 3", "GPL-notice": "gnu 3", "LGPL-2.1": "lesser 2 1", "LGPL-3.0": "lesser 3", "AGPL-3.0": "affero 3",
    "MIT-terms": "mit", "Apache-2.0-applies": "apache 2 0", "GPL-2.0-name": "gnu v2 0", "GPL-3.0-name": "gnu v3 0",
    "CC-BY-4.0": "cc by 4 0", "CC-BY-SA-4.0": "cc by sa 4 0", "CC-BY-NC-4.0": "cc by nc 4 0",
}

#: Identifiers of licences; a line with one is a template of its own.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)
for _id in SPDX:
    TEMPLATES[f"SPDX:{_id}"] = f"SPDX-License-Identifier: {_id}"
    REQUIRED[f"SPDX:{_id}"] = "spdx " + _id.lower().replace("-", " ").replace(".", " ")


class _Words:
    """Words of a batch and their winnowed fingerprints."""

    def __init__(self, texts: list[str]) -> None:
        self.batch = batch = K.Batch([t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t) for t in texts])
        self.starts, self.ends = batch.runs(K.wordlike(batch.codes))
        self.words, self.owner = batch.hashes(self.starts, self.ends), batch.owner(self.starts)
        self.firsts = np.searchsorted(self.owner, np.arange(batch.n + 1))
        grams, at = K.ngrams(self.words, self.owner, GRAM)
        keep = np.zeros(len(grams), bool)
        if len(grams):
            of = self.owner[at]
            n = len(grams) - KEEP + 1
            if n > 0:
                windows = np.lib.stride_tricks.sliding_window_view(grams, KEEP)
                inside = of[:n] == of[KEEP - 1 :]
                # The rightmost least hash of each window.
                low = np.arange(n) + KEEP - 1 - windows[:, ::-1].argmin(1)
                keep[low[inside]] = True
            # A text of fewer grams than a window keeps its least one.
            many = np.bincount(of, minlength=batch.n)
            for i in np.flatnonzero((many > 0) & (many < KEEP)):
                own = np.flatnonzero(of == i)
                keep[own[grams[own].argmin()]] = True
        self.prints, self.places = grams[keep], at[keep]


def compile_index(templates: dict[str, str]) -> dict:
    """Inverted index of the templates: their winnowed fingerprints, sorted, the template and word of each; their words.

    A text and a template that have GRAM + KEEP - 1 words in a row in common choose a common fingerprint there.
    """
    names = sorted(templates)
    w = _Words([templates[n] for n in names])
    order = np.argsort(w.prints, kind="stable")
    of = w.owner[w.places]
    words = [w.words[w.firsts[i] : w.firsts[i + 1]] for i in range(len(names))]
    needed = [_Words([REQUIRED.get(n, "") if templates[n] == TEMPLATES.get(n) else ""]).words for n in names]
    return {"needed": needed, "names": names, "prints": w.prints[order], "template": of[order], "place": (w.places - w.firsts[of])[order], "words": words}


WIDTH = 2 * BAND + 1
TOGETHER = 1 << 22  # cells of the traces of alignments that run together


def align(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Banded local alignments around several diagonals: matched words, first and end word of the text, a row each.

    A diagonal is text index less template index; the band reaches BAND to either side.  Of
    equally good ends the one nearest to the diagonal counts, then the first.  Rows of the template are
    gone through once; runs of skipped words of the text come from a running maximum.
    """
    n, many = len(template), len(diagonals)
    out = np.zeros((many, 3), np.int64)
    most = max(TOGETHER // max(n * WIDTH, 1), 1)
    if many > most:
        return np.concatenate([align(template, text, diagonals[k : k + most]) for k in range(0, many, most)])
    if not many or not n or not len(text):
        return out
    shift = np.arange(WIDTH)
    score = np.zeros((many, WIDTH + 1), np.int64)
    trace = np.zeros((n, many, WIDTH), np.int8)  # 0 start, 1 diagonal, 2 skip template, 3 skip text
    near = -np.abs(shift - BAND)
    best = np.full((many, 3), (0, -BAND - 1, 0))  # value, nearness, row
    best_k = np.zeros(many, np.int64)
    for i in range(n):
        j = (i + diagonals)[:, None] + shift - BAND
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == template[i])
        options = np.stack([np.zeros((many, WIDTH), np.int64), score[:, :-1] + np.where(same, MATCH, MISMATCH), score[:, 1:] + GAP])
        pick = options.argmax(0)
        plain = np.where(inside, options.max(0), 0)
        run = np.maximum.accumulate(plain - GAP * shift, 1) + GAP * shift
        row = np.where(inside, run, 0)
        trace[i] = np.where(inside, np.where(run > plain, 3, pick), 0)
        score = np.concatenate([row, np.zeros((many, 1), np.int64)], 1)
        k = (row * (2 * BAND + 2) + near).argmax(1)
        value, place = row[np.arange(many), k], near[k]
        better = (value > best[:, 0]) | (value == best[:, 0]) & (value > 0) & (place > best[:, 1])
        best[better] = np.stack([value, place, np.full(many, i)], 1)[better]
        best_k[better] = k[better]
    for c in range(many):
        if not best[c, 0]:
            continue
        i, k = int(best[c, 2]), int(best_k[c])
        d = int(diagonals[c]) - BAND
        end, matched, first = i + d + k + 1, 0, 0
        while i >= 0 and 0 <= k < WIDTH and trace[i, c, k]:
            move, j = trace[i, c, k], i + d + k
            if move == 1:
                matched += int(text[j] == template[i])
                first, i = j, i - 1
            elif move == 2:
                i, k = i - 1, k + 1
            else:
                first, k = j, k - 1
        out[c] = matched, first, end
    return out


def _enough(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Whether the band around each diagonal holds enough of the template's words, wherever they stand."""
    distinct, often = np.unique(template, return_counts=True)
    at = K.find(distinct, text)
    places = [np.flatnonzero(at == d) for d in range(len(distinct))]
    low, high = diagonals - BAND, diagonals + len(template) + BAND
    there = np.zeros(len(diagonals), np.int64)
    for own, count in zip(places, often.tolist(), strict=True):
        there += np.minimum(np.searchsorted(own, high) - np.searchsorted(own, low), count)
    return there >= MIN_COVERAGE * len(template)


def _found_spans(template: np.ndarray, needed: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches of the text that the template covers: matched, first and end word, without overlaps.

    What is found is taken out of the text and the diagonals are tried again, until nothing
    more is found; so a weaker copy beside a better one is found too.
    """
    found: list[tuple[int, int, int]] = []
    text = text.copy()
    while len(diagonals := diagonals[_enough(template, text, diagonals)]):
        got = align(template, text, diagonals)
        fresh = []
        for matched, a, b in sorted({tuple(x) for x in got.tolist()}, key=lambda x: (-x[0], x[1], x[2])):
            if matched >= MIN_COVERAGE * len(template) and np.isin(needed, text[a:b]).all() and all(b <= s or a >= e for _, s, e in fresh):
                fresh.append((matched, a, b))
        if not fresh:
            break
        for _, a, b in fresh:
            text[a:b] = 0  # stands for no word
        found += fresh
    return found


def scan_texts(index: dict, raw: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
    """Licences of each text: name, span in code points, share of the template's words that match."""
    texts = [x or "" for x in raw]
    out: list[list] = [[] for _ in texts]
    if not len(index["prints"]):
        return out
    w = _Words(texts)
    low = np.searchsorted(index["prints"], w.prints, "left")
    many = np.searchsorted(index["prints"], w.prints, "right") - low
    vote = np.repeat(np.arange(len(w.prints)), many)
    entry = low[vote] + np.arange(len(vote)) - np.repeat(np.cumsum(many) - many, many)
    owner = w.owner[w.places[vote]]
    # A row for each text, template and diagonal that has votes.
    votes = np.unique(np.stack([owner, index["template"][entry], w.places[vote] - w.firsts[owner] - index["place"][entry]], 1), axis=0)
    pairs = np.flatnonzero(np.concatenate([[True], (votes[1:, :2] != votes[:-1, :2]).any(1)])) if len(votes) else np.zeros(0, np.int64)
    best: list[list] = [[] for _ in texts]
    for start, end in zip(pairs.tolist(), [*pairs.tolist(), len(votes)][1:], strict=True):
        i, t = votes[start, :2].tolist()
        first, last = int(w.firsts[i]), int(w.firsts[i + 1])
        template = index["words"][t]
        for matched, a, b in _found_spans(template, index["needed"][t], w.words[first:last], votes[start:end, 2]):
            coverage = matched / len(template)
            place = int(w.starts[first + a] - w.batch.starts[i])
            best[i].append((matched, coverage, (index["names"][t], place, int(w.ends[first + b - 1] - w.batch.starts[i]), round(coverage, 6))))
    for spans, ranked in zip(out, best, strict=True):
        # Of templates whose spans overlap, the one with the most matched words, then the best covered.
        for _, _, span in sorted(ranked, key=lambda x: (-x[0], -x[1], x[2])):
            if all(span[2] <= s[1] or span[1] >= s[2] for s in spans):
                spans.append(span)
        spans.sort(key=lambda s: (s[1], s[0]))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Licences of each row of ``docs`` (doc_id, text): doc_id, spans by start and name.

    Null and empty texts have none.  Rows are independent: repeated rows give repeated
    results, an empty table an empty one.  One pass, no shuffle; the index goes to every
    task and is bounded by the templates given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_index(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("license", "start", "end", "coverage")
        for ids, raw in K.texts_of(batches, "doc_id"):
            spans = [[dict(zip(names, s, strict=True)) for s in x] for x in scan_texts(shared.value, raw)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, SPAN_TYPE)], ["doc_id", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, f"doc_id long, spans {SPANS}")


def licenses_of(docs: DataFrame) -> DataFrame:
    """All licences found in ``docs``: doc_id, n_licenses, licenses, best_coverage, spans as text."""
    found = scan(docs)
    text = F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["coverage"], 3)))
    return found.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.array_join(text, ",").alias("spans"),
    )
