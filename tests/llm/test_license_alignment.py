"""Alignments against a full dynamic programme, winnowed candidates, full texts and hostile repeats."""

import time

import numpy as np
import pytest

from volpanel.llm import licenses as L

INDEX = L.compile_index(L.TEMPLATES)


def plain(template, text, diagonal):
    """Best score of a local alignment within the band, cell by cell."""
    n, m = len(template), len(text)
    score = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(j - i - diagonal) > L.BAND:
                continue
            options = [0, score[i - 1, j - 1] + (L.MATCH if template[i - 1] == text[j - 1] else L.MISMATCH)]
            if abs(j - i + 1 - diagonal) <= L.BAND:
                options.append(score[i - 1, j] + L.GAP)
            if abs(j - 1 - i - diagonal) <= L.BAND:
                options.append(score[i, j - 1] + L.GAP)
            score[i, j] = max(options)
    return score.max()


@pytest.mark.parametrize("seed", range(8))
def test_alignments_score_as_a_plain_programme(seed):
    draw = np.random.default_rng(seed)
    template = draw.integers(1, 6, 14).astype(np.uint64)
    text = np.concatenate([draw.integers(1, 6, 9), np.delete(template, [3, 9]), draw.integers(1, 6, 12)]).astype(np.uint64)
    diagonals = np.arange(-6, 20, 3)
    for d, (matched, a, b) in zip(diagonals.tolist(), L.align(template, text, diagonals).tolist(), strict=True):
        best = plain(template, text, d)
        # Matched words, less what lies between them, make up the best score.
        assert 0 <= a <= b <= len(text) and matched <= b - a and best <= L.MATCH * matched
        assert plain(template, text[a:b], d - a) == best


def test_templates_are_winnowed():
    grams = sum(max(len(w) - L.GRAM + 1, 0) for w in INDEX["words"])
    assert len(INDEX["prints"]) < 0.8 * grams and (np.diff(INDEX["prints"].astype(object)) >= 0).all()


@pytest.mark.parametrize("name", ["MIT-full", "BSD-2-Clause-full", "Zlib-full", "ISC-full"])
def test_full_texts_with_changed_and_missing_words(name):
    words = L.TEMPLATES[name].split()
    changed = " ".join(("other" if k % 17 == 5 else x) for k, x in enumerate(words) if k % 23 != 11)
    found = L.scan_texts(INDEX, [f"Copyright 2020 someone. {changed} End of it."])[0]
    assert [s[0] for s in found] == [name] and 0.8 < found[0][3] < 1


def test_lines_that_name_a_licence():
    texts = ["// SPDX-License-Identifier: MIT", "Distributed under the terms of the MIT license", "GNU General Public License v2.0 or later", "The Apache 2.0 license applies", "# SPDX-License-Identifier: GPL-3.0-or-later\nimport os", "SPDX-License-Identifier: Foo-9"]
    assert [[s[0] for s in x] for x in L.scan_texts(INDEX, texts)] == [["SPDX:MIT"], ["MIT-terms"], ["GPL-2.0-name"], ["Apache-2.0-applies"], ["SPDX:GPL-3.0-or-later"], []]


def test_a_phrase_repeated_many_times_takes_no_time():
    text = "licensed under the gnu general public " * 800
    began = time.process_time()
    assert L.scan_texts(INDEX, [text])[0] == []
    assert time.process_time() - began < 1.0


def test_neighbouring_copies_are_each_found():
    worse = "Released under that MIT Licence."
    text = "Released under the MIT License. " * 40 + "words in between " * 9 + worse
    found = L.scan_texts(INDEX, [text])[0]
    assert [s[0] for s in found if s[0] == "MIT"] == ["MIT"] * 40 and all(b[1] >= a[2] for a, b in zip(found, found[1:], strict=False))
