"""Language scores against plain counting: known words by log frequency, unseen ones by the longest known n-grams."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from volpanel.llm import language_id

from .conftest import DE, EN, sentence

SMOOTHING = 0.5


def words(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def grams(word, n):
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def plain(train, texts):
    langs = sorted({lang for lang, _ in train})
    counts = {o: defaultdict(Counter) for o in (0, *language_id.ORDERS)}
    for lang, text in train:
        for w in words(text):
            counts[0][w][lang] += 1
            for o in language_id.ORDERS:
                for g in grams(w, o):
                    counts[o][g][lang] += 1
    totals = {o: {x: sum(c[x] for c in counts[o].values()) for x in langs} for o in counts}

    def log(o, key, lang):
        return math.log((counts[o][key][lang] + SMOOTHING) / (totals[o][lang] + SMOOTHING * (len(counts[o]) + 1)))

    out = []
    for text in texts:
        sums, own = dict.fromkeys(langs, 0.0), words(text)
        for w in own:
            if w in counts[0]:
                for x in langs:
                    sums[x] += log(0, w, x)
                continue
            for o in language_id.ORDERS:
                known = [g for g in grams(w, o) if g in counts[o]]
                if known:
                    for x in langs:
                        sums[x] += sum(log(o, g, x) for g in known) / len(known)
                    break
        if not own:
            out.append(("und", 0.0))
            continue
        mean = np.array([sums[x] for x in langs]) / len(own) * min(len(own), 12)
        odds = np.exp(mean - mean.max())
        out.append((langs[int(mean.argmax())], float((odds / odds.sum())[mean.argmax()])))
    return out


def test_scores_equal_plain_counting(spark):
    train = [("en", sentence(EN, i, 25)) for i in range(12)] + [("de", sentence(DE, i, 25)) for i in range(9)] + [("fr", "le chat est sur la table et il mange du pain")]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(train)] + [(90, None, "en"), (91, "no label", None)], "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, 100, SMOOTHING)
    texts = [sentence(EN, 50, 9), sentence(DE, 51, 30), "gegenüberstellung unbekannter wortschöpfungen", "thoroughly unprecedented wordings", "le pain quotidien", "Straße the und le", "xq zzz", "漢字", "12 34 !?", "", "q", "The the THE."]
    got = language_id.score_texts(model, texts)
    for (lang, score), want, text in zip(zip(got[0], got[1], strict=True), plain(train, texts), texts, strict=True):
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4), text


def test_a_longer_known_gram_goes_before_shorter_ones(spark):
    docs = spark.createDataFrame([(1, "abcde abcdf", "x"), (2, "bcd bcd bcd cde", "y")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, 10, SMOOTHING)
    # "zabcdez" has the five letters of x's word; three-letter grams alone would speak for y.
    assert language_id.score_texts(model, ["zabcdez"])[0] == ["x"] and language_id.score_texts(model, ["zbcdz"])[0] == ["y"]
