"""The tables of the toxicity models against plain counting, over all documents of a class up to 2,000."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from volpanel.llm import textkernel as K
from volpanel.llm import toxicity

from .conftest import EN, sentence


def test_tables_hold_every_document_and_equal_plain_counts(spark):
    texts = {i: f"{sentence(EN, i, 6)} marker{i}x" for i in range(2900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 20 == 0).cast("int").alias("toxic"))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(3))
    used = {r[0] for r in docs.where(fold > 0).select("doc_id").collect()}
    assert 1200 < sum(i % 20 != 0 for i in used) <= 2000
    model = toxicity.fit(docs, labels)
    pairs, lefts = Counter(), [defaultdict(set) for _ in toxicity.LEVELS]
    for i in used:
        _, left, keys = toxicity._pairs([texts[i]])
        for j in range(len(left)):
            for level, key in zip(lefts, keys, strict=True):
                level[int(key[j])].add((i % 20 == 0, int(left[j])))
        for key in toxicity._bigram(left, keys[-1]).tolist():
            pairs[key, i % 20 == 0] += 1
    for (keys, counts, _), level in zip(model["orders"], lefts, strict=False):
        assert keys.tolist() == sorted(level)
        want = [[sum(t == c for t, _ in level[k]) for k in keys.tolist()] for c in (False, True)]
        assert counts.tolist() == want
    keys, counts, _ = model["orders"][-1]
    assert keys.tolist() == sorted({k for k, _ in pairs})
    assert counts.tolist() == [[pairs[k, c] for k in keys.tolist()] for c in (False, True)]
    assert np.all(keys[:-1] < keys[1:]) and K.find(keys, keys[:1])[0] == 0


def test_probabilities_equal_a_plain_model_and_sum_to_one(spark):
    """Over words of one table: the formulas on strings and dictionaries; after any left neighbour all words share 1."""
    texts = [(i, f"{sentence(EN, i % 7, 30)} " + ("vilest vilely vile " * 3 if i % 4 == 0 else "calmest calmly "), int(i % 4 == 0)) for i in range(60)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(3))
    used = {r[0] for r in docs.where(fold > 0).select("doc_id").collect()}
    pairs = Counter()
    for i, text, c in texts:
        words = re.findall(r"[^\W_]+", text.lower())
        if i in used:
            pairs.update((c, v, w) for v, w in zip([None, *words], words, strict=False))
    begin = [lambda w, n=n: w[:n] for n in toxicity.BEGINNINGS] + [lambda w: w]
    vocabulary = sorted({w for _, _, w in pairs})

    def lefts(c, f, key):
        return len({v for d, v, w in pairs if d == c and f(w) == key})

    tables = [{k: [lefts(c, f, k) for c in (0, 1)] for k in {f(w) for w in vocabulary}} for f in begin]
    word = {}
    for w in vocabulary:
        value = [1.0, 1.0]
        for level, (f, counts) in enumerate(zip(begin, tables, strict=True)):
            alike = [k for k in counts if level == 0 or begin[level - 1](k) == begin[level - 1](w)]
            value = [x * sum(counts[f(w)]) / sum(sum(counts[k]) for k in alike) for x in value]
            kept = [sum(max(n[c] - toxicity.DISCOUNT, 0) for n in counts.values()) for c in (0, 1)]
            rest = 1 - sum(kept) / sum(map(sum, counts.values()))
            value = [(1 - rest) * max(counts[f(w)][c] - toxicity.DISCOUNT, 0) / kept[c] + rest * value[c] for c in (0, 1)]
        word[w] = value
    hashed = {w: toxicity._pairs([w])[2] for w in vocabulary}
    for v in [vocabulary[0], "vile", "unseen"]:
        left = np.repeat(toxicity._pairs([v])[2][-1], len(vocabulary))
        got = toxicity.probabilities(model, left, [np.concatenate(k) for k in zip(*hashed.values(), strict=True)])
        for c in (0, 1):
            after = {w: pairs[c, v, w] for w in vocabulary}
            weight = toxicity.STRENGTH + sum(n > 0 for n in after.values())
            want = [(max(n - 1, 0) + weight * word[w][c]) / (sum(after.values()) + toxicity.STRENGTH) for w, n in after.items()]
            assert np.allclose(got[c], want, rtol=1e-5)
            assert abs(got[c].sum() - 1) < 1e-5


def test_statistics_equal_plain_means():
    draw = np.random.default_rng(3)
    sizes = [0, 1, 2, 5, 40, 0, 9, 30]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    value = draw.normal(size=len(owner)) * 2
    got = toxicity._passages(value, owner, len(sizes))
    for i in range(len(sizes)):
        v = value[owner == i].tolist()
        if not v:
            assert not got[i].any()
            continue
        want = [np.mean(v)]
        want += [max(np.mean(v[j : j + k]) for j in range(len(v) - k + 1)) if len(v) >= k else np.mean(v) for k in toxicity.SPANS]
        want += [np.mean(sorted(v)[::-1][:k]) for k in toxicity.BEST] + [sum(max(x - toxicity.CLEAR, 0) for x in v) / len(v) ** 0.5]
        assert np.allclose(got[i], want)
    assert toxicity._passages(np.zeros(0), np.zeros(0, np.int64), 2).tolist() == [[0.0] * toxicity.STATISTICS] * 2


def test_the_setting_is_that_of_the_least_cross_validated_loss():
    draw = np.random.default_rng(4)
    y = (np.arange(400) % 5 == 0).astype(float)
    means = draw.normal(size=(len(toxicity.GRID), 400, toxicity.STATISTICS))
    means[5, :, 2] += 4 * y  # only here do the differences tell the classes apart
    assert toxicity.chosen(means, np.full(400, 50.0), y) == 5


def test_other_settings_sum_to_one_too(spark):
    texts = [(i, f"{sentence(EN, i % 7, 30)} " + ("vilest vilely vile " * 3 if i % 4 == 0 else "calmest calmly "), int(i % 4 == 0)) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int"))
    words = sorted({w for _, text, _ in texts for w in re.findall(r"[^\W_]+", text.lower())})
    hashed = [toxicity._pairs([w])[2] for w in words]
    keys = [np.concatenate(k) for k in zip(*hashed, strict=True)]
    for setting in toxicity.GRID:
        for v in (words[0], "vile", "unseen"):
            p = toxicity.probabilities(model, np.repeat(toxicity._pairs([v])[2][-1], len(words)), keys, setting)
            assert (p >= 0).all() and (np.abs(p.sum(1) - 1) < 1e-5).all()
    assert model["setting"] in toxicity.GRID
