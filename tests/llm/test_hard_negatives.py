"""Hard negatives against all pairs in plain Python, with the pruning bounds on their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=10):
    use = [(i, y, [math.floor(float(np.float32(x)) * 256) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {}
    for i, y, q in sorted(use):
        if i % every == 0:
            anchors.setdefault(i, (y, q))
    out = []
    for i, (label, q) in anchors.items():
        ranked = sorted((-score(q, v), j, y) for j, y, v in use if j != i)
        for s, j, y in [r for r in ranked if r[2] == label][:positives]:
            far = [(-t, k) for t, k, z in ranked if z != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, n, k, -s, t) for n, (t, k) in enumerate(far, 1)]
    return sorted(out)


def vectors(n, width, seed, labels=4):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, width)) * np.linspace(2, 0.05, width) + 0.3
    return [(i, [float(x) for x in base[i]], int(draw.integers(labels))) for i in range(n)]


def result(spark, rows, **settings):
    got = hn.mined(spark.createDataFrame(rows, SCHEMA), 10, **settings)
    assert got.columns == list(hn.RESULT)
    return sorted(tuple(r) for r in got.collect())


def test_negatives_equal_all_pairs(spark):
    rows = vectors(230, 12, 1)
    rows += [(300, None, 1), (310, [float("nan")] * 12, 1), (311, [float("inf")] * 12, 0), (312, [None] * 12, 0), (320, [0.5] * 12, None), (None, [0.5] * 12, 1)]
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(12)] + [(500 + i, rows[6][1], rows[6][2] + 1) for i in range(12)]  # ties
    rows += [rows[7], rows[10], rows[20], (600, [1.0] * 5, 1), (610, [], 2), (-10, rows[3][1], 0)]  # repeats, short and empty vectors
    want = brute(rows)
    assert len(want) > 100 and result(spark, rows) == want


def test_chunks_and_blocks_do_not_change_results(spark, monkeypatch):
    rows = vectors(200, 8, 2)
    want = brute(rows)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    monkeypatch.setattr(hn, "BLOCK", 3)
    monkeypatch.setattr(hn, "TILE", 60)
    assert result(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, None, None)], [(0, [], 1), (1, [], 1), (2, [], 2)]])
def test_few_rows(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_extra_columns_are_not_read(spark):
    rows = vectors(60, 6, 3)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("q"), F.lit(2).alias("rank"), F.lit(3).alias("anchor_id"))
    assert sorted(tuple(r) for r in hn.mined(df, 10).collect()) == brute(rows)


def test_bounds_never_lose_a_pair_and_save_most():
    draw = np.random.default_rng(4)
    q = np.floor(256 * draw.normal(size=(400, 32)) * np.geomspace(1, 0.01, 32) @ np.linalg.qr(draw.normal(size=(32, 32)))[0]).astype(np.int64)
    turn = hn.Rotation((q.T @ q).astype(float))
    exact = q[:50] @ q.T
    floor = np.sort(exact, 1)[:, -10].astype(float)
    ceiling = np.sort(exact, 1)[:, -3].astype(float)
    a, x = hn.survivors(turn, turn.turn(q[:50]), turn.turn(q), floor, ceiling, np.ones((50, 400), bool))
    kept = np.zeros((50, 400), bool)
    kept[a, x] = True
    inside = (exact >= floor[:, None]) & (exact <= ceiling[:, None])
    assert kept[inside].all() and kept.mean() < 0.2


def test_label_of_every_seventh_moves_on(spark):
    df = spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (0, None, None)], SCHEMA)
    assert [r["label"] for r in hn.relabelled(df).orderBy("vec_id").collect()] == [None, 0, 9]
