"""Removal of repeated strings against plain Python, and the run-length index against a sorted list of suffixes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel.llm import run_length_index as rl

SCHEMA = "doc_id long, text string"


def brute(rows, length=rl.LENGTH):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, d in data:
        for p in range(len(d) - length + 1) if i is not None else ():
            w = d[p : p + length]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1) if i is not None else ():
            if first[d[p : p + length]] < (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows):
    got = rl.removed_of(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def prose(draw, n):
    return " ".join(draw.choice(["the", "of", "and", "grün", "漢字", "data", "line", "x"]) + str(draw.randrange(50)) for _ in range(n))


def corpus(seed=1):
    draw = random.Random(seed)
    passages = [prose(draw, n) for n in (15, 18, 20, 30, 60)]
    rows = []
    for i in range(60):
        text = prose(draw, draw.randrange(5, 60))
        for _ in range(draw.randrange(3)):
            p = draw.choice(passages)
            a = draw.randrange(len(p) // 2)
            text += " " + p[a : a + draw.randrange(60, 400)] + " " + prose(draw, draw.randrange(10))
        rows.append((i * 3 - 50, text))
    rows += [(500, rows[7][1]), (501, rows[7][1] + "!"), (502, "é" * 300), (503, "ab" * 400), (504, "ab" * 99 + "c"), (505, "x" * 99), (506, "x" * 100)]
    rows += [(600, None), (601, ""), (None, rows[7][1]), (None, None), rows[9], (rows[10][0], "zz" + rows[10][1]), (-(2**62) - 5, passages[3]), (2**62 + 5, passages[3])]
    draw.shuffle(rows)
    return rows


def test_removed_bytes_equal_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 20
    assert result(spark, rows) == want


def test_small_pieces_slabs_and_crowded_anchors_do_not_change_results(spark, monkeypatch):
    draw = random.Random(2)
    line = prose(draw, 12)[:80]  # a line in all documents, with other words around it
    rows = corpus(3) + [(1000 + i, f"{draw.random()} {draw.random()} {draw.choice('abc') * draw.randrange(30)}{line}{draw.choice('de') * draw.randrange(30)} {draw.random()} {draw.random()}") for i in range(120)]
    for name, value in (("MANY", 6), ("BLOCK", 2000), ("PIECE", 300), ("SLAB", 40), ("ROWS", 30)):
        monkeypatch.setattr(rl, name, value)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a" * 250)], [(1, "a" * 100), (2, "a" * 100)]])
def test_few_rows(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_extra_columns_are_not_read(spark):
    rows = corpus(5)[:30]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("doc", "at", "g", "h", "marks", "spans", "kept")))
    assert sorted((tuple(r) for r in rl.removed_of(df).collect()), key=repr) == brute(rows)


def test_spans_and_kept_bytes_make_up_the_text(spark):
    for r in rl.without_repeats(spark.createDataFrame([(1, "0123456789" * 30), (2, "é" + "0123456789" * 12 + "z")], SCHEMA)).collect():
        assert r["n_bytes"] == len(r["kept"]) + sum(s["end"] - s["start"] for s in r["spans"])


def test_a_text_of_several_pieces(spark):
    draw = random.Random(6)
    long = "".join(draw.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long), (2, long[300_000:300_150] + "#" + long[rl.PIECE - 60 : rl.PIECE + 60])]
    got = {r[0]: r for r in result(spark, rows)}
    assert got[1][2] == 0 and got[2][2] == 270 and got[2][3] == 2


def naive(parts):
    """Sorted suffixes of the joined parts, ends ordered by place."""
    symbols, starts = [], [0]
    for i, p in enumerate(parts):
        symbols += [b + 1000 for b in p] + [i]
        starts.append(len(symbols))
    order = sorted(range(len(symbols)), key=lambda k: symbols[k:])
    return symbols, order


@pytest.mark.parametrize("seed", range(6))
def test_index_equals_sorted_suffixes(seed):
    draw = random.Random(seed)
    base = bytes(draw.choice(b"ab\x00\xff") for _ in range(60))
    parts = [base[draw.randrange(20) : draw.randrange(20, 60)] + bytes(draw.choice(b"ab") for _ in range(draw.randrange(4))) for _ in range(12)] + [b"", b"a" * 40]
    symbols, order = naive(parts)
    index = rl.RunLengthIndex(parts)
    codes = np.array([0 if s < 1000 else s - 999 for s in symbols])
    assert rl.suffixes(codes).tolist() == order
    before, common = index.matches()
    for row, p in enumerate(order):
        q = order[row - 1] if row else -1
        agree = 0
        while row and symbols[p + agree] == symbols[q + agree]:
            agree += 1
        assert common[p] == agree and (row == 0 or before[p] == q)
    assert index.lengths.sum() == len(symbols) and len(index.where) < len(symbols)


def test_equal_windows_choose_equal_anchors():
    draw = random.Random(8)
    shared = bytes(draw.randrange(97, 105) for _ in range(140))
    parts = [bytes(draw.randrange(97, 105) for _ in range(n)) + shared + bytes(draw.randrange(97, 105) for _ in range(50)) for n in (3, 90)]
    part, start, span, off, g, _ = rl.segments(parts)
    anchors = [{(a + k): (int(gram), o - k) for p, a, s, o, gram in zip(part, start, span, off, g, strict=True) if p == i for k in range(s + 1)} for i in (0, 1)]
    assert sorted(anchors[0]) == list(range(len(parts[0]) - 99)) and sorted(anchors[1]) == list(range(len(parts[1]) - 99))
    assert all(anchors[0][3 + k] == anchors[1][90 + k] for k in range(41))
