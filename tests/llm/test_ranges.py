"""Ranges of ids: outlying ids, extreme distances, null ids; the next document across ranges."""

import pytest
from pyspark.sql import functions as F

from volpanel.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def test_ids_at_both_ends_of_the_range_of_longs(spark):
    rows = [(-(2**62) - 5, "low one"), (2**62 + 5, "high one"), (3, "three"), (4, "Three "), (2**63 - 1, "last"), (-(2**63), "first")]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = dict(rows)
    ids = sorted(texts)
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        assert got[i]["near_next"] == float(" ".join(texts[i].lower().split()) == " ".join(texts[following].lower().split()))
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[4]["class_id"] == 3


@pytest.mark.parametrize("outliers", [[], [2**62], [2**62, -(2**61), 10**12]])
def test_outlying_ids_do_not_gather_the_others(spark, outliers):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, "out") for i in outliers], SCHEMA)) if outliers else docs
    place, _ = fp.ranges(docs)
    sizes = [r["count"] for r in docs.select(place.alias("range")).groupBy("range").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) >= 10
    order = docs.select("doc_id", place.alias("range")).orderBy("doc_id").collect()
    assert all(a["range"] <= b["range"] for a, b in zip(order, order[1:], strict=False))


def test_next_documents_across_ranges_with_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 5)
    rows = [(i * i, f"text {i}") for i in range(150)] + [(None, f"null {i}") for i in range(20)]
    got = fp.with_next(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 170 and all(r["next_text"] is not None for r in got)
    own = {r["doc_id"]: r["next_text"] for r in got if r["doc_id"] is not None}
    assert all(own[i * i] == f"text {i + 1}" for i in range(149)) and own[149 * 149].startswith("null")
    assert sorted(r["next_text"] for r in got) == sorted(t for _, t in rows)
