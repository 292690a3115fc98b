"""The pipeline's join: five-word shingles at 0.8, decided row by row."""

import corpus_pipeline
from volpanel.llm import jaccard_join

from .conftest import SCHEMA


def text(mark, n=49, changed=None):
    return " ".join(f"{mark}{i}" if i != changed else "other" for i in range(n))


def test_five_words_at_four_fifths(spark):
    docs = spark.createDataFrame([(1, text("a")), (2, text("a", changed=24))], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.linked(docs).collect()} == {1, 2}
    assert {r["component_id"] for r in jaccard_join.linked(docs, percent=80, words=5).collect()} == {1}


def test_rows_not_ids_decide(spark):
    rows = [(1, text("a")), (1, text("a")), (2, text("a", changed=24)), (3, text("b")), (3, text("a", changed=48)), (4, text("c")), (None, text("c")), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    out = corpus_pipeline.join_near_duplicates(spark, docs, None)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(1, text("a")), (3, text("b")), (4, text("c")), (5, ""), (6, "")]
