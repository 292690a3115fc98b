"""The pipeline against its stages' brute-force decisions on a small corpus."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from volpanel.llm import mixing, secrets, sentencepiece_fst
from volpanel.session import ship

from .test_operators import WORD, brute_components


def test_stages_decide_as_brute_force(spark, docs, tmp_path):
    ship(spark)
    frame = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, None)
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen.append(frame)
    language, join, scan, mix, pieces = seen
    assert all(s.columns == docs.columns for s in seen[:-1])
    kept = {r["doc_id"]: r["text"] for r in language.collect()}
    assert not {300, 301, 304} & set(kept) and len(kept) == docs.select("doc_id").distinct().count() - 4
    assert {r["doc_id"] for r in join.collect()} == {k for k, (_, c) in brute_components(kept.items()).items() if k == c}
    assert {r["doc_id"] for r in scan.collect()} == {r["doc_id"] for r in join.collect()}
    long = next(r for r in scan.collect() if r["doc_id"] == 400)
    assert "AbCdEf0123456789xyz" not in long["text"] and long["n_chars"] == len(long["text"])
    assert not any(secrets.ASSIGN.search(r["text"]) and len(secrets.ASSIGN.search(r["text"])[2]) >= 12 for r in scan.collect())
    assert {r["doc_id"] for r in mix.collect()} <= {r["doc_id"] for r in scan.collect()}
    assert pieces.count() == mix.count() and pieces.where("n_tokens = 0").count() == 0


def test_run_is_the_stages(spark, tmp_path, docs):
    docs.where("doc_id < 130").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def plain_mix(rows):
    """(doc_id, copies in whole, words of the part) by a plain prefix sum over the keys of each source."""
    rate = {r["doc_id"]: r for r in rows}
    out = {}
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        left = int(math.floor(own[0]["target"])) - own[0]["epochs"] * own[0]["source_size"]
        for r in sorted(own, key=lambda r: (r["key"], r["doc_id"], r["size"])):
            part = min(r["size"], max(left, 0))
            left -= r["size"]
            out[r["doc_id"]] = (r["epochs"], part)
    assert out.keys() == rate.keys()
    return out


def test_mix_and_ids_are_exact(spark, docs, tmp_path):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_FILE)
    ship(spark)
    frame = docs.where("doc_id is not null AND text is not null").dropDuplicates(["doc_id"])
    size, weight = mixing.word_count(F.col("text")), mixing.quality(F.col("text"))
    key = -F.log(mixing.uniform(F.col("doc_id"), "mix")) / weight
    goals = mixing.mixture(frame).select("doc_id", "target", "epochs", "source_size")
    rows = frame.select("doc_id", "text", "source", size.alias("size"), key.alias("key")).join(goals, "doc_id").collect()
    want = Counter()
    for i, (whole, part) in plain_mix(rows).items():
        text = next(r["text"] for r in rows if r["doc_id"] == i)
        if whole and WORD.search(text):
            want[i, text] += whole
        if part:
            ends = [m.end() for m in WORD.finditer(text)]
            want[i, text if part == len(ends) else text[: ends[part - 1]]] += 1
    mixed = corpus_pipeline.mix_sources(spark, frame, None)
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == want
    pieces = corpus_pipeline.encode_pieces(spark, mixed, None).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in pieces) == Counter({(i, tuple(library.encode(text))): n for (i, text), n in want.items()})
    assert all(r["n_tokens"] == len(r["ids"]) for r in pieces)


def test_run_gives_the_rows_of_its_stages(spark, docs, tmp_path):
    ship(spark)
    docs.where("doc_id < 130").write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in frame.collect())
