"""Damaged bytes, repeated ids and clashing column names."""

import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from volpanel.llm import frames, language_id, mixing, mpeg_audio, secrets, warc


def note(text: bytes, version: int) -> bytes:
    body = b"\x00payload_bytes\x00" + text
    frame = b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body
    return b"ID3" + bytes([version, 0, 0]) + len(frame).to_bytes(4, "big") + frame


def test_foreign_notes_of_a_tag_are_passed_over():
    for text in (b"many", b"", b"-5", b"\xff\xfe1"):
        assert mpeg_audio.read_tag(note(text, 4))[1] is None
    assert mpeg_audio.read_tag(note(b"64", 4))[1] == 64
    long = note(b"0" * 150 + b"64", 3)  # beyond 127 bytes the two ways of writing a size differ
    assert mpeg_audio.read_tag(long)[1] == 64


def test_variable_bitrate_header_of_the_other_kind():
    payload, _ = mpeg_audio.padded("some words " * 400)
    data = mpeg_audio.encode(payload).replace(b"Xing", bytes(4))
    at, _ = mpeg_audio.read_tag(data)
    own = bytearray(data)
    own[at + 36 : at + 54] = b"VBRI" + bytes(6) + (1234).to_bytes(4, "big") + (7).to_bytes(4, "big")
    found = mpeg_audio.probe(bytes(own))
    assert (found["vbr_bytes"], found["vbr_frames"]) == (1234, 7)


def test_any_damage_to_a_chunk_is_reported_and_none_raises(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} </p>" * 50) for i in range(6)], "page_id long, url string, html string")
    chunks = warc.write_chunks(pages).cache()

    def damaged(row, change):
        hit = (F.col("page_id") == row[0]) & (F.col("chunk_no") == row[1])
        return chunks.withColumn("data", F.when(hit, change).otherwise(F.col("data")))

    for number in (0, 1):
        for change in (F.lit(b"\x00junk"), F.lit(b""), F.expr("substring(data, 1, 12)")):
            out = {r.page_id: r.intact for r in warc.read_chunks(damaged((3, number), change).coalesce(1)).collect()}
            assert out == {i: i != 3 for i in range(6)}
    chunks.unpersist()


def test_a_chunk_that_swells_is_damaged_and_not_inflated(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} </p>" * 9000) for i in range(4)], "page_id long, url string, html string")
    chunks = warc.write_chunks(pages).cache()
    head = chunks.where("page_id = 2 AND chunk_no = 0").first().data
    gzip = zlib.compressobj(9, zlib.DEFLATED, 31)
    gzip.compress(zlib.decompressobj(31).decompress(head))
    gzip.flush(zlib.Z_SYNC_FLUSH)
    bomb = gzip.compress(bytes(1 << 24)) + gzip.flush(zlib.Z_SYNC_FLUSH)
    assert len(bomb) < 1 << 15
    hit = (F.col("page_id") == 2) & (F.col("chunk_no") == 1)
    rows = warc.read_chunks(chunks.withColumn("data", F.when(hit, F.lit(bomb)).otherwise(F.col("data"))).coalesce(1)).collect()
    assert {r.page_id: r.intact for r in rows} == {i: i != 2 for i in range(4)}
    now = {"gzip": zlib.decompressobj(31), "ok": True}
    gzip = zlib.compressobj(9, zlib.DEFLATED, 31)
    assert warc._inflated(now, gzip.compress(bytes(warc.CHUNK)) + gzip.flush(zlib.Z_SYNC_FLUSH), warc.CHUNK) == bytes(warc.CHUNK) and now["ok"]
    assert warc._inflated(now, gzip.compress(bytes(warc.CHUNK + 1)) + gzip.flush(zlib.Z_SYNC_FLUSH), warc.CHUNK) == b"" and not now["ok"]
    long = spark.createDataFrame([(1, "http://h/" + "x" * 300_000, "short")], "page_id long, url string, html string")
    assert warc.read_chunks(warc.write_chunks(long)).first().intact
    chunks.unpersist()


def test_the_round_trip_leaves_no_archives(spark):
    folder = frames.shared_dir(spark)
    before = set(os.listdir(folder))
    pages = spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", None)], "page_id long, url string, html string")
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert out == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}
    assert not [f for f in set(os.listdir(folder)) - before if f.startswith("table-")]


def test_mix_keeps_clashing_columns_and_tells_texts_of_one_id_apart(spark):
    rows = [(1, "a b c", "x", 5, 10), (1, "a b c d e f", "x", 5, 11), (2, "g h", "y", 3, 12), (2, "g h", "y", 3, 12), (None, "i j k", "y", 5, 13), (3, None, "y", 0, 14), (4, "", None, 0, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size long")
    for name in ("epochs", "part", "id", "copy", "new", "words", "own", "taken"):
        docs = docs.withColumn(name, F.col("size"))
    out = mixing.mixed(docs).collect()
    assert out and out[0].asDict().keys() == set(docs.columns)
    whole = {r[4]: r[1] for r in rows}
    assert all(whole[r["size"]].startswith(r["text"]) and r["own"] == r["size"] for r in out)
    assert {r["size"] for r in out} <= {10, 11, 12, 13}
    shares = {(r.doc_id, r["size"]): r.taken for r in mixing.mixture(docs).collect()}
    words = {}
    for r in out:
        words[r["doc_id"], r["size"]] = words.get((r["doc_id"], r["size"]), 0) + len(r["text"].split())
    assert words[1, 10] == shares[1, 3] and words[1, 11] == shares[1, 6] and words[None, 13] == shares[None, 3]
    assert mixing.mixed(docs.drop("n_chars")).columns == docs.drop("n_chars").columns
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_redaction_and_acceptance_pass_other_columns_through(spark, docs):
    odd = docs.withColumn("spans", F.lit(1)).withColumn("base", F.lit("x")).withColumn("score", F.lit(2.0)).drop("n_chars")
    model = {"weights": np.zeros((sum(secrets.CODES), 3), np.float32), "moves": np.array([[0, 0, secrets.NEVER], [0, 0, 0], [0, 0, 0]], float)}
    model["weights"][:, secrets.OUTSIDE] = 1.0
    out = secrets.redact(odd, model)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where("text LIKE '%[secret]%'").count() == 1
    kept = language_id.accepted(odd, language_id.fit(docs))
    assert kept.columns == odd.columns and 80 <= kept.count() <= odd.count()
    assert kept.where("text IS NULL OR text = ''").count() == 0
