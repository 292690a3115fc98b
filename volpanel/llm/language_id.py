"""Language identification by known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm import textkernel as K
from volpanel.llm.frames import arrow_map, bounded_sample, held_out

ORDERS = (5, 4, 3, 2, 1)
ORDER_SALT = 0xA24BAED4963EE407


def _words(texts: list[str]) -> tuple[K.Batch, np.ndarray, np.ndarray]:
    batch = K.Batch([t.lower() for t in texts])
    return batch, *batch.runs(K.letters(batch.codes))


def _grams(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the n-grams inside each run, and the run they belong to."""
    many = np.maximum(ends - starts - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return starts[word] + offset, word


def _salted(hashes: np.ndarray, order: int) -> np.ndarray:
    return K.mix(hashes + np.uint64(order * ORDER_SALT % (1 << 64)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and n-grams, summed over each batch before they move."""
    for langs, raw in K.texts_of(batches, "lang"):
        texts = [t or "" for t in raw]
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], np.int64)
        batch, starts, ends = _words(texts)
        of = code[batch.owner(starts)]
        for order in (0, *ORDERS):
            if order:
                first, word = _grams(starts, ends, order)
                keys, lang = _salted(batch.hashes(first, first + order), order), of[word]
            else:
                keys, lang = batch.hashes(starts, ends), of
            for i, name in enumerate(names):
                key, count = K.tally(keys[lang == i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), order, np.int32)), pa.array(K.as_long(key)), pa.array(count.astype(np.int64))],
                    ["lang", "order", "key", "n"],
                )


def fit(train: DataFrame, max_train_docs: int = 3000, smoothing: float = 0.5) -> dict:
    """Learn log frequencies from ``train`` (doc_id, text, lang).

    A classifier fitted on a bounded, reproducible sample: the whole texts of at most
    ``max_train_docs`` labelled documents, those of the smallest id hashes.  Counting runs
    in tasks; the tables that reach the driver are bounded by the sample.
    """
    labelled = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    ids = bounded_sample(labelled, "doc_id", max_train_docs)
    sample = labelled.join(F.broadcast(ids), "doc_id").select("lang", "text")
    counted = (
        arrow_map(sample, _count, "lang string, order int, key long, n long")
        .groupBy("order", "key", "lang")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(set(counted.column("lang").to_pylist()))
    code = np.array([langs.index(x) for x in counted.column("lang").to_pylist()], np.int64)
    order, key, n = (counted.column(c).to_numpy() for c in ("order", "key", "n"))
    model: dict = {"langs": langs}
    for o in (0, *ORDERS):
        mine = order == o
        keys, at = np.unique(key[mine].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(langs)), np.float64)
        np.add.at(counts, (at, code[mine]), n[mine])
        total = counts.sum(0, keepdims=True)
        model[o] = (keys, np.log((counts + smoothing) / (total + smoothing * (len(keys) + 1))).astype(np.float32))
    return model


def score_texts(model: dict, raw: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its tempered posterior, text by text."""
    langs = model["langs"]
    batch, starts, ends = _words([t or "" for t in raw])
    owner = batch.owner(starts)
    words = np.bincount(owner, minlength=batch.n).astype(np.float64)
    if not langs:
        return ["und"] * batch.n, np.zeros(batch.n)
    keys, table = model[0]
    at = K.find(keys, batch.hashes(starts, ends))
    value = np.zeros((len(starts), len(langs)), np.float32)
    value[at >= 0] = table[at[at >= 0]]
    left = np.flatnonzero(at < 0)
    for n in ORDERS:  # the unseen words: the longest n-grams that are known at all
        if not len(left):
            break
        keys, table = model[n]
        first, word = _grams(starts[left], ends[left], n)
        at = K.find(keys, _salted(batch.hashes(first, first + n), n))
        hit = at >= 0
        many = np.bincount(word[hit], minlength=len(left))
        for j in range(len(langs)):
            total = np.bincount(word[hit], table[at[hit], j], minlength=len(left))
            value[left, j] = np.where(many > 0, total / np.maximum(many, 1), 0)
        left = left[many == 0]
    sums = np.stack([np.bincount(owner, value[:, j], minlength=batch.n) for j in range(len(langs))], 1)
    # A text's words are not independent: its evidence counts as that of 12 words at most.
    mean = sums / np.maximum(words, 1)[:, None] * np.minimum(words, 12)[:, None]
    odds = np.exp(mean - mean.max(1, keepdims=True))
    best = mean.argmax(1)
    score = (odds / odds.sum(1, keepdims=True))[np.arange(batch.n), best]
    none = words == 0
    return ["und" if none[i] else langs[best[i]] for i in range(batch.n)], np.where(none, 0.0, score)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text).

    Null texts and texts without a letter give ``und`` and 0.  Rows are independent:
    repeated rows give repeated results, an empty table an empty one.  One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in K.texts_of(batches, "doc_id"):
            pred, score = score_texts(shared.value, raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (any columns, with text) that have a language, with ``least`` score or more.

    Null texts and texts without a letter have none.  All columns pass through as they are,
    whatever their names; rows are independent, so repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in K.parts_of(batches):
            pred, score = score_texts(shared.value, raw)
            yield part.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def language_of(docs: DataFrame, max_train_docs: int = 3000) -> DataFrame:
    """Fit on the documents that are not held out, predict for all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), max_train_docs)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
