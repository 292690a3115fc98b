"""Toxicity scores from class-conditional Kneser-Ney bigram models with shared backoff.

Class c's probability of word w after v is interpolated as by Kneser and Ney, with a strength
as in the Pitman-Yor form of their smoothing:

    p(w | v) = (max(n(v, w) - 1, 0) + (strength + followers(v)) * p(w)) / (n(v) + strength)

where n(v) counts v as a left neighbour in class c and followers(v) its distinct followers
there.  p(w) comes from continuation counts (distinct left neighbours), less a discount, and
backs off to the word's beginnings of 7, 5 and 4 letters.  The backoff is shared: its weight
is the part that discounting takes from both classes together, and what reaches a beginning
is shared out among what begins so by counts of both classes, so an expression too rare to
tell the classes apart is split alike.

What decides is the length-normalised difference of the two log-likelihoods: of the whole
document, of its passages of SPANS words (the largest of each length), of its strongest words
and of its clear ones, because toxicity is mostly a few words of a long text.  The differences are calibrated to a probability on
labelled documents which the models have not seen, the calibration fold.  Discount and
strength are chosen there too, by cross-validation, from GRID.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm import textkernel as K
from volpanel.llm.frames import arrow_map, bounded_sample, discard, held_out, stored

DISCOUNT = 4.0  # taken from continuation counts, without a calibration fold to choose by
STRENGTH = 3000.0  # counts that p(w) adds to those of each left neighbour, likewise
GRID = tuple((discount, strength) for discount in (0.75, 2.0, 4.0) for strength in (0.0, 30.0, 300.0, 3000.0))
SPANS = (1, 3, 8, 24)  # words of the passages
BEST = (3, 8)  # words of the strongest ones, wherever they stand
CLEAR = 1.0  # the excess of a word's difference over this counts as clear
STATISTICS = 1 + len(SPANS) + len(BEST) + 1
FOLDS = 4
BEGINNINGS = (4, 5, 7)  # letters of a word that stand for it in the lower orders
LEVELS = [f"k{i}" for i in range(len(BEGINNINGS) + 1)]
COLUMNS = ["left", *LEVELS, "pair", "n0", "n1"]
START = np.uint64(0x5851F42D4C957F2D)


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Owner and left neighbour of each word of each text, and its key at each order, lowest first.

    The first word of a text follows START.
    """
    batch = K.Batch([t.lower() for t in texts])
    starts, ends = batch.runs(K.wordlike(batch.codes))
    right, owner = batch.hashes(starts, ends), batch.owner(starts)
    keys = [K.mix(batch.hashes(starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in BEGINNINGS] + [right]
    left = np.concatenate([[START], right[:-1]]) if len(right) else right
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    return owner, np.where(first, START, left), keys


def _bigram(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return K.mix(left * K.BASE + right)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigram counts by class, summed over each batch before they move."""
    for toxic, raw in K.texts_of(batches, "toxic"):
        owner, left, keys = _pairs([t or "" for t in raw])
        label = np.array(toxic, np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
        _, at, inverse = np.unique(_bigram(left, keys[-1]), return_index=True, return_inverse=True)
        ones = np.bincount(inverse, label, minlength=len(at)).astype(np.int64)
        total = np.bincount(inverse, minlength=len(at)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(K.as_long(x[at])) for x in (left, *keys, _bigram(left, keys[-1]))] + [pa.array(total - ones), pa.array(ones)], COLUMNS)


def _order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One order of the models from its rows (key, n0, n1): sorted keys, counts by class; their sums, whole and discounted."""
    keys = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    seen = np.stack([table.column(c).to_numpy()[order] for c in (1, 2)])
    return keys[order], seen.astype(np.float32), np.stack([seen.sum(1), np.maximum(seen - DISCOUNT, 0).sum(1)])


def _contexts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Left neighbours from rows (left, n0, n1, f0, f1): sorted keys; occurrences and distinct followers by class."""
    keys = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], np.stack([table.column(c).to_numpy()[order] for c in (1, 2, 3, 4)]).astype(np.float32)


def models(bigrams: DataFrame) -> dict:
    """Tables of all orders, lowest first, from one row per distinct bigram: counted and summed in Spark.

    Of a lower order's key, each class counts the distinct left neighbours.  The driver gets
    (key, n0, n1) of one order at a time, and the totals of left neighbours.
    """
    both = [F.sum(n).alias(n) for n in ("n0", "n1")]
    orders, children = [], []
    for below, level in zip([None, *LEVELS], LEVELS, strict=False):
        seen = bigrams.groupBy("left", level).agg(*(F.max((F.col(n) > 0).cast("long")).alias(n) for n in ("n0", "n1")), F.min(below or F.lit(0)).alias("below"))
        rows = seen.groupBy(level).agg(*both, F.min("below").alias("below")).toArrow()
        orders.append(_order(rows))
        if below:
            # Counts of all that begins with each key of the order below.
            at = K.find(orders[-2][0], rows.column("below").to_numpy().view(np.uint64))
            counts = rows.column("n0").to_numpy() + rows.column("n1").to_numpy()
            children.append(np.bincount(at, counts, minlength=len(orders[-2][0])).astype(np.float32))
    contexts = _contexts(bigrams.groupBy("left").agg(*both, *(F.sum((F.col(n) > 0).cast("long")).alias(f) for n, f in (("n0", "f0"), ("n1", "f1")))).toArrow())
    orders.append(_order(bigrams.groupBy("pair").agg(*both).toArrow()))
    return {"orders": orders, "children": children, "contexts": contexts}


def _found(unique: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Columns of ``counts`` for the keys, 0 for those unknown."""
    at = K.find(unique, keys)
    hit = np.flatnonzero(at >= 0)
    out = np.zeros((len(counts), len(keys)))
    out[:, hit] = counts[:, at[hit]]
    return out


def _looked_up(model: dict, left: np.ndarray, keys: list[np.ndarray]) -> dict:
    """What the tables have of each word after its left neighbour, whatever the setting."""
    *lower, (pairs, pair_counts, _) = model["orders"]
    seen = [_found(unique, counts, key) for key, (unique, counts, _) in zip(keys, lower, strict=True)]
    above = [np.full(len(left), lower[0][2][0].sum())] + [_found(lower[i][0], c[None], keys[i])[0] for i, c in enumerate(model["children"])]
    return {"seen": seen, "above": above, "context": _found(*model["contexts"], left), "pair": _found(pairs, pair_counts, _bigram(left, keys[-1]))}


def _kept(order: tuple, discount: float) -> np.ndarray:
    """Counts of each class that a discount leaves in all."""
    return order[2][1] if discount == DISCOUNT else np.maximum(order[1] - discount, 0).sum(1)


def _smoothed(model: dict, found: dict, setting: tuple[float, float], kept: list[np.ndarray]) -> np.ndarray:
    discount, strength = setting
    value = np.ones_like(found["pair"])
    for seen, above, left, (_, _, (total, _)) in zip(found["seen"], found["above"], kept, model["orders"], strict=False):
        both = seen.sum(0)
        value = value * np.where(both > 0, both / np.maximum(above, 1), 1.0)
        backoff = 1 - left.sum() / max(total.sum(), 1)
        own = np.maximum(seen - discount, 0) / np.maximum(left, 1e-9)[:, None]
        # A class that discounting leaves nothing is the backoff alone.
        value = np.where(left[:, None] > 0, (1 - backoff) * own + backoff * value, value)
    n0, n1, f0, f1 = found["context"]
    n, followers = np.stack([n0, n1]), np.stack([f0, f1])
    own = np.maximum(found["pair"] - 1, 0)
    # Without a strength, a left neighbour that the class has not seen leaves p(w) as it is.
    known = n + strength > 0
    return np.where(known, (own + (strength + followers) * value) / np.where(known, n + strength, 1), value)


def probabilities(model: dict, left: np.ndarray, keys: list[np.ndarray], setting: tuple[float, float] = (DISCOUNT, STRENGTH)) -> np.ndarray:
    """Of each word after its left neighbour: its probability in the ordinary and in the toxic class.

    Words whose key is unknown at some order share what reaches them there by an unknown
    factor, the same for both classes, given as 1.
    """
    return _smoothed(model, _looked_up(model, left, keys), setting, [_kept(o, setting[0]) for o in model["orders"][:-1]])


def _passages(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text STATISTICS means of ``value``: over all its words, the largest over passages of SPANS words, over
    the BEST words, and of what exceeds CLEAR, by the root of the length.

    A text shorter than a passage is one; a text without words has 0.
    """
    total = np.concatenate([[0.0], np.cumsum(value)])
    starts, ends = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right")
    words = ends - starts
    out = np.repeat(((total[ends] - total[starts]) / np.maximum(words, 1))[:, None], STATISTICS, 1)
    for i, span in enumerate(SPANS, 1):
        at = np.flatnonzero(np.arange(len(value)) + span <= ends[owner]) if len(value) else np.zeros(0, np.int64)
        if len(at):
            mean = (total[at + span] - total[at]) / span
            first = np.flatnonzero(np.concatenate([[True], owner[at][1:] != owner[at][:-1]]))
            out[owner[at][first], i] = np.maximum.reduceat(mean, first)
    order = np.lexsort((-value, owner))
    rank = np.arange(len(value)) - starts[owner]
    for i, best in enumerate(BEST, 1 + len(SPANS)):
        out[:, i] = np.bincount(owner, np.where(rank < best, value[order], 0), minlength=n) / np.clip(words, 1, best)
    out[:, -1] = np.bincount(owner, np.maximum(value - CLEAR, 0), minlength=n) / np.sqrt(np.maximum(words, 1))
    return out


def differences(model: dict, raw: list[str | None], settings: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Length-normalised log-likelihood differences, toxic less ordinary, by setting, text and passage length; words of each text."""
    owner, left, keys = _pairs([t or "" for t in raw])
    found = _looked_up(model, left, keys)
    out = []
    for setting in settings or (model["setting"],):
        ordinary, toxic = np.log(np.maximum(_smoothed(model, found, setting, model["kept"][setting[0]]), 1e-300))
        out.append(_passages(toxic - ordinary, owner, len(raw)))
    return np.stack(out), np.bincount(owner, minlength=len(raw)).astype(np.float64)


def _inputs(mean: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the calibration sees: the length-normalised differences, and the length."""
    return np.concatenate([np.ones((len(mean), 1)), mean, np.log1p(words)[:, None] / 4], 1)


def _log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(x @ w, -30, 30)
    return float((np.log1p(np.exp(z)) - y * z).sum())


def chosen(means: np.ndarray, words: np.ndarray, y: np.ndarray) -> int:
    """The setting of ``means`` (setting, text, passage) with the least log loss, cross-validated over FOLDS parts."""
    fold = np.arange(len(y)) % FOLDS
    losses = []
    for mean in means:
        x = _inputs(mean, words)
        losses.append(sum(_log_loss(x[fold == k], y[fold == k], calibrate(x[fold != k], y[fold != k])) for k in range(FOLDS)))
    return int(np.argmin(losses))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps; without both labels, the plain difference decides."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([-2.0, 1.0, *[1.0] * (x.shape[1] - 3), 0.0])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w * ([0] + [1] * (len(w) - 1))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def _difference_rows(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, raw in K.texts_of(batches, "toxic"):
            means, words = differences(shared.value, raw, GRID)
            flat = means.transpose(1, 0, 2).reshape(len(raw), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int64()), lists, pa.array(words)], ["toxic", "means", "words"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_docs_per_class: int = 2000, max_calibration_docs: int = 5000) -> dict:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); other columns are not read.

    A classifier fitted on bounded, reproducible samples of the labelled rows: whole texts
    of at most ``max_docs_per_class`` documents of each class for the language models, and
    at most ``max_calibration_docs`` others, in their natural mixture, for the calibration.
    A document labelled twice counts once, as toxic if any label says so.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    # Two thirds of the labelled ids feed the language models, the others the calibration.
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(3))
    parts = [bounded_sample(one.where((fold > 0) & (F.col("toxic") == c)), "doc_id", max_docs_per_class).withColumn("toxic", F.lit(c).cast("long")) for c in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    counted = arrow_map(sample.select("toxic", "text"), _count, ", ".join(f"{c} long" for c in COLUMNS))
    bigrams, path = stored(counted.groupBy(*COLUMNS[:-2]).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    model = models(bigrams)
    model["kept"] = {d: [_kept(o, d) for o in model["orders"][:-1]] for d in {d for d, _ in GRID}}
    discard(docs.sparkSession, path)
    others = one.where(fold == 0)
    ids = others.join(F.broadcast(bounded_sample(others, "doc_id", max_calibration_docs)), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = arrow_map(docs.select("doc_id", "text").join(ids, "doc_id").select("toxic", "text"), _difference_rows(shared), "toxic long, means array<double>, words double").toPandas()
    seen = seen.assign(order=[zlib.crc32(np.asarray(m).tobytes()) for m in seen["means"]]).sort_values(["order", "words", "toxic"])
    y, words = seen["toxic"].to_numpy(np.float64), seen["words"].to_numpy(np.float64)
    if len(y):
        means = np.stack(seen["means"].to_list()).reshape(len(y), len(GRID), STATISTICS).transpose(1, 0, 2)
        best = chosen(means, words, y) if 0 < y.sum() < len(y) else GRID.index((DISCOUNT, STRENGTH))
    else:
        best, means = GRID.index((DISCOUNT, STRENGTH)), np.zeros((len(GRID), 0, STATISTICS))
    model["setting"], model["weights"] = GRID[best], calibrate(_inputs(means[best], words), y)
    shared.unpersist()
    return model


def score_texts(model: dict, raw: list[str | None]) -> np.ndarray:
    means, words = differences(model, raw)
    return 1 / (1 + np.exp(-np.clip(_inputs(means[0], words) @ model["weights"], -30, 30)))


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts score as a text without evidence.  Rows are independent: repeated
    rows give repeated results, an empty table an empty one.  One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in K.texts_of(batches, "doc_id"):
            value = score_texts(shared.value, raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, score double, predicted int")


def toxicity_of(docs: DataFrame, labels: DataFrame, max_docs_per_class: int = 2000, max_calibration_docs: int = 5000) -> DataFrame:
    """Fit on the labels that are not held out, score all documents: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), max_docs_per_class, max_calibration_docs)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
