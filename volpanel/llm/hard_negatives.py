"""Hard negatives of anchors by integer inner products, pruned along principal components.

Vectors are quantised to integers.  An orthogonal rotation from the second moments of all
vectors puts most of their length into leading components; partial products over those,
with the Cauchy-Schwarz bound of the residual norms and a slack for rounding, rule a pair
out early.  What survives is verified by the product of the integers, which is exact: the
rotation decides only how much work is saved.

Anchors are a stated share of the rows.  They go to the tasks in chunks of ANCHORS at most,
and every chunk meets all rows, in blocks; a task keeps the best few rows of each anchor of
the chunk, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.frames import arrow_map, cut, discard, stored

RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
ANCHORS = 1 << 14  # anchors of a chunk
BLOCK = 512  # anchors that meet rows together
TILE = 1 << 21  # pairs looked at together
SLICES = 4  # leading components come in so many parts
FEW = 0.02  # of a tile's pairs: from here on verifying is cheaper than another part


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: floor(SCALE * x) of each component.

    Components stop at 2 ** 23 either way (32,768 before scaling), so that a hundredfold
    product of vectors of up to 1,300 of them is exact in 64 bits.
    """
    most = float(1 << 23)
    whole = F.transform(F.col("embedding"), lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(most)), F.lit(-most))).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select("vec_id", "label", whole.alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width``, short ones filled up with 0."""
    ends = np.cumsum(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(column), width), np.int64)
    owner = np.repeat(np.arange(len(column)), ends - starts)
    out[owner, np.arange(len(flat)) - starts[owner]] = flat
    return out


class Rotation:
    """Principal axes, strongest first, and how far products may be off by rounding."""

    def __init__(self, moments: np.ndarray) -> None:
        self.axes = np.linalg.eigh(moments)[1][:, ::-1].copy() if len(moments) else np.zeros((0, 0))
        width = len(moments)
        off = np.abs(self.axes.T @ self.axes - np.eye(width)).sum() if width else 0.0
        self.slack = 2 * off + 16 * (width + 2) * np.finfo(np.float64).eps
        self.edges = np.unique(np.linspace(0, width, SLICES + 1).astype(int))

    def turn(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Turned vectors, norms of what follows each part, whole norms."""
        turned = q.astype(np.float64) @ self.axes
        tails = np.sqrt(np.cumsum((turned * turned)[:, ::-1], 1)[:, ::-1])
        tails = np.concatenate([tails, np.zeros((len(q), 1))], 1)[:, self.edges[1:]]
        return turned, tails, np.sqrt((q.astype(np.float64) ** 2).sum(1))


def rotation(vectors: DataFrame, width: int) -> Rotation:
    """The axes of the second moments of all vectors, summed in Spark: ``width`` squared numbers come to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            q = matrix(batch.column("q"), width).astype(np.float64)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    found = arrow_map(vectors.select("q"), partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    moments = np.zeros(width * width)
    moments[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    moments = moments.reshape(width, width)
    return Rotation((moments + moments.T) / 2)


def survivors(turn: Rotation, anchors: tuple, rows: tuple, floor: np.ndarray, ceiling: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of a tile that no partial product rules out: their score may be in [floor, ceiling] of the anchor."""
    (a, a_tail, a_norm), (x, x_tail, x_norm) = anchors, rows
    alive, score = allowed, np.zeros((len(a), len(x)))
    slack = turn.slack * a_norm[:, None] * x_norm[None] + 1e-6
    for part, (low, high) in enumerate(zip(turn.edges[:-1], turn.edges[1:], strict=True)):
        score += a[:, low:high] @ x[:, low:high].T
        rest = a_tail[:, part, None] * x_tail[None, :, part] * (1 + 1e-12) + slack
        alive = alive & (score + rest >= floor[:, None]) & (score - rest <= ceiling[:, None])
        if alive.mean() <= FEW:
            break
    return np.nonzero(alive)


class Best:
    """The best ``most`` rows of each slot, by score and then by the smaller id."""

    def __init__(self, slots: int, most: int) -> None:
        self.most = most
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)  # the score below which nothing is kept

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate([old, new]) for old, new in ((self.slot, slot), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        keep, full = rank < self.most, rank == self.most - 1
        self.least[slot[full]] = score[full]
        self.slot, self.score, self.ids = slot[keep], score[keep], ids[keep]


class Nearest:
    """Looks for the first rows of an anchor's own label."""

    same = True

    def __init__(self, anchors: int, most: int) -> None:
        self.best = Best(anchors, most)
        self.ceiling = np.full(anchors, np.inf)

    def floor(self) -> np.ndarray:
        return self.best.least

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.best.add(anchor, score, ids)


class Between:
    """Looks for the first rows of other labels within an interval of scores, one for each goal.

    ``of`` is the anchor of a goal, ascending; ``low`` and ``high`` its interval.
    """

    same = False

    def __init__(self, anchors: int, of: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> None:
        self.anchors, self.of, self.low, self.high = anchors, of, low, high
        self.best = Best(len(of), most)
        self.ceiling = np.full(anchors, -np.inf)
        np.maximum.at(self.ceiling, of, high)
        self.begin = np.searchsorted(of, np.arange(anchors))
        self.many = np.bincount(of, minlength=anchors)

    def floor(self) -> np.ndarray:
        out = np.full(self.anchors, np.inf)
        np.minimum.at(out, self.of, np.maximum(self.low, self.best.least))
        return out

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        many = self.many[anchor]
        pair = np.repeat(np.arange(len(anchor)), many)
        goal = self.begin[anchor][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        value = score[pair]
        fit = (value >= self.low[goal]) & (value <= self.high[goal]) & (value >= self.best.least[goal])
        self.best.add(goal[fit], value[fit], ids[pair[fit]])


class Chunk:
    """Anchors of a chunk in blocks of BLOCK, sorted by id: ids, labels, integers and turned vectors of each block."""

    def __init__(self, turn: Rotation, table: pa.Table, width: int) -> None:
        table = table.sort_by("vec_id").combine_chunks()
        self.turn, self.width = turn, width
        self.ids, self.blocks = table.column("vec_id").to_numpy(), []
        label, q = table.column("label").to_numpy(), matrix(table.column("q").combine_chunks(), width)
        for at in range(0, len(self.ids), BLOCK):
            part = slice(at, at + BLOCK)
            self.blocks.append((self.ids[part], label[part], q[part], turn.turn(q[part])))

    def scan(self, batches: Iterator[pa.RecordBatch], watches: list) -> None:
        """Show each row of ``batches`` to the watch of each block."""
        for batch in batches:
            for at in range(0, batch.num_rows, TILE // BLOCK):
                part = batch.slice(at, TILE // BLOCK)
                ids, label = (part.column(c).to_numpy() for c in ("vec_id", "label"))
                q = matrix(part.column("q"), self.width)
                turned = self.turn.turn(q)
                for (own, own_label, own_q, own_turned), watch in zip(self.blocks, watches, strict=True):
                    allowed = ((own_label[:, None] == label[None]) == watch.same) & (own[:, None] != ids[None])
                    a, x = survivors(self.turn, own_turned, turned, watch.floor(), watch.ceiling, allowed)
                    watch.add(a, np.einsum("ij,ij->i", own_q[a], q[x]), ids[x])


def _positives(chunk: Chunk, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        watches = [Nearest(len(b[0]), most) for b in chunk.blocks]
        chunk.scan(batches, watches)
        for (ids, *_), watch in zip(chunk.blocks, watches, strict=True):
            best = watch.best
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.slot]), pa.array(best.ids), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(chunk: Chunk, goals: pa.Table, low: int, high: int, most: int):
    """``goals`` are the positives of the chunk: anchor_id (ascending), positive_id, positive_score."""
    anchor, positive, score = (goals.column(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
    least, greatest = -((-low * score) // 100), (high * score) // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [slice(*np.searchsorted(anchor, [ids[0], ids[-1] + 1])) for ids, *_ in chunk.blocks]
        watches = [Between(len(ids), np.searchsorted(ids, anchor[p]), least[p], greatest[p], most) for (ids, *_), p in zip(chunk.blocks, parts, strict=True)]
        chunk.scan(batches, watches)
        for part, watch in zip(parts, watches, strict=True):
            best = watch.best
            columns = [anchor[part][best.slot], positive[part][best.slot], score[part][best.slot], best.ids, best.score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _top(df: DataFrame, keys: list[str], score: str, ids: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key, with their rank; Spark drops lower ranks before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ids)))
    return df.withColumn("rank", place).where(F.col("rank") <= most)


def mined(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the anchors of ``rows`` (vec_id, embedding, label): those whose vec_id ``every`` divides.

    Scores are integer inner products of quantised vectors.  An anchor's positives are the
    first ``positives`` other rows of its label, its negatives for a positive the first
    ``negatives`` rows of other labels that score between ``low`` and ``high`` percent of it.
    Rows without an id or a label, and vectors that are null or have a null or not finite
    component, take no part.  A row of the anchor's own id is neither; repeated rows count
    each, repeated anchors once by id (the least label and vector).  Short vectors are
    filled up with 0.  Anchors without positives or negatives give no row, nor does an empty table.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    vectors, path = stored(quantised(rows))
    width = vectors.agg(F.max(F.size("q"))).first()[0] or 0
    one = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v"))
    anchors, anchors_path = stored(one.select("vec_id", "v.label", "v.q"))
    used, found = [path, anchors_path], []
    chunks = -(-anchors.count() // ANCHORS)
    turn = rotation(vectors, width) if chunks else None
    for k in range(chunks):
        # Hashing deals the anchors evenly, so a chunk is bounded by a little over ANCHORS vectors.
        chunk = Chunk(turn, anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == k).toArrow(), width)
        near = arrow_map(vectors, _positives(chunk, positives), "anchor_id long, positive_id long, positive_score long")
        goals = _top(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank").toArrow().sort_by("anchor_id")
        far = arrow_map(vectors, _negatives(chunk, goals, low, high, negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        best, best_path = stored(_top(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(*RESULT))
        found.append(best)
        used.append(best_path)
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = cut(reduce(DataFrame.unionByName, found, none))
    for table in used:
        discard(spark, table)
    return out


def relabelled(rows: DataFrame) -> DataFrame:
    """The rows, with the label of every seventh id moved on by one."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
