"""N-gram Jaccard join: sets of word shingles that overlap by a share of their union.

Size-aware: a *light* set (few shingles) is enumerated, all its subsets that a partner may
have in common with it being hashed as keys; two light sets that link share such a key.  A
*heavy* set posts its rarest shingles (the prefix that any partner must meet) to inverted
lists, which are scanned.  The boundary is where the keys of a light set would cost more
than the postings and the expected scan of its lists, from the sizes and list lengths of
the corpus.  Sets near the boundary do both, so no pair is missed.

The subsets of a light set are of the sizes that a partner may share: the set less 0, 1, ...
of its shingles.  Equal sets are one node, named by 64 bits of its shingles' hashes.  Each
node draws DRAWS of its keys by least hashes, as its near copies mostly do too, and is paired
with one of the nodes that drew the same; once more, with HUBS of the largest group that drew
the same, if it is not of that group.  So a large group of near copies costs stars and not
its square.  At last the pairs of one list that are still in different components are
listed, each at the first keys that it shares.  Pairs whose sizes, places in the lists or
parity bitmaps rule out a link are
dropped for that: one of fixed size inside the join of lists, then one that grows with the
set.  The sets of the others are made again from their texts and compared.  Every pair that
shares a key is ruled out, compared or already connected: the components are exact, but for
collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm import textkernel as K
from volpanel.llm.frames import arrow_map, cut, discard, stored
from volpanel.llm.graphs import components

WORDS = 4
PERCENT = 85
SLOTS = 1 << 16
MOST_LIGHT = 26
WORDS_AT_LEAST = 8  # longs of the fixed bitmap
BITS_A_SHINGLE = 2
NEAR_SLOTS = 1 << 18
KEYS_AT_ONCE = 1 << 16
DRAWS = 6  # keys by which a node meets others before the pairs of all its lists are looked at
HUBS = 4
EARLIER = 6  # keys before a key by which a pair is known to be listed already
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """The least number of shingles that a set of this size shares with any partner."""
    return -(-percent * size // 100)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and the end of each text's stretch."""
    batch = K.Batch(texts)
    capital = (batch.codes >= 65) & (batch.codes <= 90)
    batch.codes = batch.codes + np.where(capital, 32, 0).astype("<u4")
    starts, ends = batch.runs(K.not_blank(batch.codes))
    owner = batch.owner(starts)
    word = batch.hashes(starts, ends)
    grams, first = K.ngrams(word, owner, words)
    of = owner[first]
    many = np.bincount(owner, minlength=batch.n)
    begin = np.concatenate([[0], np.cumsum(many)])
    for n in range(1, words):  # fewer words than a shingle: the whole sequence is one
        short = np.flatnonzero(many == n)
        if len(short):
            value = np.full(len(short), n, np.uint64)
            for j in range(n):
                value = K.mix(value * K.BASE + word[begin[short] + j])
            grams, of = np.concatenate([grams, value]), np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    if len(grams):
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])
        grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(batch.n), "right")


def nodes(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A name for each set: 64 bits of two sums over its shingles and of its size; 0 for the empty set."""
    edges = np.concatenate([[0], ends])
    one, two = (np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[edges]) for x in (K.mix(grams), K.mix(grams ^ SECOND)))
    size = np.diff(edges).astype(np.uint64)
    return np.where(size > 0, K.mix(one * K.BASE + K.mix(two + size)), np.uint64(0))


def bitmaps(grams: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the sets, ``words`` longs (a power of two) for each, and their offsets.

    Bit (hash mod bits) is the parity of the shingles there: two sets differ in at least as
    many shingles as bits.  The halves of a bitmap give by XOR that of half the size.
    """
    offsets = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    bits = np.zeros(offsets[-1], np.uint64)
    cell = offsets[owner] + ((grams >> np.uint64(6)) & (words[owner] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(bits, cell, np.uint64(1) << (grams & np.uint64(63)))
    return bits, offsets


def _longs(bits: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(K.as_long(bits)))


MEASURED = "kind int, a long, n int, node long, bits array<long>, wide array<long>"


def _measure(width: int):
    """A row per document (kind 0: id, size, node, bitmaps), then shingle counts by slot (kind 1: slot, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "n", "node", "bits", "wide"]
        counts = np.zeros(SLOTS, np.int64)
        for ids, raw in K.texts_of(batches, "doc_id"):
            grams, ends = shingles([x or "" for x in raw], width)
            counts += np.bincount((grams >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
            size = np.diff(np.concatenate([[0], ends]))
            fixed = np.full(len(raw), WORDS_AT_LEAST)
            grown = np.maximum(fixed, 1 << np.ceil(np.log2(np.maximum(BITS_A_SHINGLE * size, 64) / 64)).astype(np.int64))
            maps = [_longs(*bitmaps(grams, ends, w)) for w in (fixed, grown)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(raw), np.int32)), pa.array(ids, pa.int64()), pa.array(size.astype(np.int32)), pa.array(K.as_long(nodes(grams, ends))), *maps], names)
        slots = np.flatnonzero(counts)
        none = pa.nulls(len(slots), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(slots), np.int32)), pa.array(slots), pa.array(np.zeros(len(slots), np.int32)), pa.array(counts[slots]), none, none], names)

    return run


def subsets(size: int, percent: int = PERCENT) -> int:
    """How many subsets of a set of this size a partner may share."""
    return sum(math.comb(size, d) for d in range((100 - percent) * size // 100 + 1))


def boundary(sizes: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The largest size of a light set: least total cost of enumerating below and scanning above."""

    def scan(s: int) -> float:
        return (s - least_overlap(s, percent) + 1) * (1 + list_length)

    cost, best, at = 0.0, 0.0, 0
    for s in range(1, MOST_LIGHT + 1):
        cost += sizes.get(s, 0) * (subsets(s, percent) - scan(s))
        if cost < best:
            best, at = cost, s
    return at


def _post(counts: np.ndarray, light: int, percent: int, width: int):
    """Keys of the sets: (key, node, n, place); of a subset the place is -1.  A slice posts an equal set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = least_overlap(light + 1, percent)  # the least partner of a set beyond the boundary
        for (raw,) in K.texts_of(batches):
            grams, ends = shingles([x or "" for x in raw], width)
            edges = np.concatenate([[0], ends])
            size = np.diff(edges)
            name = nodes(grams, ends)
            alone = np.zeros(len(raw), bool)
            alone[np.unique(name, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(raw)), size)
            # Rarest first, by the counts of the slots; any fixed order of the shingles is exact.
            order = np.lexsort((grams, counts[(grams >> np.uint64(48)).astype(np.int64)], owner))
            place = np.arange(len(grams)) - edges[owner]
            prefix = size - -(-percent * size // 100) + 1
            take = (place < prefix[owner]) & (size[owner] >= heavy) & alone[owner]

            def rows(keys: np.ndarray, at: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
                columns = K.as_long(keys), K.as_long(name)[at], size[at].astype(np.int32), places.astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "place"])

            yield rows(grams[order][take], owner[take], place[take])
            keys, at, held = [], [], 0
            for i in np.flatnonzero((size > 0) & (size <= light) & alone).tolist():
                own, n = K.mix(grams[edges[i] : ends[i]]).tolist(), int(size[i])
                whole = sum(own)
                made = [(whole - sum(out) + n - d) % (1 << 64) for d in range((100 - percent) * n // 100 + 1) for out in combinations(own, d)]
                keys.append(K.mix(np.array(made, np.uint64) ^ SECOND))
                at.append(np.full(len(made), i))
                held += len(made)
                if held >= KEYS_AT_ONCE:
                    yield rows(np.concatenate(keys), np.concatenate(at), np.full(held, -1))
                    keys, at, held = [], [], 0
            if held:
                yield rows(np.concatenate(keys), np.concatenate(at), np.full(held, -1))

    return run


def _sets(width: int):
    """(node, grams) of the texts; a slice gives an equal set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (raw,) in K.texts_of(batches):
            grams, ends = shingles([x or "" for x in raw], width)
            made = pa.RecordBatch.from_arrays([pa.array(K.as_long(nodes(grams, ends))), _longs(grams, np.concatenate([[0], ends]))], ["node", "grams"])
            yield made.take(pa.array(np.unique(made.column("node").to_numpy(), return_index=True)[1]))

    return run


def _may_link(apart, n: str, m: str, percent: int):
    """Whether sets of these sizes may differ in so many shingles."""
    return (100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m))


def _near(left: str, n: str, right: str, m: str, percent: int):
    """Whether the fixed bitmaps of two sets allow a link."""
    return _may_link(reduce(lambda x, y: x + y, (F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(WORDS_AT_LEAST))), n, m, percent)


def _folded(bits, size):
    """A bitmap of half the size by XOR of its halves, where it is longer than ``size``."""
    half = F.zip_with(F.slice(bits, F.lit(1), size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > size, half).otherwise(bits)


def _possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and grown bitmaps allow a link; partners' bitmaps are at most a factor 2 apart."""
    left = maps.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("wide").alias("left"))
    right = maps.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("wide").alias("right"))
    size = F.least(F.size("left"), F.size("right"))
    differ = F.zip_with(_folded(F.col("left"), size), _folded(F.col("right"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    met = pairs.join(right, "b").join(left, "a").where(_fit("an", "bn", percent))
    apart = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    return met.where(_may_link(apart, "an", "bn", percent)).select("a", "b")


def _draw(lists: DataFrame, turn: int) -> DataFrame:
    """(key, node, n): of all keys of its lists, a node draws DRAWS by the least hashes, of DRAWS hash functions."""
    least = [F.min(F.struct(F.xxhash64("key", F.lit(turn * DRAWS + t)), "key"))["key"] for t in range(DRAWS)]
    return lists.groupBy("node", "n").agg(F.array_distinct(F.array(*least)).alias("keys")).select(F.explode("keys").alias("key"), "node", "n")


def _met(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``met`` (node, n, hub) whose sizes allow a link."""
    fit = met.where((F.col("node") != F.col("hub.node")) & _fit("n", "hub.n", percent))
    return fit.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()


def _near_pairs(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose fixed bitmaps allow a link."""
    ends = [maps.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").where(_near("a_bits", "a_n", "b_bits", "b_n", percent)).select("a", "b")


def _drawn(lists: DataFrame) -> DataFrame:
    """Nodes, each with one of those that drew the same key."""
    drawn = _draw(lists, 0)
    hubs = drawn.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct(F.xxhash64("node", "key"), "node", "n")).alias("hub")).where("many > 1")
    return drawn.join(hubs, "key").select("node", "n", "hub")


def _toward_groups(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Nodes, each with HUBS of the largest component that drew the same key, of three nodes at least, if it is of another."""
    placed = _draw(lists, 1).join(label, "node", "left")
    least = [F.min(F.struct(F.xxhash64("node", "key", F.lit(t)), "node", "n")) for t in range(HUBS)]
    groups = placed.where("component IS NOT NULL").groupBy("key", "component").agg(F.count("*").alias("many"), F.array(*least).alias("hubs")).where("many > 2")
    top = groups.groupBy("key").agg(F.max(F.struct("many", "component", "hubs")).alias("top"))
    met = placed.join(top, "key").where(~F.col("component").eqNullSafe(F.col("top.component")))
    return met.select("node", "n", F.explode("top.hubs").alias("hub"))


class _Compared:
    """Exact comparison of pairs; a set is made once, from a text that has it, when a pair first asks for it.

    ``ids`` has (node, rep), a document of each node.
    """

    def __init__(self, texts: DataFrame, ids: DataFrame, percent: int, words: int) -> None:
        self.texts, self.ids, self.percent, self.words = texts, ids, percent, words
        self.made: list[tuple[DataFrame, str]] = []

    def sets(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (df for df, _ in self.made))

    def _make(self, pairs: DataFrame) -> None:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.made:
            asked = asked.join(self.sets().select("node"), "node", "left_anti")
        wanted = cut(asked.join(self.ids, "node").select(F.col("rep").alias("doc_id")).distinct())
        if self.made and wanted.isEmpty():
            return
        # A bounded filter keeps most other texts from the shuffle: NEAR_SLOTS numbers at most.
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(NEAR_SLOTS))
        likely = self.texts.join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")
        self.made.append(stored(arrow_map(likely.join(wanted, "doc_id", "left_semi").select("text"), _sets(self.words), "node long, grams array<long>")))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link."""
        pairs = cut(pairs.select("a", "b"))
        self._make(pairs)
        left = self.sets().select(F.col("node").alias("a"), F.col("grams").alias("left"))
        right = self.sets().select(F.col("node").alias("b"), F.col("grams").alias("right"))
        both = F.size(F.array_intersect("left", "right"))
        enough = 100 * both >= self.percent * (F.size("left") + F.size("right") - both)
        return cut(pairs.select("a", "b").join(right, "b").join(left, "a").where(enough).select("a", "b").distinct())

    def discard(self) -> None:
        for _, path in self.made:
            discard(self.texts.sparkSession, path)


def _fit(n: str, m: str, percent: int):
    """Sizes of which one set can hold the least overlap of the other."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _room(n: str, place: str, m: str, other: str, percent: int):
    """Whether a pair whose first common shingle has these places may still overlap enough.

    The first key that a linked pair shares passes; a subset key (place -1) always does.
    """
    overlap = F.least(F.col(n) - F.greatest(place, F.lit(0)), F.col(m) - F.greatest(other, F.lit(0)))
    return (100 + percent) * overlap >= percent * (F.col(n) + F.col(m))


def _open(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The lists that hold different components: each member's component ``c`` and the list's largest, ``top``."""
    placed = lists.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    groups = placed.groupBy("key", "c").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max_by("c", F.struct("size", "c")).alias("top")).where("low < high")
    return placed.join(mixed.select("key", "top"), "key")


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components of the open ``lists`` that no bound rules out.

    Members outside a list's largest component meet all of the list; both sides are one
    exchange.  A pair is listed at its first common key; at another one it is left out where
    the EARLIER keys before it, in the one order that all sets share, have a common one too.
    """
    before = Window.partitionBy("node").orderBy("place", "key").rowsBetween(-EARLIER, -1)
    lists = lists.withColumn("earlier", F.collect_list("key").over(before))
    one, two = (lists.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "place", "c", "top", "bits", "earlier"))) for x in "xy")
    once = (F.col("x_c") != F.col("y_top")) & (F.col("x_c") != F.col("y_c")) & ((F.col("y_c") == F.col("x_top")) | (F.col("x_node") < F.col("y_node")))
    bounds = _fit("x_n", "y_n", percent) & _room("x_n", "x_place", "y_n", "y_place", percent) & _near("x_bits", "x_n", "y_bits", "y_n", percent)
    met = one.join(two, (one["key"] == two["key"]) & once & bounds & ~F.arrays_overlap("x_earlier", "y_earlier"))
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def linked(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Components of ``docs`` (doc_id, text) under the join: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of
    shingles of ``words`` words (of fewer words: the whole sequence).  Null and empty texts have an
    empty set and are linked with nothing; a null id gets a null component.  Rows of equal
    id are each in the component of their own text.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured, measured_path = stored(arrow_map(texts, _measure(words), MEASURED))
    own = measured.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "node", "bits", "wide")
    slots = measured.where("kind = 1").groupBy(F.col("a").alias("slot")).agg(F.sum("node").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)  # at most SLOTS numbers, whatever the corpus
    counts[slots["slot"]] = slots["n"]
    total = max(int(counts.sum()), 1)
    length = max(float((counts.astype(np.float64) ** 2).sum()) / total - total / SLOTS, 1.0)
    sizes = {r["n"]: r["count"] for r in own.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").count().collect()}
    light = boundary(sizes, length, percent)

    # One document of each set; its bitmaps are those of the set.
    filled = own.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    ids = cut(filled.groupBy("node").agg(F.min("doc_id").alias("rep")))
    maps = filled.join(ids, "node").where(F.col("doc_id") == F.col("rep")).dropDuplicates(["node"]).select("node", "n", "bits", "wide")
    maps, maps_path = stored(maps)

    posted, posted_path = stored(arrow_map(texts.where(F.col("doc_id").isNotNull()).select("text"), _post(counts, light, percent, words), "key long, node long, n int, place int"))
    shared = posted.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    lists, lists_path = stored(posted.join(shared, "key").groupBy("key", "node", "n").agg(F.min("place").alias("place")))
    discard(spark, posted_path)
    compared = _Compared(texts, ids, percent, words)
    near = cut(_near_pairs(_met(_drawn(lists), percent), maps, percent))
    links = [compared.links(_possible(near, maps, percent))]
    label = components(links[0])
    near = cut(_met(_toward_groups(lists, label), percent))
    links.append(compared.links(_possible(near, maps, percent)))
    label = components(links[0].unionByName(links[1]))

    # All pairs of one list that are not connected yet.
    open_lists, open_path = stored(_open(lists, label).join(maps.select("node", "bits"), "node"))
    discard(spark, lists_path)
    links.append(compared.links(_possible(cut(_across(open_lists, percent)), maps, percent)))
    for path in (open_path, maps_path):
        discard(spark, path)
    compared.discard()
    label = components(reduce(DataFrame.unionByName, links))

    names = ids.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = names.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = names.join(least_id, "component").select("node", "component_id")
    out = own.select("doc_id", "n", "node").join(named, "node", "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = cut(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), known.alias("component_id")))
    discard(spark, measured_path)
    return out
