"""Removal of bytes in long strings that stand earlier in the corpus, by a run-length index.

A string of LENGTH bytes is a *window*.  Each window chooses its least gram of GRAM bytes by
hash (its anchor), so equal windows choose equal grams at the same place.  A *segment* is a
stretch of neighbouring windows with one anchor.  Spark deals segments by anchor; of equal
segments all but the first are repeats as a whole, and an anchor that no other text has
rules its windows out.  What is left are anchors whose surroundings differ.  Their segments
are repetitive text, put into bounded blocks in the order of the corpus, and each block
gets a run-compressed Burrows-Wheeler transform with sampled run ends.  From the samples
the matching statistics of the block are streamed in text order: within a run the previous
suffix moves along with the position and the match is one shorter at each step.  Chains of
matches of LENGTH lead to the first of equal windows; the others are removed.

Anchors with more than MANY different segments (a line that a large part of the corpus has)
are dealt anew: their windows are halved by their place relative to the anchor, so that a
longer string, which all windows of a half contain, takes the place of the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm import textkernel as K
from volpanel.llm.frames import arrow_map, cut, discard, stored

LENGTH = 100
WINDOWS = 64  # neighbouring grams of which a window chooses one; a segment has at most as many windows
PIECE = 1 << 18  # bytes of a text looked at together
SLAB = 1 << 19  # segments of a task within which equal ones are told apart before they are dealt
ROWS = 1 << 16  # rows of a batch of segments
MANY = 256  # segments of an anchor that are indexed together
BLOCK = 1 << 17  # bytes of a block, one anchor at least
SEGMENTS = "g long, h long, doc long, at long, span int, off int"
BODIES = f"{SEGMENTS}, many long, low int, high int, body binary"
MARKS = "doc long, at long, span int, h long, mask long"
ALL = -1  # the mask of all windows of a segment


class Bytes(K.Batch):
    """A batch of byte strings, one behind the other, with the hashes of their substrings."""

    def __init__(self, parts: list[bytes]) -> None:
        self.n = len(parts)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.codes = np.frombuffer(b"".join(parts), np.uint8)
        self._prefix = None


def segments(parts: list[bytes], length: int = LENGTH, windows: int = WINDOWS) -> tuple[np.ndarray, ...]:
    """(part, start, span, off, g, h) of the segments of some byte strings.

    ``start`` is that of the first window, ``span`` the number of further windows, ``off`` the
    place of the anchor in the first one; ``g`` and ``h`` are hashes of anchor and segment.
    """
    gram = length - windows + 1
    batch = Bytes(parts)
    n = len(batch.codes)
    none = np.zeros(0, np.int64)
    if n < length:
        return (none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    place = np.arange(n - gram + 1)
    grams = batch.hashes(place, place + gram)
    bits = np.uint64(max(int(n).bit_length(), 1))
    least = ((grams >> bits) << bits) | place.astype(np.uint64)  # of equal grams the first
    step = 1
    while step < windows:  # the least of ``windows`` neighbours, by doubling
        width = min(step, windows - step)
        least = np.minimum(least[: len(least) - width], least[width:])
        step += width
    owner = batch.owner(np.arange(len(least)))
    whole = np.arange(len(least)) + length <= batch.starts[owner + 1]
    anchor = np.where(whole, (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), -1)
    edge = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    a = anchor[first]
    span = last - first
    return owner[first], first - batch.starts[owner[first]], span, a - first, grams[a], batch.hashes(first, last + length)


def pieces(ids: list, raw: list[str | None], length: int = LENGTH) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Ids, offsets and bytes of pieces of the texts, PIECE bytes at a time; pieces overlap so that each window is in one."""
    held, offsets, parts, size = [], [], [], 0
    for i, text in zip(ids, raw, strict=True):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data) - length + 1, 0), PIECE):
            part = data[at : at + PIECE + length - 1]
            if held and size + len(part) > PIECE:
                yield held, offsets, parts
                held, offsets, parts, size = [], [], [], 0
            held.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if held:
        yield held, offsets, parts


def _rows(values: tuple, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(K.as_long(v) if getattr(v, "dtype", None) == np.uint64 else v, kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])


def _dealt(length: int, windows: int):
    """The segments of the texts.  Of equal ones within a slab only the first is dealt by its anchor.

    The others are repeats already: they get -1 - span, and any other key, so that a segment
    which many texts have is not many rows of one key.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        g, h, doc, at, _, _ = columns
        order = np.lexsort((at, doc, h, g))
        g, h, doc, at, span, off = (c[order] for c in columns)
        alike = np.concatenate([[False], (g[1:] == g[:-1]) & (h[1:] == h[:-1])])
        same = alike & np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])  # of a repeated row
        g, h, doc, at, span, off, again = (c[~same] for c in (g, h, doc, at, span, off, alike))
        g = np.where(again, K.mix(h ^ K.mix(doc.view(np.uint64) + K.mix(at.view(np.uint64)))), g)
        out = (g, h, doc, at, np.where(again, -1 - span, span), off)
        for low in range(0, len(g), ROWS):
            yield _rows(tuple(c[low : low + ROWS] for c in out), SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for ids, raw in K.texts_of(batches, "doc"):
            for docs, offsets, parts in pieces(ids, raw, length):
                part, start, span, off, g, h = segments(parts, length, windows)
                held.append((g, h, np.array(docs, np.int64)[part], np.array(offsets, np.int64)[part] + start, span, off))
                many += len(part)
                if many >= SLAB:
                    yield from flush(held)
                    held, many = [], 0
        if many:
            yield from flush(held)

    return run


def suffixes(codes: np.ndarray) -> np.ndarray:
    """Suffix array of ``codes``, in which 0 ends a string; ends are ordered by place, so all suffixes differ.

    Prefix doubling: ranks by 7 symbols, then by twice as many, of suffixes that are not apart yet.
    """
    n, depth = len(codes), 7
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)]).astype(np.int64)
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(depth):
        symbol = np.where(ended, 0, padded[j : j + n])
        key = (key << 9) | symbol
        ended |= symbol == 0
    order = np.lexsort((np.where(ended, np.arange(n), 0), key))
    same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & ~ended[order][1:]])
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank[order] = head
    while True:
        several = same | np.concatenate([same[1:], [False]])
        at = np.flatnonzero(several)
        if not len(at):
            return order
        place = order[at]
        pair = rank[place] * (n + 1) + rank[place + depth]
        again = np.argsort(pair, kind="stable")
        order[at], pair = place[again], pair[again]
        tied = np.concatenate([[False], pair[1:] == pair[:-1]])
        same[at] = tied
        head = np.maximum.accumulate(np.where(tied, 0, at))
        rank[order[at]] = head
        depth *= 2


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, with the suffixes at its run heads.

    ``where`` are the text positions of the run heads, ascending; ``before`` the suffix just
    before each in sorted order, ``common`` their longest common prefix.  Ends of strings are runs of their own.
    """

    def __init__(self, parts: list[bytes]) -> None:
        sizes = np.array([len(p) for p in parts], np.int64) + 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.n = int(self.starts[-1])
        codes = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
        codes[self.starts[1:] - 1] = 0
        order = suffixes(codes)
        bwt = codes[order - 1]
        heads = np.flatnonzero(np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)]))
        self.symbols, self.lengths = bwt[heads], np.diff(np.concatenate([heads, [self.n]]))
        where, before = order[heads], np.where(heads > 0, order[heads - 1], -1)
        by = np.argsort(where)
        self.where, self.before = where[by], before[by]
        self.common = self._common(parts)

    def _common(self, parts: list[bytes]) -> np.ndarray:
        """Longest common prefixes of the sampled neighbours, by halving, over hashes of substrings."""
        batch = Bytes([p + b"\0" for p in parts])
        ends = self.starts[1:] - 1
        one, two = self.where, np.maximum(self.before, 0)
        low = np.zeros(len(one), np.int64)
        high = np.minimum(ends[batch.owner(one)] - one, ends[batch.owner(two)] - two)
        high = np.where(self.before < 0, 0, high)
        while (low < high).any():
            mid = (low + high + 1) // 2
            equal = batch.hashes(one, one + mid) == batch.hashes(two, two + mid)
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics in text order: for each position the suffix just before its own, and how long both agree.

        From a sample on, both move along with the position until the next one.
        """
        nearest = np.zeros(self.n, np.int64)
        nearest[self.where] = np.arange(len(self.where))
        nearest = np.maximum.accumulate(nearest)
        moved = np.arange(self.n) - self.where[nearest]
        return self.before[nearest] + moved, self.common[nearest] - moved


def repeated(parts: list[bytes], doc: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``parts`` that stand earlier: their part and their place in it.

    Part i is of document ``doc[i]``, from ``at[i]`` on; earlier is by (document, place).
    """
    index = RunLengthIndex(parts)
    before, common = index.matches()
    long = np.flatnonzero(common >= length)
    if not len(long):
        return long, long
    root = np.arange(index.n)
    root[long] = before[long]
    while True:  # the end of each chain, in twice the steps each time
        further = root[root[long]]
        if (further == root[long]).all():
            break
        root[long] = further
    members = np.union1d(long, root[long])
    part = np.searchsorted(index.starts, members, "right") - 1
    place = members - index.starts[part]
    order = np.lexsort((at[part] + place, doc[part], root[members]))
    part, place, chain = part[order], place[order], root[members][order]
    head = np.searchsorted(chain, chain, "left")
    earlier = (doc[part[head]] != doc[part]) | (at[part[head]] + place[head] != at[part] + place)
    return part[earlier], place[earlier]


def _masks(part: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.bitwise_or.at(out, part, np.uint64(1) << place.astype(np.uint64))
    return out


def _indexed(length: int):
    """Marks of the segments of anchors that come one after another: whole anchors are put into blocks."""

    def block(rows: list[dict]) -> pa.RecordBatch:
        doc, at, span, h = (np.array([r[c] for r in rows], np.int64) for c in ("doc", "at", "span", "h"))
        mask = _masks(*repeated([r["body"] for r in rows], doc, at, length), len(rows))
        hit = mask != 0
        return _rows((doc[hit], at[hit], span[hit], h[hit], mask[hit]), MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= BLOCK and row["g"] != last:
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["body"])
                last = row["g"]
        if held:
            yield block(held)

    return run


def _bodies(length: int, windows: int):
    """The bytes of segments: of each row (text, asked) those that are asked for and, by their hash, are there.

    Their windows stand at 0 to ``windows`` - 1 bytes before their anchor (low, high).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for low in range(0, len(asked), 1000):
                    part = asked[low : low + 1000]
                    bodies = [data[a["at"] : a["at"] + a["span"] + length] for a in part]
                    held = Bytes(bodies)
                    h = K.as_long(held.hashes(held.starts[:-1], held.starts[1:]))
                    keep = [i for i, a in enumerate(part) if a["h"] == h[i]]
                    columns = [[part[i][c] for i in keep] for c in ("g", "h", "doc", "at", "span", "off", "many")]
                    yield _rows((*columns, [0] * len(keep), [windows - 1] * len(keep), [bodies[i] for i in keep]), BODIES)

    return run


def _halved(length: int):
    """Segments whose windows stand at ``low`` to ``high`` bytes before their anchor, by the two halves of that range.

    The key of a half is the hash of the string that all its windows contain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, cores, made = [], [], []
            for r in batch.to_pylist():
                middle = (r["low"] + r["high"]) // 2
                for least, most in ((r["low"], middle), (middle + 1, r["high"])):
                    first, last = max(r["off"] - most, 0), min(r["off"] - least, r["span"])
                    if first <= last:
                        body, off = r["body"][first : last + length], r["off"] - first
                        bodies.append(body)
                        cores.append(body[off - least : off - most + length])
                        made.append((r["doc"], r["at"] + first, last - first, off, 0, least, most))
            if made:
                h, g = (b.hashes(b.starts[:-1], b.starts[1:]) for b in (Bytes(bodies), Bytes(cores)))
                columns = list(zip(*made, strict=True))
                yield _rows((K.mix(g + np.array(columns[-1], np.uint64)), h, *columns, bodies), BODIES)

    return run


def _split(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments dealt anew: repeats as a whole (marks), and the first of each other one, with how many there are of its anchor."""
    place = F.struct("doc", "at")
    firsts = cut(bodies.groupBy("g", "h").agg(F.min(F.struct("doc", "at", "span", "off", "low", "high", "body")).alias("first")))
    known = firsts.select("g", "h", F.col("first.doc").alias("doc0"), F.col("first.at").alias("at0"))
    again = bodies.join(known, ["g", "h"]).where(place > F.struct(F.col("doc0").alias("doc"), F.col("at0").alias("at")))
    many = firsts.groupBy("g").agg(F.count("*").alias("many")).where("many > 1")
    rest = firsts.join(many, "g").select("g", "h", "first.doc", "first.at", "first.span", "first.off", "many", "first.low", "first.high", "first.body")
    return again.select("doc", "at", "span", "h", F.lit(ALL).cast("long").alias("mask")), rest


def marks(texts: DataFrame, length: int = LENGTH, windows: int = WINDOWS) -> tuple[DataFrame, list[str]]:
    """Windows of ``texts`` (doc, text) that stand earlier: doc, at, span, h and a mask over the windows at .. at + span.

    ``h`` is the hash of the bytes from ``at`` to the end of the last window.  Returns the paths of tables made too.
    """
    dealt = arrow_map(texts, _dealt(length, windows), SEGMENTS).repartition("g")
    own, alike = Window.partitionBy("g"), Window.partitionBy("g", "h").orderBy("doc", "at")
    nth = dealt.withColumn("nth", F.rank().over(alike))
    counted = nth.withColumn("many", F.sum((F.col("nth") == 1).cast("long")).over(own)).withColumn("differ", F.min("h").over(own) < F.max("h").over(own))
    kept, kept_path = stored(counted.where("span < 0 OR nth > 1 OR differ").drop("differ"))
    all_of = F.lit(ALL).cast("long").alias("mask")
    found = [kept.where("span < 0 OR nth > 1").select("doc", "at", F.when(F.col("span") < 0, -1 - F.col("span")).otherwise(F.col("span")).alias("span"), "h", all_of)]
    asked = kept.where("span >= 0 AND nth = 1").groupBy("doc").agg(F.collect_list(F.struct("g", "h", "doc", "at", "span", "off", "many")).alias("asked"))
    bodies, bodies_path = stored(arrow_map(texts.join(asked, "doc").select("text", "asked"), _bodies(length, windows), BODIES))
    used = [kept_path, bodies_path]
    few, rest = [], bodies
    while True:
        few.append(rest.where(F.col("many") <= MANY))
        crowd = rest.where((F.col("many") > MANY) & (F.col("low") < F.col("high")))
        if crowd.isEmpty():
            break
        parts, path = stored(arrow_map(crowd, _halved(length), BODIES))
        again, rest = _split(parts)
        rest, rest_path = stored(rest)
        found.append(again)
        used += [path, rest_path]
    together = reduce(DataFrame.unionByName, few).repartition("g").sortWithinPartitions("g", "doc", "at")
    found.append(arrow_map(together, _indexed(length), MARKS))
    return reduce(DataFrame.unionByName, found), used


def _covered(length: int):
    """What is left of each text and the stretches that go, from its marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in K.parts_of(batches):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in raw]
            batch = Bytes(data)
            lists = part.column("marks")
            many = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = lists.flatten()
            at, span, h, mask = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "span", "h", "mask"))
            owner = np.repeat(np.arange(len(data)), many)
            first = batch.starts[owner] + at
            end = first + span + length
            inside = end <= batch.starts[owner + 1]
            first, end, mask, h = first[inside], end[inside], mask[inside], h[inside]
            own = K.as_long(batch.hashes(first, end)) == h  # of another row of this id if not
            first, end, mask = first[own], end[own], mask[own]
            change = np.zeros(len(batch.codes) + 1, np.int64)
            whole = mask == ALL
            np.add.at(change, first[whole], 1)
            np.add.at(change, end[whole], -1)
            first, mask = first[~whole], mask[~whole].view(np.uint64)
            for k in range(WINDOWS):
                one = first[(mask >> np.uint64(k)) & np.uint64(1) == 1] + k
                np.add.at(change, one, 1)
                np.add.at(change, one + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            spans, kept = [], []
            for low, high in zip(batch.starts[:-1].tolist(), batch.starts[1:].tolist(), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[low:high], [False]]).view(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(batch.codes[low:high][~gone[low:high]].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [part.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """``docs`` (doc_id, text) without bytes in strings of ``length`` bytes that stand earlier: doc_id, n_bytes, spans, kept.

    Earlier is by (doc_id, place); overlaps count, and strings are judged on the input.
    ``spans`` are the removed stretches (start, end), ``kept`` the other bytes.  Null texts
    are empty.  A row without an id has no place in the order: nothing goes from it or
    because of it.  Rows of one id are one document: among them only an earlier place
    counts, so repeated rows have equal results.  An empty table gives an empty result; other columns are not read.
    ``windows`` is 64 at most.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select(F.col("doc_id").alias("doc"), "text")
    found, used = marks(named, length, windows)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("at", "span", "h", "mask")).alias("marks"))
    joined = texts.join(by_doc, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "marks")
    out = cut(arrow_map(joined, _covered(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"))
    for path in used:
        discard(docs.sparkSession, path)
    return out


def removed_of(docs: DataFrame) -> DataFrame:
    """Digest of :func:`without_repeats` for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = without_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
