"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key scaled by its quality weight, ``-ln(u) / weight``
with u from a hash of its id.  A source takes whole epochs of all its documents as often as
its target allows; the rest of its word budget goes to the documents of the smallest keys,
whose sizes are prefix-summed until the budget is spent.  The document at the boundary is
taken for the words that are left.

The prefix sum never sorts a source in one task.  Keys are cut into ``BUCKETS`` ordered
buckets, whose sizes are summed before the shuffle; only the bucket that the budget ends in
is cut again, ``LEVELS`` times, and only documents of the last such bucket are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.frames import cut, small_join

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BUCKETS = 1024
LEVELS = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """Weight of a document from its text: the share of characters that are ASCII letters, from 0.25 to 1."""
    share = F.length(F.regexp_replace(text, "[^A-Za-z]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.25))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Word targets from ``sizes`` (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; where that is over ``cap`` times a source's size, the excess is shared again by
    weight.  The fixed point of that is found at once: in the order of size by weight, a
    source is at its cap if what is left for a unit of weight exceeds it.
    """
    # One row per source: both windows below order a table of sources, not of documents.
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = weighed.withColumn("level", rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    full = F.col("level") * F.col("weight") > cap * F.col("source_size")
    level = F.min(F.when(~full, F.struct(F.col("position"), F.col("level")))).over(whole)["level"]
    return (
        share.withColumn("position", F.row_number().over(order))
        .withColumn("final", level)
        .withColumn("free", ~full)
        .withColumn("target", F.when(F.col("free"), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight")).otherwise((cap * F.col("source_size")).cast("double")))
        .select("source", "source_size", "target")
    )


def _cells(key: Column, level: int) -> Column:
    """Bucket of a key at each level: an increasing step function of the key, refined by level."""
    return F.floor(-F.expm1(-key) * float(BUCKETS ** (level + 1))).cast("long")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Words taken of each row of ``docs`` (doc_id, source, size, weight).

    Returns doc_id, size, source_size, target, epochs, taken: ``taken`` is
    epochs * size plus the words of the fractional selection.  A null source is a source; a
    null id has a key like any other; rows of equal id have equal keys and are ordered by
    size.  Sizes of 0 take nothing, an empty table gives an empty result.
    """
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight")
    # Read several times below, so the texts are measured once; a few numbers a document.
    rows = cut(docs.select("doc_id", F.to_json(F.struct("source")).alias("group"), "source", "size", key.alias("key")))
    budget = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    goal = cut(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", budget)
        .select(F.to_json(F.struct("source")).alias("group"), "source_size", "target", "epochs", "budget")
    )
    # (group, cell, budget left in that cell) after each level; no row once the budget is met.
    edge = goal.select("group", F.lit(0).cast("long").alias("cell"), F.col("budget").alias("left"))
    for level in range(LEVELS):
        inside = rows.withColumn("fine", _cells(F.col("key"), level))
        if level:
            inside = small_join(inside, edge, "group").where(_cells(F.col("key"), level - 1) == F.col("cell"))
        sums = small_join(inside.groupBy("group", "fine").agg(F.sum("size").alias("size")), edge.select("group", "left"), "group")
        past = F.coalesce(F.sum("size").over(Window.partitionBy("group").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = sums.withColumn("past", past).where((F.col("past") <= F.col("left")) & (F.col("left") < F.col("past") + F.col("size")))
        edge = cut(ends.select("group", F.col("fine").alias("cell"), (F.col("left") - F.col("past")).alias("left")))
    # Without an edge (a source without words) nothing is left to take.
    ends = edge.withColumnRenamed("left", "rest")
    placed = small_join(rows, cut(goal.join(ends, "group", "left")), "group").withColumn("fine", _cells(F.col("key"), LEVELS - 1))
    at_edge = F.coalesce(F.col("fine") == F.col("cell"), F.lit(False))
    order = Window.partitionBy("group").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0))
    some = placed.where(at_edge).withColumn("part", F.least(F.col("size"), F.greatest(left, F.lit(0))))
    others = placed.where(~at_edge).withColumn("part", F.when(F.col("fine") < F.col("cell"), F.col("size")).otherwise(0))
    return others.unionByName(some).select("doc_id", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixture(documents: DataFrame) -> DataFrame:
    """Mix documents (doc_id, text, source) by words, with quality weights from their texts."""
    return mix(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality(F.col("text")).alias("weight")))


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``documents`` (any columns, with doc_id, text, source), each as often as it is taken.

    A document that the budget takes in part comes with its first words, and n_chars, if
    there is one, to match.  Rows of equal id and size are taken alike, as often as the one
    of them that is taken most; rows of equal id and other sizes each by their own share,
    and so are null ids.  Texts without words (null and empty ones too) are not taken.  The
    other columns pass through under whatever names; an empty table gives an empty result.
    """
    share = mixture(documents).groupBy("doc_id", "size").agg(F.max("epochs").alias("epochs"), F.max("taken").alias("taken"))
    share = share.select("doc_id", "size", "epochs", (F.col("taken") - F.col("epochs") * F.col("size")).alias("part"))
    own = F.col("own")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("own")).withColumn("words", word_count(own["text"]))
    copies = F.col("epochs") + (F.col("part") > 0).cast("long")
    same = own["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size"))
    taken = rows.where("words > 0").join(share.where("size > 0"), same).where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut_short = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    words = F.split(own["text"], "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    taken = taken.withColumn("new", F.when(cut_short, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")).otherwise(own["text"]))
    changed = {"text": F.col("new")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(cut_short, F.length("new").cast(documents.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return taken.select(*(changed.get(c, own.getField(c)).alias(c) for c in documents.columns))
