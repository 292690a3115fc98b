"""Merkle manifest of a table of documents: a tree for each source, and one over the sources.

Levels are built by windows: rows are dealt by (group, block of 3 ** HEIGHT nodes), and each
level is a window by group and parent index, whose ordered full-frame ``collect_list`` gives
a parent's preimage and, to each of its leaves, the siblings.  Of all leaves below a child
only the first lends it to the list, so a child is hashed once a level; one row a block goes
on to the next exchange.  A source with most of the rows is many blocks, and no task holds
more of a group than the rows of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.frames import cut, discard, numbered, stored

ARITY = 3
HEIGHT = 6  # levels between two exchanges
SPAN = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes ahead, which keeps neighbouring fields apart; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """Digest of the fields of a document, some of them changed."""
    return digest(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def _levels(nodes: DataFrame, below: int) -> DataFrame:
    """HEIGHT levels over ``nodes`` (gid, idx, n, digest, ...), which stand ``below`` levels above the leaves.

    ``n`` counts the leaves of the group.  Adds the block of a node, ``top``, the digest of
    that block, and ``path``: for each level what stands before and after the node's
    ancestor in its run.
    """
    rows = nodes.withColumn("block", F.expr(f"idx div {SPAN}")).repartition("gid", "block").withColumn("top", F.col("digest"))
    steps = []
    for j in range(HEIGHT):
        width = ARITY**j
        frame = Window.partitionBy("gid", "block", F.expr(f"idx div {width * ARITY}")).orderBy("idx").rowsBetween(*WHOLE)
        rows = rows.withColumn("run", F.collect_list(F.when(F.col("idx") % width == 0, F.col("top"))).over(frame))
        own = F.expr(f"cast(idx div {width} % {ARITY} as int)")
        real = F.col("n") > ARITY ** (below + j)  # several nodes were left
        before, after = F.slice("run", F.lit(1), own), F.slice("run", own + 2, F.lit(ARITY))
        step = F.when(real, F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
        rows = rows.withColumn(f"step{j}", step).withColumn("top", F.when(real, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("top"))).drop("run")
        steps.append(f"step{j}")
    return rows.withColumn("path", F.array_compact(F.array(*steps))).drop(*steps)


def ascend(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """The nodes of each pass, the digest of each group (gid, top), and the paths of the tables made."""
    deepest = nodes.agg(F.max("n")).first()[0] or 0
    passes, made = [nodes], []
    while deepest > SPAN ** len(passes):
        rows = _levels(passes[-1], HEIGHT * (len(passes) - 1)).where(F.col("idx") % SPAN == 0)
        roots, path = stored(rows.select("gid", F.col("block").alias("idx"), "n", F.col("top").alias("digest")))
        passes.append(roots)
        made.append(path)
    tops = _levels(passes[-1], HEIGHT * (len(passes) - 1)).where("idx = 0").select("gid", "top")
    return passes, tops, made


def descend(passes: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The rows of the first pass, each with its whole ``path`` and the columns of ``crown`` (gid, up, ...).

    What stands above is joined by (group, block): by the group alone only where that is one block.
    """
    above, keys = crown, ["gid"]
    for depth in reversed(range(len(passes))):
        rows = _levels(passes[depth], HEIGHT * depth).drop("top")
        met = rows.join(above, keys).withColumn("path", F.concat("path", "up")).drop("up", "block", "digest", "n")
        above, keys = met.withColumnsRenamed({"idx": "block", "path": "up"}), ["gid", "block"]
    return met


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, subroot, root, proof and check of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    A group is a source (null is one, the first); its leaves ascend by doc_id, null ids
    first and ties by digest.  ``tampered`` is the text that is found when a proof is checked;
    rows where it is null, or is not given, are checked with their own.  Returns doc_id,
    leaf, subroot, root, proof_sha256, folded_root, verified.  Repeated rows are leaves of
    their own; an empty table has no root and gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    found = F.lit(None).cast("string") if tampered is None else tampered
    rows = rows.withColumn("leaf", leaf()).withColumn("found", F.when(found != F.col("text"), leaf(text=found)))
    thin, thin_path = stored(rows.select("doc_id", "source", F.col("leaf").alias("digest"), "found"))
    leaves, leaves_path = numbered(thin, "source", ["doc_id", "digest"])
    discard(spark, thin_path)
    passes, subroots, made = ascend(leaves)
    sources, sources_path = numbered(subroots.select(F.lit(0).alias("all"), F.col("gid").alias("of"), F.col("top").alias("digest")), "all", ["of"])
    source_passes, roots, more = ascend(sources)
    none = F.array().cast("array<struct<before:string,after:string>>")
    crowns = descend([source_passes[0].withColumn("subroot", F.col("digest")), *source_passes[1:]], roots.select("gid", none.alias("up"), F.col("top").alias("root")))
    crowns, crowns_path = stored(crowns.select(F.col("of").alias("gid"), F.col("path").alias("up"), "subroot", "root"))
    proved = descend([passes[0].withColumn("leaf", F.col("digest")), *passes[1:]], crowns)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("found", "leaf"), lambda node, s: digest(s["before"], node, s["after"]))
    out = proved.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    out = cut(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    for path in (leaves_path, sources_path, crowns_path, *made, *more):
        discard(spark, path)
    return out


def without_lines() -> Column:
    """The texts of half of the ids, told by their checksum, without line ends: what a careless export does."""
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(half & F.col("text").contains("\n"), F.replace("text", F.lit("\n"), F.lit("")))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked against texts of which some have lost their line ends."""
    return manifest(docs, without_lines())
