"""The manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from volpanel.llm import merkle
from volpanel.llm.frames import discard, numbered

from .conftest import SCHEMA


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, **changed):
    values = [changed.get(n, row[n]) for n in merkle.FIELDS]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and for each leaf what stands before and after its ancestors."""
    nodes, paths = [(h, [i]) for i, h in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for at, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(h for h, _ in run[:at]), "".join(h for h, _ in run[at + 1 :])))
            above.append((digest(*(h for h, _ in run)), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
    trees = {name: tree([x[2] for x in groups[name]]) for name in names}
    root, tops = tree([trees[name][0] for name in names]) if names else (None, [])
    out = []
    for name, top in zip(names, tops, strict=True):
        for (_, _, h, r), path in zip(groups[name], trees[name][1], strict=True):
            node, path = h, path + top
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                node = leaf(r, text=r["text"].replace("\n", ""))
            for before, after in path:
                node = digest(before, node, after)
            out.append((r["doc_id"], h, trees[name][0], root, digest(*(b + a for b, a in path)), node, node == root))
    return sorted(map(repr, out))


def check(df):
    got = merkle.audited(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute([r.asDict() for r in df.select(*merkle.FIELDS).collect()])


def test_manifest_with_nulls_repeats_and_one_source_of_several_blocks(spark, docs):
    many = spark.range(1600).select(F.col("id").alias("doc_id"), F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"), F.col("id").alias("n_chars"))
    null_ids = spark.createDataFrame([(None, f"n{i}\n", None, None, None) for i in range(5)], SCHEMA)
    check(docs.unionByName(many).unionByName(null_ids))


@pytest.mark.parametrize("n", [1, 3, 4])
def test_small_trees(spark, n):
    check(spark.createDataFrame([(i, "a\nb", None, "s", None) for i in range(n)], SCHEMA))


def test_an_empty_table_and_clashing_columns(spark, docs, empty):
    assert merkle.audited(empty).count() == 0
    check(docs.select("*", F.lit(1).alias("leaf"), F.lit(2).alias("gid"), F.lit("x").alias("root"), F.lit(3).alias("idx")))


def test_verified_fails_only_where_line_ends_went(spark, docs):
    rows = merkle.manifest(docs, F.when(F.col("doc_id") == 5, F.concat("text", F.lit("!")))).collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == {5}


def test_ranks_run_on_over_ranges_and_extreme_ids(spark):
    ids = [-(2**62) - 5, 2**62 + 5, *range(300), None, None]
    df = spark.createDataFrame([(i, "g" if (i or 0) % 3 else None) for i in ids], "doc_id long, g string").repartition(7)
    rows, path = numbered(df, "g", ["doc_id"])
    found = rows.collect()
    discard(spark, path)
    for group in (None, "g"):
        own = sorted((r for r in found if r["g"] == group), key=lambda r: r["idx"])
        assert [r["idx"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
        assert [r["doc_id"] for r in own] == sorted((r["doc_id"] for r in own), key=lambda i: (i is not None, i or 0))
    assert max(r["gid"] for r in found if r["g"] is None) < min(r["gid"] for r in found if r["g"] == "g")
