"""A corpus pipeline of five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm import jaccard_join, language_id, mixing, secrets, sentencepiece_fst
from volpanel.llm.frames import cut, discard, held_out, stored, table
from volpanel.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised."""
    ship(spark)
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return language_id.accepted(docs, model)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that of the least id, of each group linked by five-word shingles at a similarity of 0.8.

    Rows are told apart by a 64-bit key of id and text: exact repeats of a row are one, and
    rows of equal id are each decided by their own text.
    """
    ship(spark)
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    groups = jaccard_join.linked(keyed.select(F.col("row_key").alias("doc_id"), "text"), percent=80, words=5)
    groups = groups.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key").alias("row_key"))
    first = keyed.select("row_key", "doc_id").distinct().join(groups, "row_key").groupBy("component_id").agg(F.min(order)["row_key"].alias("row_key"))
    return keyed.join(first.select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(docs.columns)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    ship(spark)
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and select documents so that the sources come near their target shares of words."""
    ship(spark)
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    ship(spark)
    return sentencepiece_fst.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("secrets", scan_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The stages learn, hash and encode beyond SQL; tests hold each of them against a brute-force version, and run() against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    discard(spark, before)
    return out
