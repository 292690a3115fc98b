"""The corpus queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from volpanel.llm.fingerprints import fingerprints
from volpanel.llm.frames import table
from volpanel.llm.hard_negatives import mined, relabelled
from volpanel.llm.jaccard_join import linked
from volpanel.llm.language_id import language_of
from volpanel.llm.licenses import licenses_of
from volpanel.llm.merkle import audited
from volpanel.llm.mixing import mixture
from volpanel.llm.mpeg_audio import media_of
from volpanel.llm.oracles import MERKLE_SQL, NEGATIVES_SQL
from volpanel.llm.run_length_index import removed_of
from volpanel.llm.secrets import secrets_of
from volpanel.llm.sentencepiece_fst import tokens_of
from volpanel.llm.toxicity import toxicity_of
from volpanel.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": lambda spark, d: secrets_of(table(spark, d, "documents")),
    "op9_language_id": lambda spark, d: language_of(table(spark, d, "documents")),
    "op10_toxicity": lambda spark, d: toxicity_of(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_source_mix": lambda spark, d: mixture(table(spark, d, "documents")),
    "op3_licenses": lambda spark, d: licenses_of(table(spark, d, "documents")),
    "op4_jaccard_join": lambda spark, d: linked(table(spark, d, "documents")),
    "op5_fingerprints": lambda spark, d: fingerprints(table(spark, d, "documents")),
    "op6_sentencepiece": lambda spark, d: tokens_of(table(spark, d, "documents")),
    "op7_mpeg_audio": lambda spark, d: media_of(table(spark, d, "documents")),
    "op8_warc": lambda spark, d: round_trip(table(spark, d, "pages")),
    "op11_merkle": lambda spark, d: audited(table(spark, d, "documents")),
    "op13_run_length_dedup": lambda spark, d: removed_of(table(spark, d, "documents")),
    "op12_hard_negatives": lambda spark, d: mined(relabelled(table(spark, d, "embeddings"))),
}

MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    greatest(coalesce(length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) / greatest(length(text), 1), 0.0), 0.25)::DOUBLE AS weight,
    (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS position,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT *, (SELECT arg_min(level, position) FROM l WHERE NOT level * weight > 3 * source_size) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE coalesce(final, 0.0) * weight END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, floor(g.target)::BIGINT - g.epochs * g.source_size AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, epochs, (epochs * size + least(size, greatest(budget - before, 0)))::BIGINT AS taken FROM k
"""

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::INTEGER) AS q FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(q, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS intact
FROM k
"""

ORACLES: dict[str, str] = {"op2_source_mix": MIX_SQL, "op8_warc": WARC_SQL, "op11_merkle": MERKLE_SQL, "op12_hard_negatives": NEGATIVES_SQL}
