"""Queries of the delivery de-duplication (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.common import read
from siftline.operators.delivery_dedup import BLOCK_BITS, fold

BATCHES = 2


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that repeat the Message-ID of one with a smaller msg_id."""
    return fold(read(spark, sf_dir, "messages"), BATCHES).duplicates.select(F.col("delivery_id").alias("msg_id"))


def p3_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after the whole table in two batches: per producer the disjoint ranges, and the numbers in them."""
    ranges = fold(read(spark, sf_dir, "messages"), BATCHES).seen.ranges
    return ranges.groupBy("producer").agg(F.count("*").alias("n_ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_numbers"))


P3_SQL = r"""
WITH a AS (SELECT msg_id, trim(regexp_replace(message_id, '\s+', ' ', 'g')) AS s FROM messages),
b AS (SELECT msg_id, CASE WHEN contains(s, '<') THEN regexp_extract(s, '<([^>]*)', 1) ELSE split_part(s, ' ', 1) END AS s FROM a),
c AS (SELECT msg_id, regexp_replace(s, '[\s<>]+', '', 'g') AS s FROM b),
d AS (SELECT msg_id, regexp_replace(s, '@[^@]*$', '') || lower(regexp_extract(s, '(@[^@]*)$', 1)) AS ident FROM c WHERE s <> '')
"""

_HEX = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(lower(digits), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::HUGEINT)), lambda a, c: a * 16 + c)"
_SEEN_SQL = rf"""{P3_SQL},
e AS (SELECT DISTINCT regexp_extract(ident, '(@[^@]*)$', 1) AS host, string_split_regex(regexp_replace(ident, '@[^@]*$', ''), '[.\-=_+]') AS f FROM d),
g AS (SELECT host, list_max(list_filter(list_transform(f, lambda x, k: {{'size': length(x), 'at': k, 'digits': x}}), lambda y: regexp_full_match(y.digits, '[0-9]{{1,18}}') OR (regexp_matches(y.digits, '[0-9]') AND (regexp_full_match(y.digits, '[0-9a-f]{{1,15}}') OR regexp_full_match(y.digits, '[0-9A-F]{{1,15}}'))))).digits AS digits FROM e),
h AS (SELECT DISTINCT CASE WHEN regexp_full_match(digits, '[0-9]+') THEN 'd' WHEN regexp_full_match(digits, '[0-9a-f]+') THEN 'x' ELSE 'X' END || host AS producer, (CASE WHEN regexp_full_match(digits, '[0-9]+') THEN digits::HUGEINT ELSE {_HEX} END)::BIGINT AS seq FROM g WHERE digits IS NOT NULL),
i AS (SELECT producer, seq, seq >> {BLOCK_BITS} AS block, lag(seq) OVER (PARTITION BY producer, seq >> {BLOCK_BITS} ORDER BY seq) AS before FROM h)
SELECT producer, count(*) FILTER (before IS NULL OR before < seq - 1) AS n_ranges, count(*) AS n_numbers FROM i GROUP BY producer"""

QUERIES = {"p3_found": p3_found, "p3_seen": p3_seen}
ORACLE = {"p3_found": P3_SQL + "SELECT d.msg_id FROM d JOIN (SELECT ident, min(msg_id) AS first FROM d GROUP BY ident) f USING (ident) WHERE d.msg_id <> f.first", "p3_seen": _SEEN_SQL}
