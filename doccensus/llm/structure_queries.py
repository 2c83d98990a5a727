"""Queries of the conversation trie, the page archive and embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccensus.llm import archive, prefix_trie, whitening

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


#: conversations of one family, and the number of possible lengths of a graft
FAMILY, GRAFTS = 5, 9


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    turns = prefix_trie.numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(prefix_trie.graft(turns, conv - conv % FAMILY, F.crc32(conv.cast("string").cast("binary")) % GRAFTS, GRAFTS - 1))


def op12_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = archive.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive.summary(spark, made).select(
        F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES |= {"op11_prefix_trie": op11_prefix_trie, "op12_archive": op12_archive, "op13_whitening": op13_whitening}

# the CRC is folded bit by bit; subtrees are sums over the ancestors of every node, which are prefixes of its smallest member
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""
_TOLD = "sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))"
ORACLE["op11_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, {_TOLD} AS told, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TOLD}) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, CAST({_CRC} % {GRAFTS} AS BIGINT) AS head FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS src, pos, told, size FROM c JOIN turns t ON t.conv_id = c.base AND pos <= head
  UNION ALL SELECT c.conv_id, 1, pos, told, size FROM c JOIN turns t ON t.conv_id = c.conv_id AND pos > head),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY src, pos) AS depth, size,
    string_agg(told, ',') OVER (PARTITION BY conv_id ORDER BY src, pos) AS node FROM parts
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
paths AS (
  SELECT conv_id, depth, size, node, lag(node) OVER w AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(size) AS size, max(parent) AS parent,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)),
sums AS (
  SELECT p.node, sum(w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved_tokens, count(*) AS n_nodes
  FROM whole w JOIN paths p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  w.ends_sha256, n_nodes
FROM whole w JOIN sums USING (node) LEFT JOIN nodes u ON u.node = w.parent
"""

ORACLE["op12_archive"] = f"""
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, size >= {archive.MIN_SHARED} AND page_id IS DISTINCT FROM first AS again FROM (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""
