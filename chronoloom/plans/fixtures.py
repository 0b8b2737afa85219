"""Commit-history tables derived from the given tables by SQL that both engines run ({name}: a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = """WITH b AS (SELECT user_id AS repo_id, event_id, event_type, ts AS author_date,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM {events}),
g AS (SELECT *, seq % 10 AS p, max(seq) OVER (PARTITION BY repo_id) - seq AS log_pos FROM b),
s AS (SELECT repo_id, seq, sha1('c' || CAST(event_id AS STRING)) AS sha FROM b)
SELECT g.repo_id, g.seq, g.log_pos, g.p, c.sha, q0.sha AS parent0, q1.sha AS parent1,
  g.event_type || ': ' || CAST(g.event_id AS STRING) AS message, g.author_date
FROM g JOIN s c ON c.repo_id = g.repo_id AND c.seq = g.seq
LEFT JOIN s q0 ON q0.repo_id = g.repo_id AND q0.seq = g.seq - CASE g.p WHEN 5 THEN 3 WHEN 9 THEN 2 ELSE 1 END
LEFT JOIN s q1 ON q1.repo_id = g.repo_id AND g.p = 6 AND q1.seq = g.seq - 2"""

FILES = """WITH f AS (SELECT l_suppkey AS change_id, CASE l_partkey % 8
  WHEN 0 THEN 'packages/' || lower(p_type) || '/src/f' || CAST(l_partkey % 50 AS STRING) || '.ts'
  WHEN 1 THEN 'packages/' || lower(p_type) || '/test/f' || CAST(l_partkey % 50 AS STRING) || '.test.ts'
  WHEN 2 THEN 'apps/' || replace(p_brand, '#', '') || '/routes/r' || CAST(l_linenumber AS STRING) || '.ts'
  WHEN 3 THEN 'src/' || lower(p_type) || '/f' || CAST(l_partkey AS STRING) || '.ts'
  WHEN 4 THEN 'src/index' || CAST(l_partkey % 10 AS STRING) || '.ts'
  WHEN 5 THEN 'README' || CAST(l_partkey % 10 AS STRING) || '.md'
  WHEN 6 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'pnpm-lock.yaml' ELSE 'assets/logo' || CAST(l_linenumber AS STRING) || '.PNG' END
  ELSE 'packages/top' || CAST(l_partkey % 10 AS STRING) || '.ts' END AS path,
  CAST(floor(l_quantity) AS BIGINT) AS t FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
h AS (SELECT change_id, path, CAST(sum(t) AS BIGINT) AS tokens FROM f GROUP BY change_id, path)
SELECT *, CAST(row_number() OVER (PARTITION BY change_id ORDER BY path) AS INT) AS file_ord FROM h"""

STEPS = """SELECT o_custkey AS repo_id, o_orderkey AS event_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS step_no,
  CASE WHEN o_orderkey % 10 < 7 THEN 'trunk' WHEN o_orderkey % 10 < 9 THEN 'branch' ELSE 'dead-end' END AS segment_type,
  sha1('o' || CAST(o_orderkey AS STRING)) AS original_sha, sha1('d' || CAST(o_orderkey AS STRING)) AS derived_sha,
  CASE WHEN o_orderkey % 10 = 0 THEN 'opus' ELSE 'sonnet' END AS model,
  CAST(floor(o_totalprice) AS BIGINT) AS diff_tokens, o_orderdate AS ts FROM {orders}"""

SOURCES = """SELECT source AS repo_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS file_ord,
  lang || '/doc' || CAST(doc_id AS STRING) || '.md' AS path, text AS content, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM {documents} WHERE text IS NOT NULL"""

CHANGELOGS = """SELECT conv_id, turn, '
## ' || CASE WHEN turn % 4 = 3 THEN 'notes' ELSE substr(sha1(CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)), 1, 8) END || '
' || replace(text, '#', '') AS entry, turn % 2 = 0 OR turn % 3 = 0 AS on_trunk FROM {conversations} WHERE text IS NOT NULL"""

RESPONSES = """SELECT conv_id, CAST(turn AS INT) AS attempt, CASE turn % 5
  WHEN 1 THEN '{{"structured_output":{{"spec":"s' || CAST(conv_id AS STRING) || '","changelog":"c","commitMessage":"m"}},"total_cost_usd":0.25,"session_id":"x"}}'
  WHEN 2 THEN '{{"result":"{{\\\\"spec\\\\":\\\\"t\\\\",\\\\"changelog\\\\":\\\\"c\\\\",\\\\"commitMessage\\\\":\\\\"m\\\\"}}","cost_usd":0.5}}'
  WHEN 0 THEN '{{not json'
  WHEN 3 THEN '{{"is_error":true,"result":"no"}}'
  ELSE '{{"structured_output":{{"spec":"","changelog":"c","commitMessage":"m"}}}}' END AS raw FROM {conversations}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("events", "lineitem", "part", "orders", "documents", "conversations") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, COMMITS)
    return rows.withColumn("parents", F.array_compact(F.array("parent0", "parent1"))).drop("parent0", "parent1")


def refs(rows: DataFrame) -> DataFrame:
    """The tip of each repository's main line."""
    return rows.where("p NOT IN (3, 4, 8)").groupBy("repo_id").agg(F.max_by("sha", "seq").alias("sha"))
