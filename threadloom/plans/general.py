"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import forest, references
from threadloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = references.orphan_references(table(spark, sf_dir, "twcs"), table(spark, sf_dir, "tweet_deletions"))
    return found.select(F.col("tweet_id").cast("string").alias("tweet_id"), "ref_field", F.col("ref_tweet_id").cast("string").alias("ref_tweet_id"), "ref_state")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_counts(table(spark, sf_dir, "twcs"), table(spark, sf_dir, "tweet_deletions"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = forest.hierarchy(forest.reply_links(table(spark, sf_dir, "twcs")))
    return tree.select(F.col("id").cast("string").alias("tweet_id"), F.col("root").cast("string").alias("root_tweet_id"), "depth")


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = forest.hierarchy(forest.reply_links(table(spark, sf_dir, "twcs")), paths=True)
    return tree.select(F.col("id").cast("string").alias("tweet_id"), F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = forest.descendants(forest.hierarchy(forest.reply_links(table(spark, sf_dir, "twcs")), paths=True))
    return below.select(F.col("id").cast("string").alias("tweet_id"), F.col("descendant").cast("string").alias("descendant_id"), "distance")


_ID = r"try_cast(regexp_extract({0}, '^\s*(\d{{1,19}})(\.\d*)?\s*$', 1) AS BIGINT)"
_MADE = r"""coalesce(try_cast(CASE WHEN regexp_matches(created_at, '^\s*\d{4}-\d\d-\d\d') THEN created_at END AS TIMESTAMPTZ), try_strptime(substr(trim(created_at), 5), '%b %d %H:%M:%S %z %Y'))"""

_REFS = rf"""
WITH raw AS (SELECT {_ID.format('tweet_id')} AS id, {_ID.format('in_response_to_tweet_id')} AS up, response_tweet_id AS lst, ingested_at AS arrived, {_MADE} AS made FROM twcs),
t AS (SELECT id, min(arrived) AS arrived, min(made) AS made FROM raw WHERE id IS NOT NULL GROUP BY id),
r AS (
  SELECT DISTINCT id, 'in_response_to_tweet_id' AS field, up AS key FROM raw WHERE id IS NOT NULL AND up IS NOT NULL
  UNION
  SELECT id, 'response_tweet_id', {_ID.format('m')} FROM (SELECT id, unnest(string_split(lst, ',')) AS m FROM raw WHERE id IS NOT NULL) WHERE {_ID.format('m')} IS NOT NULL),
d AS (SELECT DISTINCT {_ID.format('tweet_id')} AS id FROM tweet_deletions),
f AS (
  SELECT r.id, r.field, r.key, s.made,
    CASE WHEN d.id IS NOT NULL THEN 'deleted' WHEN p.id IS NULL THEN 'missing' WHEN r.field = 'in_response_to_tweet_id' AND p.arrived > s.arrived THEN 'late' END AS state
  FROM r JOIN t s ON s.id = r.id LEFT JOIN t p ON p.id = r.key LEFT JOIN d ON d.id = r.key)
"""
_LINKS = rf"""
WITH RECURSIVE raw AS (SELECT {_ID.format('tweet_id')} AS id, {_ID.format('in_response_to_tweet_id')} AS up, response_tweet_id AS lst FROM twcs),
l AS (SELECT {_ID.format('m')} AS id, min(id) AS lister FROM (SELECT id, unnest(string_split(lst, ',')) AS m FROM raw WHERE id IS NOT NULL) GROUP BY 1),
n AS (SELECT raw.id, coalesce(min(up), min(l.lister)) AS parent FROM raw LEFT JOIN l ON l.id = raw.id WHERE raw.id IS NOT NULL GROUP BY raw.id),
e AS (SELECT n.id, p.id AS parent FROM n LEFT JOIN n p ON p.id = n.parent),
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}

ORACLES = {
    "p2_found": _REFS + "SELECT CAST(id AS VARCHAR) AS tweet_id, field AS ref_field, CAST(key AS VARCHAR) AS ref_tweet_id, state AS ref_state FROM f WHERE state IS NOT NULL",
    "p2_counts": _REFS + "SELECT field AS ref_field, state AS ref_state, strftime(made AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM f WHERE state IS NOT NULL GROUP BY ALL",
    "p6_found": _LINKS
    + """w AS (SELECT id, id AS root, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, w.root, w.depth + 1 FROM e JOIN w ON e.parent = w.id),
c AS (SELECT id, parent AS cur FROM e WHERE id NOT IN (SELECT id FROM w) UNION SELECT c.id, e.parent FROM c JOIN e ON e.id = c.cur),
o AS (SELECT id FROM c WHERE id = cur)
SELECT CAST(id AS VARCHAR) AS tweet_id, CAST(root AS VARCHAR) AS root_tweet_id, CAST(depth AS INT) AS depth FROM w
UNION ALL SELECT CAST(c.id AS VARCHAR), CAST(min(c.cur) AS VARCHAR), CAST(-1 AS INT) FROM c JOIN o ON o.id = c.cur GROUP BY c.id""",
    "p6_paths": _LINKS
    + """w AS (SELECT id, CAST(id AS VARCHAR) AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, w.path || '/' || CAST(e.id AS VARCHAR) FROM e JOIN w ON e.parent = w.id)
SELECT CAST(id AS VARCHAR) AS tweet_id, path FROM w UNION ALL SELECT CAST(id AS VARCHAR), CAST(id AS VARCHAR) FROM e WHERE id NOT IN (SELECT id FROM w)""",
    "p6_descendants": _LINKS
    + """w AS (SELECT id FROM e WHERE parent IS NULL UNION ALL SELECT e.id FROM e JOIN w ON e.parent = w.id),
a AS (SELECT e.parent AS id, e.id AS below, 1 AS distance FROM e WHERE e.id IN (SELECT id FROM w) AND e.parent IS NOT NULL UNION ALL SELECT e.parent, a.below, a.distance + 1 FROM a JOIN e ON e.id = a.id WHERE e.parent IS NOT NULL)
SELECT CAST(id AS VARCHAR) AS tweet_id, CAST(below AS VARCHAR) AS descendant_id, CAST(distance AS INT) AS distance FROM a""",
}
