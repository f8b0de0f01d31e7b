"""Queries of the skew operator (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import skew
from latticework.sources.tables import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities and root nodes, one row per id (repeated rows are complete copies)."""
    found = table(spark, d, "entity", "id", "name", "level").unionByName(table(spark, d, "entity_root", "id", "name", "level"))
    return found.groupBy("id").agg(F.min("name").alias("name"), F.min("level").alias("level"))


def _relation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relation", "source_id", "target_id", "layer", "created_at", "attributes")


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per-key results of every source_id."""
    return skew.balanced_profile(_relation(spark, d), _nodes(spark, d)).drop("shards", "share")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Source ids with at least 3 % of all rows."""
    return skew.overloaded_keys(skew.balanced_profile(_relation(spark, d), _nodes(spark, d)))


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile}

SQL = {
    "p3_found": """
        SELECT source_id FROM relation WHERE source_id IS NOT NULL
        GROUP BY source_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM relation)""",
    "p3_profile": """
        WITH nodes AS (SELECT id, min(name) AS name, min(level) AS level FROM
            (SELECT id, name, level FROM entity UNION ALL SELECT id, name, level FROM entity_root) GROUP BY id)
        SELECT r.source_id, CAST(count(*) AS BIGINT) AS n_rows, min(r.target_id) AS first_target, max(r.target_id) AS last_target,
               max(r.layer) AS max_layer, CAST(sum(CASE WHEN r.attributes.description IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS described,
               max(r.created_at) AS latest, min(n.name) AS name, min(n.level) AS level
        FROM relation r LEFT JOIN nodes n ON n.id = r.source_id WHERE r.source_id IS NOT NULL GROUP BY r.source_id""",
}
