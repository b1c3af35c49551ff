"""Change impact: who depends on an entity, and how risky changing it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.traverse import callers, within_hops
from graphloom.session import materialize

# Thresholds of the two risk ratings.
HIGH_REACH, MEDIUM_REACH = 20, 10
MANY_FILES, SOME_FILES = 5, 3
HIGH_SCORE, MEDIUM_SCORE = 5, 3


def reach_risk(total: Column, files: Column) -> Column:
    """Rating by reach; five or more files raise LOW to MEDIUM."""
    by_reach = F.when(total >= HIGH_REACH, "HIGH").when(total >= MEDIUM_REACH, "MEDIUM").otherwise("LOW")
    return F.when((by_reach == "LOW") & (files >= MANY_FILES), "MEDIUM").otherwise(by_reach)


def score_risk(total: Column, files: Column) -> Column:
    """Rating by a score of reach and files; nothing affected is LOW."""
    reach = F.when(total >= HIGH_REACH, 3).when(total >= MEDIUM_REACH, 2).otherwise(1)
    spread = F.when(files >= MANY_FILES, 2).when(files >= SOME_FILES, 1).otherwise(0)
    score = reach + spread
    return F.when(total == 0, "LOW").when(score >= HIGH_SCORE, "HIGH").when(score >= MEDIUM_SCORE, "MEDIUM").otherwise("LOW")


def impact(graph, entity_id: str, depth: int = 2, types: tuple[str, ...] = ("CALLS",), direction: str = "outgoing") -> DataFrame:
    """One row: direct calls, transitive callers, files along the entity's own calls, risk.

    ``direction="incoming"`` counts the callers' files instead.
    """
    tree = callers(graph, entity_id, depth, types)
    counts = tree.agg(
        F.count_if(F.col("depth") == 1).alias("direct_callers"),
        F.count_if(F.col("depth") > 1).alias("transitive_callers"),
    )
    reached = within_hops(graph.relationships, graph.spark, [entity_id], depth, direction, list(types))
    files = graph.entities.join(reached.select("id"), "id", "left_semi").agg(F.count_distinct("file_path")).scalar()
    total = F.col("direct_callers") + F.col("transitive_callers")
    return (
        counts.withColumn("files_affected", files)
        .withColumn("total_affected", total)
        .withColumn("risk_level", reach_risk(F.col("total_affected"), F.col("files_affected")))
    )


def affected_callers(graph, entity_id: str, depth: int = 2, include_direct: bool = False, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """Ids found as callers of callers, up to ``depth``.

    Direct callers belong to it only when reached again, or with ``include_direct``.
    """
    nodes = materialize(
        callers(graph, entity_id, depth, types).groupBy(F.col("caller").alias("id")).agg(F.min("depth").alias("depth"))
    )
    calls = graph.relationships.filter(F.col("type").isin(*types))
    again = calls.join(
        nodes.filter(F.col("depth") < depth).select(F.col("id").alias("target_id")), "target_id", "left_semi"
    ).select(F.col("source_id").alias("id"))
    if include_direct:
        again = again.unionByName(nodes.filter("depth = 1").select("id"))
    return again.distinct()


def impact_assessment(graph, affected: DataFrame) -> DataFrame:
    """One row: affected entities, their files, test files among these, score-based risk."""
    files = graph.entities.join(affected, "id", "left_semi").select("file_path").distinct()
    total = affected.agg(F.count(F.lit(1))).scalar()
    return files.agg(
        F.count(F.lit(1)).alias("files_affected"),
        F.count_if(F.contains(F.lower("file_path"), F.lit("test"))).alias("test_files"),
    ).select(
        total.alias("total_affected"), "files_affected", "test_files",
        score_risk(total, F.col("files_affected")).alias("risk_level"),
    )
