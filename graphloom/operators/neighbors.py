"""Neighbour lookups: one filtered scan per direction, joined to entities for details."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.names import last_segment
from graphloom.schema import check_relationship_types

DIRECTIONS = ("outgoing", "incoming", "both")
# Fixed value: type reported for a neighbour that is not an entity of the graph.
UNKNOWN_TYPE = "EXTERNAL"


def of_types(relationships: DataFrame, types: list[str] | None) -> DataFrame:
    if types is None:
        return relationships
    return relationships.filter(F.col("type").isin(*check_relationship_types(types)))


def neighbors(
    relationships: DataFrame, entity_id: str, direction: str = "both", types: list[str] | None = None
) -> DataFrame:
    """Edges at an entity as (direction, relationship_type, neighbor_id), duplicates kept.

    Outgoing rows sort before incoming ones; an unknown direction gives no rows.
    """
    edges = of_types(relationships, types)
    end = {
        "outgoing": F.col("source_id") == entity_id,
        "incoming": F.col("target_id") == entity_id,
    }

    def side(label: str, other: str) -> DataFrame:
        wanted = end[label] if direction in (label, "both") else F.lit(False)
        return edges.filter(wanted).select(
            F.lit(label).alias("direction"),
            F.col("type").alias("relationship_type"),
            F.col(other).alias("neighbor_id"),
            "ord",
            "line_number",
        )

    return side("outgoing", "target_id").unionByName(side("incoming", "source_id"))


def distinct_neighbors(
    graph, entity_id: str, direction: str = "both", types: list[str] | None = None,
    max_results: int | None = 20, label_by_any_edge: bool = False,
) -> DataFrame:
    """One row per (neighbour, relationship type), first seen first, with entity details.

    ``label_by_any_edge`` calls a neighbour outgoing as soon as any edge leads to it, whichever
    edge produced the row.
    """
    rows = neighbors(graph.relationships, entity_id, direction, types)
    first = rows.groupBy("neighbor_id", "relationship_type").agg(
        F.min(F.struct(F.col("direction") == "incoming", F.col("ord"))).alias("seen")
    )
    first = first.select(
        "neighbor_id", "relationship_type",
        F.col("seen.col1").alias("is_incoming"), F.col("seen.ord").alias("ord"),
    )
    if label_by_any_edge:
        out = (
            graph.relationships.filter(F.col("source_id") == entity_id)
            .select(F.col("target_id").alias("neighbor_id"), F.lit(True).alias("has_out"))
            .distinct()
        )
        first = first.join(out, "neighbor_id", "left")
        incoming = F.col("has_out").isNull()
    else:
        incoming = F.col("is_incoming")
    first = first.withColumn("direction", F.when(incoming, "incoming").otherwise("outgoing"))
    if max_results is not None:
        first = first.orderBy("is_incoming", "ord", "neighbor_id", "relationship_type").limit(max_results)
    details = graph.entities.select(
        F.col("id").alias("neighbor_id"), "name", "type", "file_path"
    )
    return first.join(details, "neighbor_id", "left").select(
        "is_incoming", "ord", "relationship_type", "direction",
        F.col("neighbor_id").alias("entity_id"),
        F.coalesce("name", last_segment(F.col("neighbor_id"))).alias("name"),
        F.coalesce("type", F.lit(UNKNOWN_TYPE)).alias("type"),
        "file_path",
    )


def direct_callers(relationships: DataFrame, entity_id: str, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """Callers with one row per call; pass CALLS_RESOLVED too for graphs with bare-name calls."""
    return relationships.filter((F.col("target_id") == entity_id) & F.col("type").isin(*types)).select(
        F.col("source_id").alias("caller"), F.col("type").alias("relationship_type"), "ord", "line_number"
    )


def distinct_neighbor_ids(relationships: DataFrame, entity_id: str) -> DataFrame:
    """Distinct neighbour ids per direction."""
    return neighbors(relationships, entity_id).select("direction", "neighbor_id").distinct()


def connections(graph, entity_id: str) -> DataFrame:
    """Every edge at an entity with the other end's name (its id when unknown)."""
    names = graph.entities.select(F.col("id").alias("neighbor_id"), "name")
    return (
        neighbors(graph.relationships, entity_id)
        .join(names, "neighbor_id", "left")
        .select("direction", "relationship_type", F.coalesce("name", "neighbor_id").alias("name"), "ord")
    )


def connection_counts(relationships: DataFrame, entity_id: str) -> DataFrame:
    """Incoming and outgoing edge counts, duplicates included."""
    return relationships.filter((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id)).agg(
        F.count_if(F.col("target_id") == entity_id).alias("incoming"),
        F.count_if(F.col("source_id") == entity_id).alias("outgoing"),
    )


def degrees(relationships: DataFrame) -> DataFrame:
    """In-, out- and total degree of every node.

    Each edge becomes two counted rows that are summed map-side, so one shuffle of partial sums
    serves both directions and a hub never gathers in one task.
    """
    ends = relationships.select(
        F.inline(
            F.array(
                F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return ends.groupBy("id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree")
    )


def children_counts(relationships: DataFrame) -> DataFrame:
    """Outgoing CONTAINS edges per node."""
    return (
        relationships.filter(F.col("type") == "CONTAINS")
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("children"))
    )
