"""Viewer-style filtering: keep or mark nodes and edges. Semi joins on ids throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.graph import Graph
from graphloom.operators.search import first_rows
from graphloom.schema import VIEWER_ENTITY_TYPES, VIEWER_RELATIONSHIP_TYPES


def induced_edges(edges: DataFrame, node_ids: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Edges with both ends among ``node_ids`` (one column ``id``)."""
    return edges.join(node_ids.select(F.col("id").alias(source)), source, "left_semi").join(
        node_ids.select(F.col("id").alias(target)), target, "left_semi"
    )


def connected_edges(graph: Graph, numbers: DataFrame | None = None) -> DataFrame:
    """Edges between known entities, without self-loops.

    With ``numbers`` (id, number; one row per entity) the ends are looked up there, and the edges also
    have source_number and target_number.
    """
    edges = graph.relationships.filter("source_id <> target_id")
    if numbers is None:
        return induced_edges(edges, graph.entities.select("id"))
    for end in ("source", "target"):
        edges = edges.join(numbers.select(F.col("id").alias(f"{end}_id"), F.col("number").alias(f"{end}_number")), f"{end}_id")
    return edges


def _viewer_type(column: str, known, fallback: str):
    return F.when(F.col(column).isin(*known), F.col(column)).otherwise(F.lit(fallback))


def viewer_nodes(entities: DataFrame) -> DataFrame:
    return entities.select(
        "ord", "id", "name",
        _viewer_type("type", VIEWER_ENTITY_TYPES, "VARIABLE").alias("type"),
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("line_number", F.lit(0)).alias("line_number"),
        F.coalesce(F.get_json_object("properties", "$.description"), F.lit("")).alias("docstring"),
    )


def viewer_elements(graph: Graph, node_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as the viewer shows them; ``node_limit`` is a display cap a caller may set.

    With a limit, edges are those among the kept nodes. Without one the whole graph is shown.
    """
    kept = graph.entities if node_limit is None else first_rows(graph.entities, node_limit)
    edges = connected_edges(Graph(kept, graph.relationships)).select(
        "ord",
        F.concat_ws("::", "source_id", "target_id", "type").alias("id"),
        F.col("source_id").alias("source"),
        F.col("target_id").alias("target"),
        _viewer_type("type", VIEWER_RELATIONSHIP_TYPES, "CONTAINS").alias("rel"),
        F.coalesce("line_number", F.lit(0)).alias("line_number"),
    )
    return viewer_nodes(kept), edges


def filter_by_types(
    graph: Graph, entity_types: list[str] | None = None, relationship_types: list[str] | None = None
) -> Graph:
    """Entities of the given types and edges among them of the given types; empty means all."""
    entities = graph.entities.filter(F.col("type").isin(*entity_types)) if entity_types else graph.entities
    edges = graph.relationships
    if relationship_types:
        edges = edges.filter(F.col("type").isin(*relationship_types))
    return Graph(entities, induced_edges(edges, entities.select("id")))


def dim_flags(graph: Graph, shown_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mark instead of remove: nodes of other types, and edges that touch one."""
    nodes = graph.entities.select("id", "type", (~F.col("type").isin(*shown_types)).alias("dimmed"))
    source = nodes.select(F.col("id").alias("source_id"), F.col("dimmed").alias("source_dimmed"))
    target = nodes.select(F.col("id").alias("target_id"), F.col("dimmed").alias("target_dimmed"))
    edges = (
        connected_edges(graph)
        .join(source, "source_id")
        .join(target, "target_id")
        .select("source_id", "target_id", "type", (F.col("source_dimmed") | F.col("target_dimmed")).alias("dimmed"))
    )
    return nodes, edges


def focus(graph: Graph, node_id: str, depth: int = 1, direction: str = "both") -> Graph:
    """The part of the graph within ``depth`` hops; edges to unknown ids play no role."""
    from graphloom.operators.traverse import known_within_hops

    reached = known_within_hops(graph, node_id, depth, direction).select("id")
    return Graph(graph.entities.join(reached, "id", "left_semi"), induced_edges(graph.relationships, reached))


def connected_or_loop_edges(graph: Graph) -> DataFrame:
    return induced_edges(graph.relationships, graph.entities.select("id"))


def focus_stats(graph: Graph, node_id: str, depth: int = 1, direction: str = "both") -> DataFrame:
    """Totals against the visible part, and the focused node's distinct neighbours."""
    edges = connected_or_loop_edges(graph).select("source_id", "target_id")
    part = focus(graph, node_id, depth, direction)

    def count(df):
        return df.agg(F.count(F.lit(1))).scalar()

    return edges.agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.count_distinct(F.when(F.col("target_id") == node_id, F.col("source_id"))).alias("in_neighbors"),
        F.count_distinct(F.when(F.col("source_id") == node_id, F.col("target_id"))).alias("out_neighbors"),
    ).select(
        count(graph.entities).alias("total_nodes"),
        "total_edges",
        count(part.entities).alias("visible_nodes"),
        count(part.relationships).alias("visible_edges"),
        "in_neighbors",
        "out_neighbors",
    )
