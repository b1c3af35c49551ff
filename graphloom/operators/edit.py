"""Graph edits. Frames are immutable, so every edit returns a new version of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.graph import Graph
from graphloom.operators.subgraph import induced_edges

# Fixed value: versions an editor keeps for undo.
HISTORY_LIMIT = 50


def delete_entity(graph: Graph, entity_id: str) -> Graph:
    """Remove an entity together with its incident edges."""
    return Graph(
        graph.entities.filter(F.col("id") != entity_id),
        graph.relationships.filter((F.col("source_id") != entity_id) & (F.col("target_id") != entity_id)),
    )


def delete_entities(graph: Graph, ids: DataFrame) -> Graph:
    """Remove many entities (column ``id``) and their edges with anti joins."""
    edges = graph.relationships
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(graph.entities.join(ids, "id", "left_anti"), edges)


def delete_relationship(graph: Graph, source_id, target_id, relationship_type: str) -> Graph:
    """Remove all parallel edges with this key. Ids may be literals or scalar subqueries."""
    same = (
        (F.col("source_id") == source_id) & (F.col("target_id") == target_id) & (F.col("type") == relationship_type)
    )
    return Graph(graph.entities, graph.relationships.filter(~same))


def add_relationships_checked(graph: Graph, rows: DataFrame) -> Graph:
    """Append edges whose ends both exist and differ; the others are ignored."""
    valid = induced_edges(rows.filter("source_id <> target_id"), graph.entities.select("id"))
    return graph.add_relationships(valid)


def rename_entity(graph: Graph, old_id: str, new_id: str) -> Graph:
    """Change an id. A self-loop has only its source rewritten, as in the editor."""
    renamed = graph.entities.withColumn(
        "id", F.when(F.col("id") == old_id, F.lit(new_id)).otherwise(F.col("id"))
    )
    is_source = F.col("source_id") == old_id
    edges = graph.relationships.select(
        *[c for c in graph.relationships.columns if c not in ("source_id", "target_id")],
        F.when(is_source, F.lit(new_id)).otherwise(F.col("source_id")).alias("source_id"),
        F.when(~is_source & (F.col("target_id") == old_id), F.lit(new_id)).otherwise(F.col("target_id")).alias("target_id"),
    ).select(*graph.relationships.columns)
    return Graph(renamed, edges)


def unused_id(entities: DataFrame, base: str = "new-entity") -> str:
    """``base``, or the first of ``base-1``, ``base-2``, … that no entity has."""
    number = F.regexp_extract("id", r"-(\d{1,9})$", 1)
    canonical = F.col("id") == F.concat(F.lit(base + "-"), number.cast("int").cast("string"))
    taken = (
        entities.filter((F.col("id") == base) | (F.col("id").startswith(base + "-") & canonical))
        .select(F.when(F.col("id") == base, 0).otherwise(number.cast("int")).alias("n"))
        .distinct()
    )
    free = taken.select((F.col("n") + 1).alias("n")).join(taken, "n", "left_anti")
    base_used, first_free = taken.select(F.bool_or(F.col("n") == 0)).scalar(), free.select(F.min("n")).scalar()
    used, number = entities.sparkSession.range(1).select(base_used, first_free).first()
    return f"{base}-{number}" if used else base


class History:
    """Undo/redo over graph versions; a version is only a pair of logical plans."""

    def __init__(self, graph: Graph, limit: int = HISTORY_LIMIT):
        self.current, self._limit = graph, limit
        self._undo: list[Graph] = []
        self._redo: list[Graph] = []

    def apply(self, graph: Graph) -> Graph:
        self._undo = (self._undo + [self.current])[-self._limit:]
        self._redo.clear()
        self.current = graph
        return graph

    def undo(self) -> Graph:
        if self._undo:
            self._redo.append(self.current)
            self.current = self._undo.pop()
        return self.current

    def redo(self) -> Graph:
        if self._redo:
            self._undo.append(self.current)
            self.current = self._redo.pop()
        return self.current
