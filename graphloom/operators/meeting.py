"""Undirected shortest paths by two searches that meet.

One search starts at each end. Every round grows the search whose last level leads to fewer edges, so
a hub on one side is passed by from the other. Levels are complete, so the first common node is met at
the exact distance, and an end whose component is exhausted ends the search early. A new level can
only touch the two levels before it, hence only these are anti-joined. Levels are written with their
degrees: Spark knows their size, and choosing a side needs no further look at the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.subgraph import connected_edges
from graphloom.operators.traverse import adjacency, start_rows
from graphloom.session import materialize, union_all

STEP_SCHEMA = "step int, id string, relationship_type string"


@dataclass
class Side:
    """One search: its levels (id, hops, degree) and the number of edges its last level leads to."""

    levels: list[DataFrame]
    cost: int


@dataclass
class Meeting:
    """Where two searches met: both sides, the distance (None if they never meet) and how many edges
    were followed in all."""

    forward: Side
    backward: Side
    distance: int | None
    edges_followed: int


def _with_degree(ids: DataFrame, degrees: DataFrame, hops: int) -> DataFrame:
    return materialize(ids.join(degrees, "id", "left").select("id", F.lit(hops).alias("hops"), F.coalesce("degree", F.lit(0)).alias("degree")))


def meet(edges: DataFrame, source_id: str, target_id: str) -> Meeting:
    """Search from both ends of ``edges`` (src, dst; each edge in both directions)."""
    spark = edges.sparkSession
    degrees = materialize(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")))

    def begin(node: str) -> Side:
        level = _with_degree(start_rows(spark, [node]).select("id"), degrees, 0)
        return Side([level], level.first().degree)

    forward, backward = begin(source_id), begin(target_id)
    followed = 0
    while forward.cost and backward.cost:
        side, other = (forward, backward) if forward.cost <= backward.cost else (backward, forward)
        followed += side.cost
        last = side.levels[-1]
        before = union_all([level.select("id") for level in side.levels[-2:]])
        fresh = last.join(edges, last.id == edges.src).select(F.col("dst").alias("id")).distinct().join(before, "id", "left_anti")
        level = _with_degree(fresh, degrees, len(side.levels))
        side.levels.append(level)
        seen = other.levels[-1].select("id", F.lit(1).alias("seen"))
        cost, common = level.join(seen, "id", "left").agg(F.sum("degree"), F.count("seen")).first()
        side.cost = cost or 0
        if common:
            return Meeting(forward, backward, len(forward.levels) + len(backward.levels) - 2, followed)
    return Meeting(forward, backward, None, followed)


def path_levels(edges: DataFrame, found: Meeting) -> DataFrame:
    """(id, hops from the source) of every node on a shortest path, and of the source's search.

    Behind the meeting level only nodes that it leads to are kept: a node of the target's search is on a
    shortest path exactly if it neighbours one that is.
    """
    near, far = found.forward.levels, found.backward.levels
    rows = [level.select("id", "hops") for level in near]
    live = near[-1].join(far[-1].select("id"), "id", "left_semi")
    for left in range(len(far) - 2, -1, -1):
        next_ids = live.join(edges, live.id == edges.src).select(F.col("dst").alias("id")).distinct()
        live = materialize(far[left].select("id").join(next_ids, "id", "left_semi").withColumn("hops", F.lit(found.distance - left)))
        rows.append(live)
    return union_all(rows)


def shortest_path(graph, source_id: str, target_id: str) -> DataFrame:
    """Undirected shortest path between two entities as steps (step, id, edge type), or no rows.

    Of several, the one read back from the target over the edges with the lowest position, then the
    smaller id.
    """
    if source_id == target_id:
        return graph.entities.filter(F.col("id") == source_id).select(
            F.lit(0).alias("step"), "id", F.lit(None).cast("string").alias("relationship_type")
        )
    # Written once, with the columns that are read; the other direction is made where they are read.
    edges = adjacency(materialize(connected_edges(graph).select("source_id", "target_id", "type", "ord")), "both")
    found = meet(edges, source_id, target_id)
    if found.distance is None:
        return graph.spark.createDataFrame([], STEP_SCHEMA)
    return _read_back(graph.spark, edges, path_levels(edges, found), found.distance, source_id, target_id)


def shortest_path_length(graph, source_id: str, target_id: str) -> DataFrame:
    """Number of hops between two entities, ignoring edge directions; no row if unconnected."""
    known = graph.entities.filter(F.col("id") == target_id).select("id").distinct()
    if source_id == target_id:
        return known.select("id", F.lit(0).alias("hops"))
    pairs = materialize(connected_edges(graph).select("source_id", "target_id"))
    both = pairs.selectExpr("source_id as src", "target_id as dst").unionByName(pairs.selectExpr("target_id as src", "source_id as dst"))
    found = meet(both, source_id, target_id)
    return known.select("id", F.lit(found.distance).cast("int").alias("hops")).filter("hops is not null")


def _read_back(spark: SparkSession, edges: DataFrame, levels: DataFrame, distance: int, source_id: str, target_id: str) -> DataFrame:
    steps, current = [], target_id
    for hop in range(distance, 0, -1):
        # One top-1 lookup per step: the lowest-positioned edge from the level before.
        best = (
            edges.filter(F.col("dst") == current)
            .join(levels.filter(F.col("hops") == hop - 1), F.col("src") == F.col("id"))
            .orderBy("ord", "src")
            .select("src", "type")
            .first()
        )
        steps.append((hop, current, best.type))
        current = best.src
    return spark.createDataFrame([(0, source_id, None), *reversed(steps)], STEP_SCHEMA)
