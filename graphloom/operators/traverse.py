"""Bounded and unbounded graph search as rounds of frontier joins.

Each round joins the frontier with the edges, keeps the best candidate per node with a
pre-aggregating ``groupBy``, removes visited nodes with an anti join and writes the new frontier
as a table. Frontier tables carry their real size, so Spark broadcasts a small frontier and
shuffles a large one without hints; skewed hubs are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.graph import ParsedGraph
from graphloom.operators.neighbors import of_types
from graphloom.session import materialize, union_all

STEP_TYPE = "array<struct<ord:bigint,id:string>>"
#: Hops for which the edges of a parsed graph are derived for the files of the frontier instead of written.
NEAR_HOPS = 2


def adjacency(relationships: DataFrame, direction: str = "outgoing", types: list[str] | None = None) -> DataFrame:
    """Edges as (src, dst, type, ord) in walking direction; ``both`` holds each edge twice."""
    edges = of_types(relationships, types)
    forward = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "type", "ord")
    if direction == "outgoing":
        return forward
    backward = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), "type", "ord")
    if direction == "incoming":
        return backward
    return forward.unionByName(backward)


def start_rows(spark: SparkSession, start_ids: list[str]) -> DataFrame:
    """The start list as a small table (id, position)."""
    return spark.range(1).select(
        F.posexplode(F.array(*[F.lit(s) for s in start_ids]).cast("array<string>")).alias("pos", "id")
    )


def _step(ord_col: Column, id_col: Column) -> Column:
    return F.array(F.struct(ord_col.cast("bigint").alias("ord"), id_col.alias("id"))).cast(STEP_TYPE)


def traverse(
    graph,
    start_ids: list[str],
    max_hops: int = 2,
    include_types: list[str] | None = None,
    exclude_entity_types: list[str] | None = None,
    direction: str = "outgoing",
) -> DataFrame:
    """Breadth-first walk: id, hops, path text and ``key``, the discovery order.

    A queue-based search discovers the nodes of a level in the order of the edge positions along
    their paths, so the smallest key per node picks the same parent and gives the same order.
    Dangling targets are visited; excluded entity types block the walk only for known entities.
    """
    spark = graph.spark
    starts = start_rows(spark, start_ids).groupBy("id").agg(F.min("pos").alias("pos"))
    frontier = starts.select(
        "id", F.lit(0).alias("hops"), F.col("id").alias("path"), _step(F.col("pos"), F.col("id")).alias("key")
    )
    if isinstance(graph, ParsedGraph) and direction == "outgoing" and max_hops <= NEAR_HOPS:
        edges = lambda last: adjacency(graph.edges_from(last), direction, include_types or None)
    else:
        edges = adjacency(graph.relationships, direction, include_types or None)
        if not graph.stored and max_hops > 1:
            edges = materialize(edges)
    blocked = None
    if exclude_entity_types:
        blocked = graph.entities.filter(F.col("type").isin(*exclude_entity_types)).select("id")
    return union_all(_walk(frontier, edges, max_hops, blocked))


def _walk(frontier: DataFrame, edges, max_hops: int | None, blocked: DataFrame | None = None):
    """All levels of a walk with paths; ``frontier`` has id, hops, path, key. ``edges`` is a frame, or
    gives one with at least the edges that leave a level."""
    levels = [materialize(frontier)]
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        last = levels[-1]
        near = edges(last) if callable(edges) else edges
        reached = (
            last.join(near, last.id == near.src)
            .select(
                F.col("dst").alias("id"),
                F.concat("key", _step(F.col("ord"), F.col("dst"))).alias("key"),
                F.concat("path", F.lit(" --"), "type", F.lit("--> "), "dst").alias("path"),
            )
            .groupBy("id")
            .agg(F.min(F.struct("key", "path")).alias("best"))
        )
        if blocked is not None:
            reached = reached.join(blocked, "id", "left_anti")
        visited = union_all([level.select("id") for level in levels])
        fresh = reached.join(visited, "id", "left_anti").select(
            "id", F.lit(hop).alias("hops"), F.col("best.path").alias("path"), F.col("best.key").alias("key")
        )
        level = materialize(fresh)
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def _levels(frontier: DataFrame, edges: DataFrame, max_hops: int | None) -> DataFrame:
    """Hop counts only (id, hops); the cheap form when paths are not asked for."""
    levels = [materialize(frontier.select("id", F.lit(0).alias("hops")))]
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        last = levels[-1]
        visited = union_all([level.select("id") for level in levels])
        level = materialize(
            last.join(edges, last.id == edges.src)
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(visited, "id", "left_anti")
            .select("id", F.lit(hop).alias("hops"))
        )
        if level.isEmpty():
            break
        levels.append(level)
    return union_all(levels)


def within_hops(
    relationships: DataFrame, spark: SparkSession, start_ids: list[str], depth: int,
    direction: str = "both", types: list[str] | None = None,
) -> DataFrame:
    """Ids within ``depth`` hops and their distance, in either or both directions."""
    edges = adjacency(relationships, direction, types).select("src", "dst")
    if depth > 1:
        edges = materialize(edges)
    return _levels(start_rows(spark, start_ids).select("id").distinct(), edges, depth)


def known_within_hops(graph, node_id: str, depth: int, direction: str = "both") -> DataFrame:
    """(id, hops) of the entities within ``depth`` hops of an entity over entities only.

    Reached ids are looked up among the entities level by level, so edges to unknown ids need not be
    sorted out of the whole graph; of the edges only the ends are written.
    """
    edges = adjacency(graph.relationships, direction).select("src", "dst")
    if depth > 1 and not graph.stored:
        edges = materialize(edges)

    def known(ids: DataFrame, hop: int) -> DataFrame:
        return materialize(graph.entities.select("id").join(ids, "id").distinct().select("id", F.lit(hop).alias("hops")))

    levels = [known(start_rows(graph.spark, [node_id]).select("id"), 0)]
    for hop in range(1, depth + 1):
        last = levels[-1]
        visited = union_all([level.select("id") for level in levels])
        # Written before the lookup, so that Spark knows how few they are.
        reached = materialize(last.join(edges, last.id == edges.src).select(F.col("dst").alias("id")).distinct().join(visited, "id", "left_anti"))
        level = known(reached, hop)
        if level.isEmpty():
            break
        levels.append(level)
    return union_all(levels)


def traversal_stats(graph, reached: DataFrame) -> DataFrame:
    """Visited ids (dangling ones included), files of the known ones, greatest distance."""
    known = graph.entities.select("id", "file_path")
    return (
        reached.select("id", "hops")
        .join(known, "id", "left")
        .agg(
            F.count(F.lit(1)).alias("total_entities"),
            F.count_distinct("file_path").alias("files_touched"),
            F.max("hops").alias("max_depth_reached"),
        )
    )


def traversal_details(graph, reached: DataFrame) -> DataFrame:
    """Visited entities with their attributes and distance."""
    return reached.select("id", "hops", "key").join(
        graph.entities.select("id", "name", "type", "file_path"), "id"
    )


def callers(graph, entity_id: str, max_depth: int = 1, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """Caller tree: (caller, callee, depth, key).

    Depth 1 has one row per call; deeper callers appear once, under the parent found first.
    The entity itself is not marked visited and can return through a call cycle.
    """
    edges = adjacency(graph.relationships, "incoming", list(types))
    first = edges.filter(F.col("src") == entity_id).select(
        F.col("dst").alias("caller"), F.lit(entity_id).alias("callee"), F.lit(1).alias("depth"),
        _step(F.col("ord"), F.col("dst")).alias("key"),
    )
    if max_depth <= 1:
        return first
    if not graph.stored:
        edges = materialize(edges)
    seeds = first.groupBy(F.col("caller").alias("id")).agg(F.min("key").alias("key"))
    frontier = seeds.select("id", F.lit(0).alias("hops"), F.lit("").alias("path"), "key")
    levels = _walk(frontier, edges, max_depth - 1)
    rows = [first]
    for level in levels[1:]:
        rows.append(
            level.select(
                F.col("id").alias("caller"),
                # The step before the last names the parent in the discovery tree.
                F.element_at("key", -2)["id"].alias("callee"),
                (F.col("hops") + 1).alias("depth"),
                "key",
            )
        )
    return union_all(rows)


def numbered_nodes(node_ids: DataFrame) -> DataFrame:
    """(id, number) of the distinct ids, written; rounds over numbers move less than rounds over ids."""
    return materialize(node_ids.select("id").distinct().withColumn("number", F.monotonically_increasing_id()))


def connected_components(node_ids: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Undirected components as (id, component); the component is its smallest id.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every round points
    nodes to the smallest neighbour, reaching stars in about log-many rounds where plain label
    propagation needs one round per hop. Minima aggregate map-side, so hubs do not gather.

    Nodes with a ``number`` (``numbered_nodes``) and edges with source_number and target_number are
    linked by these; the ids of a component are looked at once, at the end.
    """
    if "number" in node_ids.columns:
        labels = _stars(edges.select(F.col("source_number").alias("a"), F.col("target_number").alias("b")), max_rounds)
        rooted = node_ids.join(labels.withColumnRenamed("u", "number"), "number", "left").select("id", F.coalesce("v", "number").alias("root"))
        named = rooted.groupBy("root").agg(F.min("id").alias("component"))
        return rooted.join(named, "root").select("id", "component")
    labels = _stars(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), max_rounds)
    return node_ids.select("id").distinct().join(labels.selectExpr("u as id", "v as component"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _stars(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """(u, v): the smallest node v of the component of every node u that has an edge (a, b) and is not v itself."""
    links = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        links = materialize(_small_star(_large_star(links)))
        after = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == after:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links


def _large_star(links: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node of its closed neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
