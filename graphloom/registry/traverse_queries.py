"""Traversal, caller, path and component queries on the table graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import meeting, reach, subgraph, traverse
from graphloom.registry.base import over_graph, query
from graphloom.sources.tables import table_graph, table_relationships

WALK_SQL = """
, b as (
  select 'r0::n0' as id, 0 as hops
  union
  select r.target_id, hops + 1 from b join relationships r on r.source_id = b.id where hops < {depth})
"""


@query("traverse_2hop", over_graph(WALK_SQL.format(depth=2) + "select id, min(hops) as hops from b group by id"))
def traverse_2hop(spark, sf):
    return traverse.traverse(table_graph(spark, sf), ["r0::n0"], 2).select("id", "hops")


@query("traverse_paths", over_graph("""
, b as (
  select s.id, 0 as hops, s.id as path, [struct_pack(o := s.pos, i := s.id)] as key
  from (values ('r0::n0', cast(0 as bigint)), ('p3', 1)) s(id, pos)
  union all
  select r.target_id, hops + 1, path || ' --' || r.type || '--> ' || r.target_id,
         list_append(key, struct_pack(o := r.ord, i := r.target_id))
  from b join relationships r on r.source_id = b.id where hops < 2)
select id, first(hops order by hops, key) as hops, first(path order by hops, key) as path from b group by id"""))
def traverse_paths(spark, sf):
    return traverse.traverse(table_graph(spark, sf), ["r0::n0", "p3"], 2).select("id", "hops", "path")


@query("traverse_filtered", over_graph("""
, b as (
  select 'r1::n1' as id, 0 as hops
  union
  select r.target_id, hops + 1 from b join relationships r on r.source_id = b.id
    left join entities e on e.id = r.target_id
  where hops < 3 and r.type in ('CALLS', 'CONTAINS') and (e.type is null or e.type not in ('ASYNC_FUNCTION', 'CONSTANT')))
select id, min(hops) as hops from b group by id"""))
def traverse_filtered(spark, sf):
    reached = traverse.traverse(
        table_graph(spark, sf), ["r1::n1"], 3, ["CALLS", "CONTAINS"], ["ASYNC_FUNCTION", "CONSTANT"])
    return reached.select("id", "hops")


@query("traverse_stats", over_graph(WALK_SQL.format(depth=3) + """
, m as (select id, min(hops) as hops from b group by id)
select count(*) as total_entities, count(distinct file_path) as files_touched, max(hops) as max_depth_reached
from m left join entities e on e.id = m.id"""))
def traverse_stats(spark, sf):
    graph = table_graph(spark, sf)
    return traverse.traversal_stats(graph, traverse.within_hops(graph.relationships, spark, ["r0::n0"], 3, "outgoing"))


@query("traverse_details", over_graph(WALK_SQL.format(depth=2) + """
select e.id, e.name, e.type, e.file_path, min(hops) as hops_from_start from b join entities e on e.id = b.id group by all"""))
def traverse_details(spark, sf):
    graph = table_graph(spark, sf)
    rows = traverse.traversal_details(graph, traverse.traverse(graph, ["r0::n0"], 2))
    return rows.select("id", "name", "type", "file_path", F.col("hops").alias("hops_from_start"))


@query("khop_undirected", over_graph("""
, e2 as (select source_id as a, target_id as c from relationships union all select target_id, source_id from relationships),
  b as (select 'p5' as id, 0 as hops union select e2.c, hops + 1 from b join e2 on e2.a = b.id where hops < 2)
select id, min(hops) as hops from b group by id"""))
def khop_undirected(spark, sf):
    return traverse.within_hops(table_relationships(spark, sf), spark, ["p5"], 2, "both")


@query("khop_incoming", over_graph("""
, b as (select 'p5' as id, 0 as hops union select r.source_id, hops + 1 from b join relationships r on r.target_id = b.id where hops < 2)
select id, min(hops) as hops from b group by id"""))
def khop_incoming(spark, sf):
    return traverse.within_hops(table_relationships(spark, sf), spark, ["p5"], 2, "incoming")


FOCUS_SQL = """
, known as (select * from relationships where source_id in (select id from entities) and target_id in (select id from entities)),
  e2 as (select source_id as a, target_id as c from known union all select target_id, source_id from known),
  b as (select 'p5' as id, 0 as hops union select e2.c, hops + 1 from b join e2 on e2.a = b.id where hops < 2),
  shown as (select distinct id from b),
  part as (select * from known where source_id in (select id from shown) and target_id in (select id from shown))
"""


@query("focus_subgraph", over_graph(FOCUS_SQL + "select source_id, target_id, type, line_number from part"))
def focus_subgraph(spark, sf):
    part = subgraph.focus(table_graph(spark, sf), "p5", 2)
    return part.relationships.select("source_id", "target_id", "type", "line_number")


@query("focus_stats", over_graph(FOCUS_SQL + """
select (select count(*) from entities) as total_nodes, (select count(*) from known) as total_edges,
  (select count(*) from shown) as visible_nodes, (select count(*) from part) as visible_edges,
  (select count(distinct source_id) from known where target_id = 'p5') as in_neighbors,
  (select count(distinct target_id) from known where source_id = 'p5') as out_neighbors"""))
def focus_stats(spark, sf):
    return subgraph.focus_stats(table_graph(spark, sf), "p5", 2)


CALLER_SQL = """
, calls as (select source_id, target_id, ord from relationships where type = 'CALLS'),
  b as (
  select distinct source_id as id, 1 as depth from calls where target_id = 'p0'
  union
  select c.source_id, depth + 1 from b join calls c on c.target_id = b.id where depth < {depth})
"""


@query("callers_transitive", over_graph(CALLER_SQL.format(depth=4) + "select id as caller, min(depth) as depth from b group by id"))
def callers_transitive(spark, sf):
    return traverse.callers(table_graph(spark, sf), "p0", 4).select("caller", "depth").distinct()


@query("callers_tree", over_graph("""
, calls as (select source_id, target_id, ord from relationships where type = 'CALLS'),
  direct as (select source_id as id, min(struct_pack(o := ord, i := source_id)) as k from calls where target_id = 'p0' group by source_id),
  b as (
  select id, 1 as depth, 'p0' as callee, [k] as key from direct
  union all
  select c.source_id, depth + 1, b.id, list_append(key, struct_pack(o := c.ord, i := c.source_id))
  from b join calls c on c.target_id = b.id where depth < 3 and c.source_id not in (select id from direct)),
  tree as (select id as caller, first(callee order by depth, key) as callee, first(depth order by depth, key) as depth
           from b where depth > 1 group by id)
select source_id as caller, 'p0' as callee, 1 as depth from calls where target_id = 'p0'
union all select * from tree"""))
def callers_tree(spark, sf):
    return traverse.callers(table_graph(spark, sf), "p0", 3).select("caller", "callee", "depth")


@query("call_hierarchy_total", over_graph(CALLER_SQL.format(depth=2) + """
select (select count(*) from calls where target_id = 'p0') as direct_callers,
  (select count(distinct id) from b) - (select count(distinct source_id) from calls where target_id = 'p0') as transitive_callers"""))
def call_hierarchy_total(spark, sf):
    rows = traverse.callers(table_graph(spark, sf), "p0", 2)
    return rows.agg(
        F.count_if(F.col("depth") == 1).alias("direct_callers"),
        F.count_if(F.col("depth") > 1).alias("transitive_callers"),
    )


@query("shortest_path_hops", over_graph("""
, known as (select * from relationships where source_id in (select id from entities) and target_id in (select id from entities)),
  e2 as (select source_id as a, target_id as c from known union all select target_id, source_id from known),
  b as (select 'p0' as id, 0 as hops union select e2.c, hops + 1 from b join e2 on e2.a = b.id where hops < 4)
select id, min(hops) as hops from b where id = 'r4::n9' group by id"""))
def shortest_path_hops(spark, sf):
    return meeting.shortest_path_length(table_graph(spark, sf), "p0", "r4::n9")


# Read back from the target: of the edges that come from the level before, the one with the lowest
# position is taken, then the smaller id.
@query("shortest_path_steps", over_graph("""
, known as (select ord, source_id, target_id, type from relationships where source_id <> target_id
    and source_id in (select id from entities) and target_id in (select id from entities)),
  e2 as (select ord, source_id as a, target_id as c, type from known union all select ord, target_id, source_id, type from known),
  b as (select 'p0' as id, 0 as hops union select e2.c, hops + 1 from b join e2 on e2.a = b.id where hops < 4),
  levels as (select id, min(hops) as hops from b group by id),
  best as (
    select l.id, l.hops, arg_min({'src': e2.a, 'type': e2.type}, row(e2.ord, e2.a)) as edge
    from levels l join e2 on e2.c = l.id join levels p on p.id = e2.a and p.hops = l.hops - 1 group by all),
  walk as (
    select hops as step, id, edge.type as relationship_type, edge.src as src from best where id = 'r4::n9'
    union all select best.hops, best.id, best.edge.type, best.edge.src from walk join best on best.id = walk.src)
select step, id, relationship_type from walk
union all select 0, 'p0', null where exists (select 1 from walk)"""))
def shortest_path_steps(spark, sf):
    return meeting.shortest_path(table_graph(spark, sf), "p0", "r4::n9")


@query("reach_all")
def reach_all(spark, sf):
    """Estimated number of nodes within three hops of every node (relative standard error 1.6 %)."""
    return reach.reach_of_all(table_graph(spark, sf), 3)


# Components over calls between known entities; containment and inheritance play no role.
COMPONENT_EDGES = "type = 'CALLS'"


@query("connected_components", over_graph(f"""
, known as (select source_id as a, target_id as c from relationships where {COMPONENT_EDGES}
    and source_id in (select id from entities) and target_id in (select id from entities)),
  e2 as (select a, c from known union all select c, a from known),
  cc(id, label) using key (id) as (
    select id, id from entities
    union
    select e2.c, min(cc.label) from cc join e2 on e2.a = cc.id join recurring.cc o on o.id = e2.c
    where cc.label < o.label group by e2.c)
select id, label as component from cc"""))
def connected_components(spark, sf):
    graph = table_graph(spark, sf)  # read once; the operator writes the numbers of its nodes and edges only
    nodes = traverse.numbered_nodes(graph.entities)
    return traverse.connected_components(nodes, subgraph.connected_edges(graph, nodes).filter(COMPONENT_EDGES))


@query("connected_components_all", over_graph("""
, known as (select source_id as a, target_id as c from relationships
    where source_id in (select id from entities) and target_id in (select id from entities)),
  e2 as (select a, c from known union all select c, a from known),
  cc(id, label) using key (id) as (
    select id, id from entities
    union
    select e2.c, min(cc.label) from cc join e2 on e2.a = cc.id join recurring.cc o on o.id = e2.c
    where cc.label < o.label group by e2.c)
select label as component, count(*) as size from cc group by label"""))
def connected_components_all(spark, sf):
    graph = table_graph(spark, sf)
    nodes = traverse.numbered_nodes(graph.entities)
    labels = traverse.connected_components(nodes, subgraph.connected_edges(graph, nodes))
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
