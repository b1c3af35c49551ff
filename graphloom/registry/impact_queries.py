"""Impact queries on the table graph."""

from __future__ import annotations

from graphloom.operators import impact
from graphloom.operators.neighbors import direct_callers
from graphloom.registry.base import over_graph, query
from graphloom.sources.tables import table_graph

TREE_SQL = """
, calls as (select source_id, target_id from relationships where type = 'CALLS'),
  b as (select distinct source_id as id, 1 as depth from calls where target_id = '{id}'
        union select c.source_id, depth + 1 from b join calls c on c.target_id = b.id where depth < {depth}),
  nodes as (select id, min(depth) as depth from b group by id),
  f as (select '{id}' as id, 0 as hops union select c.target_id, hops + 1 from f join calls c on c.source_id = f.id where hops < {depth})
"""


@query("impact_risk", over_graph(TREE_SQL.format(id="p0", depth=3) + """
, n as (select (select count(*) from calls where target_id = 'p0') as direct_callers,
  (select count(*) from nodes where depth > 1) as transitive_callers,
  (select count(distinct e.file_path) from f join entities e on e.id = f.id) as files_affected)
select *, direct_callers + transitive_callers as total_affected,
  case when direct_callers + transitive_callers >= 20 then 'HIGH' when direct_callers + transitive_callers >= 10 then 'MEDIUM'
       when files_affected >= 5 then 'MEDIUM' else 'LOW' end as risk_level from n"""))
def impact_risk(spark, sf):
    return impact.impact(table_graph(spark, sf), "p0", 3)


@query("impact_assessment", over_graph(TREE_SQL.format(id="p0", depth=3) + """
, again as (select distinct c.source_id as id from calls c join nodes n on n.id = c.target_id where n.depth < 3),
  files as (select distinct e.file_path from again a join entities e on e.id = a.id),
  n as (select (select count(*) from again) as total_affected, (select count(*) from files) as files_affected,
    (select count(*) from files where contains(lower(file_path), 'test')) as test_files)
select *, case when total_affected = 0 then 'LOW' else
  case (case when total_affected >= 20 then 3 when total_affected >= 10 then 2 else 1 end
      + case when files_affected >= 5 then 2 when files_affected >= 3 then 1 else 0 end)
  when 5 then 'HIGH' when 4 then 'MEDIUM' when 3 then 'MEDIUM' else 'LOW' end end as risk_level from n"""))
def impact_assessment(spark, sf):
    graph = table_graph(spark, sf)
    return impact.impact_assessment(graph, impact.affected_callers(graph, "p0", 3))


@query("understand_callers", over_graph("""
select source_id as caller from relationships where target_id = (
  select id from entities where contains(lower(name), 'red widget') order by ord, id limit 1) and type = 'CALLS'
order by ord, source_id limit 5"""))
def understand_callers(spark, sf):
    from graphloom.operators.search import find_entities

    graph = table_graph(spark, sf)
    first = find_entities(graph.entities, "red widget", max_results=1).select("id").scalar()
    return direct_callers(graph.relationships, first).orderBy("ord", "caller").limit(5).select("caller")
