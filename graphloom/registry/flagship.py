"""The flagship query: the entities most depended upon, with their callers and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.neighbors import degrees
from graphloom.registry.base import over_graph, query
from graphloom.sources.tables import table_graph


@query("busiest_entities", over_graph("""
, ends as (select source_id as id, 0 as i, 1 as o, 0 as f from relationships
           union all select target_id, 1, 0, cast(type = 'CALLS' as int) from relationships)
select d.id, e.name, e.type, e.file_path, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree
from ends d join entities e on e.id = d.id group by all order by sum(i + o) desc, d.id limit 25"""))
def busiest_entities(spark, sf):
    graph = table_graph(spark, sf)
    top = degrees(graph.relationships).join(graph.entities.select("id", "name", "type", "file_path"), "id")
    return top.orderBy(F.desc("degree"), "id").limit(25).select(
        "id", "name", "type", "file_path", "in_degree", "out_degree"
    )
