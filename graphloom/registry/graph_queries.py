"""Search, neighbour, tree, subgraph and statistics queries on the table graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.graph import Graph, dense_numbers
from graphloom.operators import containment, edit, neighbors, search, stats, subgraph
from graphloom.registry.base import over_entities, over_graph, query
from graphloom.sources.tables import table_entities, table_graph, table_relationships

FOUND = "id, name, type, file_path, line_number"


# ---- search -----------------------------------------------------------------------------------

@query("find_exact", over_entities(f"select {FOUND} from entities where lower(name) = 'red widget' and type = 'CONSTANT'"))
def find_exact(spark, sf):
    found = search.find_entities(table_entities(spark, sf), "Red Widget", "CONSTANT", fuzzy=False, max_results=None)
    return found.drop("ord")


@query("find_fuzzy_topk", over_entities(
    f"select {FOUND} from entities where contains(lower(name), 'order_1') and type = 'FUNCTION' "
    "and contains(file_path, 'ASIA/') order by ord, id limit 10"))
def find_fuzzy_topk(spark, sf):
    return search.find_entities(table_entities(spark, sf), "ORDER_1", "FUNCTION", "ASIA/").drop("ord")


@query("find_exact_then_fuzzy", over_entities(
    f"""select {FOUND}, lower(name) = 'order_7' as exact from entities where contains(lower(name), 'order_7')
    and (lower(name) = 'order_7' or not exists (select 1 from entities where lower(name) = 'order_7'))
    order by ord, id limit 10"""))
def find_exact_then_fuzzy(spark, sf):
    return search.find_exact_or_fuzzy(table_entities(spark, sf), "order_7").drop("ord")


@query("search_multi_field", over_entities(
    f"""select {FOUND} from entities where contains(lower(name), 'build') or contains(lower(id), 'build')
    or contains(lower(file_path), 'build') or contains(lower(coalesce(properties->>'description', '')), 'build')
    order by ord, id limit 100"""))
def search_multi_field(spark, sf):
    return search.search_fields(table_entities(spark, sf), "Build").drop("ord")


@query("search_highlight", over_entities(
    f"""select {FOUND} from entities where contains(lower(name), 'widget') or contains(lower(file_path), 'widget')
    order by ord, id limit 50"""))
def search_highlight(spark, sf):
    return search.search_fields(table_entities(spark, sf), "widget", ("name", "file_path"), max_results=50).drop("ord")


@query("search_by_type", over_entities(
    f"""select {FOUND} from entities where type = 'CLASS' and (contains(lower(name), '00001') or contains(lower(id), '00001')
    or contains(lower(file_path), '00001')) order by ord, id limit 50"""))
def search_by_type(spark, sf):
    return search.search_fields(
        table_entities(spark, sf), "00001", ("name", "id", "file_path"), "CLASS", 50).drop("ord")


@query("picker_search", over_entities(
    f"""select {FOUND} from entities where contains(lower(name), 'c1') or contains(lower(id), 'c1')
    order by ord, id limit 8"""))
def picker_search(spark, sf):
    return search.search_fields(table_entities(spark, sf), "C1", ("name", "id"), max_results=8).drop("ord")


@query("entity_lookup", over_entities("select id, file_path, line_number, end_line from entities where id = 'p17'"))
def entity_lookup(spark, sf):
    return search.entity_by_id(table_entities(spark, sf), "p17").select("id", "file_path", "line_number", "end_line")


@query("entities_by_file", over_entities("select id, type from entities where file_path = 'ASIA/NATION_2.py'"))
def entities_by_file(spark, sf):
    return search.entities_by_file(table_entities(spark, sf), "ASIA/NATION_2.py").select("id", "type")


@query("entities_by_type", over_entities("select id, name from entities where type = 'ASYNC_FUNCTION'"))
def entities_by_type(spark, sf):
    return search.entities_by_type(table_entities(spark, sf), "ASYNC_FUNCTION").select("id", "name")


@query("all_file_paths", over_entities("select distinct file_path from entities"))
def all_file_paths(spark, sf):
    return search.all_file_paths(table_entities(spark, sf))


@query("entity_options", over_entities("select id, name || ' (' || type || ')' as label, type from entities"))
def entity_options(spark, sf):
    return search.entity_options(table_entities(spark, sf))


# ---- neighbours -------------------------------------------------------------------------------

HUB = "p0"
NEIGHBOR_SQL = """(
  select 'outgoing' as direction, type as relationship_type, target_id as neighbor_id, ord, line_number
    from relationships where source_id = '{id}'
  union all select 'incoming', type, source_id, ord, line_number from relationships where target_id = '{id}')"""


@query("neighbors_out", over_graph(
    f"select relationship_type, neighbor_id from {NEIGHBOR_SQL.format(id='r0::n0')} where direction = 'outgoing'"))
def neighbors_out(spark, sf):
    rows = neighbors.neighbors(table_relationships(spark, sf), "r0::n0", "outgoing")
    return rows.select("relationship_type", "neighbor_id")


@query("neighbors_in", over_graph(
    f"select relationship_type, neighbor_id from {NEIGHBOR_SQL.format(id=HUB)} where direction = 'incoming' and relationship_type = 'CALLS'"))
def neighbors_in(spark, sf):
    rows = neighbors.neighbors(table_relationships(spark, sf), HUB, "incoming", ["CALLS"])
    return rows.select("relationship_type", "neighbor_id")


@query("neighbors_both", over_graph(
    f"select direction, relationship_type, neighbor_id from {NEIGHBOR_SQL.format(id=HUB)}"))
def neighbors_both(spark, sf):
    rows = neighbors.neighbors(table_relationships(spark, sf), HUB, "both")
    return rows.select("direction", "relationship_type", "neighbor_id")


@query("neighbors_distinct_topk", over_graph(f"""
, seen as (select neighbor_id, relationship_type, min(struct_pack(i := direction = 'incoming', o := ord)) as s
           from {NEIGHBOR_SQL.format(id=HUB)} group by all),
  top as (select *, s.i as is_incoming, s.o as o from seen order by s.i, s.o, neighbor_id, relationship_type limit 20)
select t.relationship_type, case when is_incoming then 'incoming' else 'outgoing' end as direction,
       t.neighbor_id as entity_id, coalesce(e.name, string_split(t.neighbor_id, '::')[-1]) as name,
       coalesce(e.type, 'EXTERNAL') as type, e.file_path
from top t left join entities e on e.id = t.neighbor_id"""))
def neighbors_distinct_topk(spark, sf):
    rows = neighbors.distinct_neighbors(table_graph(spark, sf), HUB)
    return rows.select("relationship_type", "direction", "entity_id", "name", "type", "file_path")


@query("callers_direct", over_graph(
    f"select source_id as caller, line_number from relationships where target_id = '{HUB}' and type = 'CALLS'"))
def callers_direct(spark, sf):
    return neighbors.direct_callers(table_relationships(spark, sf), HUB).select("caller", "line_number")


@query("neighbor_ids_by_direction", over_graph(
    f"select distinct direction, neighbor_id from {NEIGHBOR_SQL.format(id='r1::n1')}"))
def neighbor_ids_by_direction(spark, sf):
    return neighbors.distinct_neighbor_ids(table_relationships(spark, sf), "r1::n1")


@query("connections", over_graph(f"""
select n.direction, n.relationship_type, coalesce(e.name, n.neighbor_id) as name
from {NEIGHBOR_SQL.format(id=HUB)} n left join entities e on e.id = n.neighbor_id"""))
def connections(spark, sf):
    return neighbors.connections(table_graph(spark, sf), HUB).drop("ord")


@query("connection_counts", over_graph(f"""
select count(*) filter (target_id = '{HUB}') as incoming, count(*) filter (source_id = '{HUB}') as outgoing
from relationships"""))
def connection_counts(spark, sf):
    return neighbors.connection_counts(table_relationships(spark, sf), HUB)


@query("degree", over_graph("""
select id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, cast(sum(i + o) as bigint) as degree
from (select source_id as id, 0 as i, 1 as o from relationships union all select target_id, 1, 0 from relationships)
group by id"""))
def degree(spark, sf):
    return neighbors.degrees(table_relationships(spark, sf))


@query("children_count", over_graph(
    "select source_id as id, count(*) as children from relationships where type = 'CONTAINS' group by 1"))
def children_count(spark, sf):
    return neighbors.children_counts(table_relationships(spark, sf))


# ---- statistics -------------------------------------------------------------------------------

@query("stats_entities", over_entities("select type, count(*) as count from entities group by type"))
def stats_entities(spark, sf):
    return stats.counts_by_type(table_entities(spark, sf))


@query("stats_relationships", over_graph("select type, count(*) as count from relationships group by type"))
def stats_relationships(spark, sf):
    return stats.counts_by_type(table_relationships(spark, sf))


@query("stats_with_totals", over_graph("""
, k as (select 'entity' as kind, type from entities union all select 'relationship', type from relationships)
select kind, coalesce(type, 'TOTAL') as type, count(*) as count from k
group by grouping sets ((kind, type), (kind))"""))
def stats_with_totals(spark, sf):
    return stats.graph_counts(table_graph(spark, sf))


@query("type_counts_zero_filled", over_entities("""
select t.type, count(e.id) as count from (
  select unnest(['FILE','MODULE','CLASS','FUNCTION','ASYNC_FUNCTION','CONSTANT','VARIABLE','IMPORT','DECORATOR']) as type
  union select type from entities) t left join entities e on e.type = t.type group by t.type"""))
def type_counts_zero_filled(spark, sf):
    return stats.counts_zero_filled(table_entities(spark, sf))


@query("type_choices", over_graph("""
select unnest(['CONTAINS','DEFINES_IN','CALLS','IMPORTS','INHERITS','INSTANTIATES','USES','LOCATED_IN',
 'IMPORTS_RESOLVED_TO','CALLS_RESOLVED','DEFINES_SYMBOL']) as type union select type from relationships"""))
def type_choices(spark, sf):
    return stats.relationship_type_choices(table_relationships(spark, sf))


@query("build_summary", over_graph("""
select count(*) as entities, (select count(*) from relationships) as relationships,
       count(distinct file_path) as files from entities"""))
def build_summary(spark, sf):
    return stats.build_summary(table_graph(spark, sf))


@query("graph_preview", over_entities("""
select id, name, type, (select count(distinct file_path) from entities) as files
from entities order by ord, id limit 10"""))
def graph_preview(spark, sf):
    return stats.preview(Graph(table_entities(spark, sf), None)).drop("ord")


# ---- tree -------------------------------------------------------------------------------------

@query("contains_closure", over_graph("select source_id, target_id, line_number from contains_edges"))
def contains_closure(spark, sf):
    return containment.containment_edges(table_entities(spark, sf)).select("source_id", "target_id", "line_number")


@query("tree_roots", over_entities("""
, f as (select distinct file_path from entities where type not in ('FILE', 'MODULE'))
select 'directory' as kind, regexp_replace(file_path, '/[^/]*$', '') as path,
       string_split(regexp_replace(file_path, '/[^/]*$', ''), '/')[-1] as label, count(*) as files
from f where contains(file_path, '/') group by all
union all select 'file', file_path, file_path, 1 from f where not contains(file_path, '/')"""))
def tree_roots(spark, sf):
    return containment.tree_roots(table_entities(spark, sf))


@query("files_in_dir", over_entities("""
select distinct string_split(file_path, '/')[-1] as file_name, 'ASIA/' || string_split(file_path, '/')[-1] as path
from entities where type not in ('FILE', 'MODULE') and starts_with(file_path, 'ASIA/')"""))
def files_in_dir(spark, sf):
    return containment.files_in_directory(table_entities(spark, sf), "ASIA")


@query("entities_in_file_sorted", over_entities("""
, r as (select *, case type when 'CLASS' then 1 when 'FUNCTION' then 2 when 'ASYNC_FUNCTION' then 3 when 'CONSTANT' then 4
   when 'VARIABLE' then 5 when 'IMPORT' then 6 else 9 end as type_rank from entities where file_path = 'ASIA/NATION_7.py')
select id, type_rank, line_number, row_number() over (order by type_rank, line_number, ord) as position from r"""))
def entities_in_file_sorted(spark, sf):
    rows = containment.entities_in_file(table_entities(spark, sf), "ASIA/NATION_7.py")
    numbered = dense_numbers(rows.withColumn("at", F.struct("type_rank", "line_number", "ord")), "at", "number")
    return rows.withColumn("at", F.struct("type_rank", "line_number", "ord")).join(numbered, "at").select(
        "id", "type_rank", "line_number", (F.col("number") + 1).alias("position"))


@query("children_by_prefix", over_entities("select id, type from entities where starts_with(id, 'r2::n2::')"))
def children_by_prefix(spark, sf):
    return containment.descendants(table_entities(spark, sf), "r2::n2").select("id", "type")


# ---- subgraph ---------------------------------------------------------------------------------

@query("dangling_edges_removed", over_graph("""
select r.source_id, r.target_id, r.type, r.line_number from relationships r
where r.source_id <> r.target_id and r.source_id in (select id from entities) and r.target_id in (select id from entities)"""))
def dangling_edges_removed(spark, sf):
    rows = subgraph.connected_edges(table_graph(spark, sf))
    return rows.select("source_id", "target_id", "type", "line_number")


@query("viewer_nodes", over_entities("""
select id, name, case when type in ('FILE','MODULE','CLASS','FUNCTION','CONSTANT','VARIABLE','IMPORT','DECORATOR')
  then type else 'VARIABLE' end as type, coalesce(file_path, '') as file_path, line_number,
  coalesce(properties->>'description', '') as docstring from entities"""))
def viewer_nodes(spark, sf):
    return subgraph.viewer_nodes(table_entities(spark, sf)).drop("ord")


@query("viewer_edges_capped", over_graph("""
, kept as (select id from entities order by ord, id limit 5000)
select source_id || '::' || target_id || '::' || type as id, source_id as source, target_id as target, type as rel, line_number
from relationships where source_id <> target_id and source_id in (select id from kept) and target_id in (select id from kept)"""))
def viewer_edges_capped(spark, sf):
    return subgraph.viewer_elements(table_graph(spark, sf), 5000)[1].drop("ord")


@query("viewer_edges", over_graph("""
select source_id || '::' || target_id || '::' || type as id, source_id as source, target_id as target, type as rel, line_number
from relationships where source_id <> target_id and source_id in (select id from entities) and target_id in (select id from entities)"""))
def viewer_edges(spark, sf):
    return subgraph.viewer_elements(table_graph(spark, sf))[1].drop("ord")


@query("induced_subgraph", over_graph("""
, k as (select id from entities where starts_with(id, 'r3::'))
select source_id, target_id, type from relationships where source_id in (select id from k) and target_id in (select id from k)"""))
def induced_subgraph(spark, sf):
    ids = containment.descendants(table_entities(spark, sf), "r3").select("id")
    return subgraph.induced_edges(table_relationships(spark, sf), ids).select("source_id", "target_id", "type")


@query("filter_by_types", over_graph("""
, k as (select id from entities where type in ('CLASS', 'FUNCTION'))
select source_id, target_id, type from relationships where type in ('CALLS', 'CONTAINS')
and source_id in (select id from k) and target_id in (select id from k)"""))
def filter_by_types(spark, sf):
    part = subgraph.filter_by_types(table_graph(spark, sf), ["CLASS", "FUNCTION"], ["CALLS", "CONTAINS"])
    return part.relationships.select("source_id", "target_id", "type")


@query("dim_flags", over_graph("""
select r.source_id, r.target_id, r.type, (a.type not in ('CLASS','CONSTANT') or b.type not in ('CLASS','CONSTANT')) as dimmed
from relationships r join entities a on a.id = r.source_id join entities b on b.id = r.target_id
where r.source_id <> r.target_id"""))
def dim_flags(spark, sf):
    return subgraph.dim_flags(table_graph(spark, sf), ["CLASS", "CONSTANT"])[1]


# ---- edits ------------------------------------------------------------------------------------

def _edges(graph):
    return graph.relationships.select("source_id", "target_id", "type", "line_number")


@query("edit_delete_cascade", over_graph(
    "select source_id, target_id, type, line_number from relationships where source_id <> 'p0' and target_id <> 'p0'"))
def edit_delete_cascade(spark, sf):
    return _edges(edit.delete_entity(table_graph(spark, sf), "p0"))


@query("edit_delete_edge", over_graph("""
select source_id, target_id, type, line_number from relationships
where not (source_id = 'p1' and target_id = (select supplier_id from suppliers where s_suppkey = 1) and type = 'CALLS')"""))
def edit_delete_edge(spark, sf):
    graph = table_graph(spark, sf)
    target = graph.entities.filter("name = 'Supplier#000000001'").select("id").scalar()
    return _edges(edit.delete_relationship(graph, "p1", target, "CALLS"))


@query("edit_rename", over_graph("""
select case when source_id = 'p0' then 'widget' else source_id end as source_id,
  case when source_id <> 'p0' and target_id = 'p0' then 'widget' else target_id end as target_id, type, line_number
from relationships"""))
def edit_rename(spark, sf):
    return _edges(edit.rename_entity(table_graph(spark, sf), "p0", "widget"))


@query("edit_rename_entities", over_entities("""
select case when id = 'p0' then 'widget' else id end as id, name, type, file_path from entities"""))
def edit_rename_entities(spark, sf):
    graph = Graph(table_entities(spark, sf), table_relationships(spark, sf))
    return edit.rename_entity(graph, "p0", "widget").entities.select("id", "name", "type", "file_path")


@query("edit_update", over_entities("""
select id, case when type = 'CLASS' then upper(name) else name end as name, type, line_number from entities"""))
def edit_update(spark, sf):
    entities = table_entities(spark, sf)
    changed = entities.filter("type = 'CLASS'").withColumn("name", F.upper("name"))
    return Graph(entities, None).add_entities(changed).entities.select("id", "name", "type", "line_number")


@query("edit_add_relationships", over_graph("""
, wanted as (select customer_id as source_id, 'p' || c_custkey as target_id from customers)
select source_id, target_id, type, line_number from relationships
union all select source_id, target_id, 'USES', 1 from wanted w
where w.target_id in (select id from entities) and w.source_id in (select id from entities)"""))
def edit_add_relationships(spark, sf):
    graph = table_graph(spark, sf)
    number = F.regexp_extract("id", "::c(\\d+)$", 1)
    wanted = graph.entities.filter(F.col("id").rlike("::c\\d+$")).select(
        F.col("id").alias("source_id"), F.concat(F.lit("p"), number).alias("target_id"),
        F.lit("USES").alias("type"), F.lit(1).alias("line_number"),
    )
    return _edges(edit.add_relationships_checked(graph, wanted))


@query("merge", over_graph("""
, other as (select id, 'copy of ' || name as name, type from entities where type = 'CLASS'
            union all select id || '_new', name, type from entities where type = 'CONSTANT')
select coalesce(o.id, e.id) as id, coalesce(o.name, e.name) as name, coalesce(o.type, e.type) as type
from entities e full outer join other o on e.id = o.id"""))
def merge(spark, sf):
    graph = table_graph(spark, sf)
    classes = graph.entities.filter("type = 'CLASS'").withColumn("name", F.concat(F.lit("copy of "), "name"))
    fresh = graph.entities.filter("type = 'CONSTANT'").withColumn("id", F.concat("id", F.lit("_new")))
    other = Graph(classes.unionByName(fresh), graph.relationships)
    return graph.merge(other).entities.select("id", "name", "type")


@query("merge_relationships", over_graph("""
select source_id, target_id, type, line_number from relationships
union all select source_id, target_id, type, line_number from relationships"""))
def merge_relationships(spark, sf):
    graph = table_graph(spark, sf)
    return _edges(graph.merge(graph))
