"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its equivalent SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# The table graph in SQL, written independently of sources.tables.
ENTITY_SQL = """
nations as (
  select n_nationkey, n_name, 'r' || n_regionkey || '::n' || n_nationkey as nation_id,
         r_name || '/' || n_name || '.py' as file_path
  from nation join region on n_regionkey = r_regionkey),
customers as (
  select c_custkey, c_name, c_mktsegment, file_path, nation_id || '::c' || c_custkey as customer_id
  from customer join nations on c_nationkey = n_nationkey),
suppliers as (
  select s_suppkey, s_name, file_path, nation_id || '::s' || s_suppkey as supplier_id
  from supplier join nations on s_nationkey = n_nationkey),
placed as (
  select o_orderkey, o_orderstatus, o_orderpriority, c_custkey, customer_id, file_path,
         customer_id || '::o' || o_orderkey as order_id
  from orders join customers on o_custkey = c_custkey),
entities as (
  select 10000000000000 + r_regionkey as ord, 'r' || r_regionkey as id, r_name as name, 'DIRECTORY' as type,
         r_name as file_path, 0 as line_number, cast(null as int) as end_line, '{}' as properties from region
  union all select 20000000000000 + n_nationkey, nation_id, n_name, 'FILE', file_path, 0, null, '{}' from nations
  union all select 30000000000000 + c_custkey, customer_id, c_name, 'CLASS', file_path,
         cast(c_custkey + 1 as int), cast(c_custkey + 10 as int), '{"description":"' || c_mktsegment || '"}' from customers
  union all select 40000000000000 + s_suppkey, supplier_id, s_name, 'CLASS', file_path,
         cast(s_suppkey + 1 as int), cast(s_suppkey + 10 as int), '{}' from suppliers
  union all select 50000000000000 + o_orderkey, order_id, 'order_' || o_orderkey,
         case when o_orderstatus = 'P' then 'ASYNC_FUNCTION' else 'FUNCTION' end, file_path,
         cast(o_orderkey + 1 as int), cast(o_orderkey + 10 as int), '{"description":"' || o_orderpriority || '"}' from placed
  union all select 60000000000000 + p_partkey, 'p' || p_partkey, p_name, 'CONSTANT', 'parts/' || p_brand || '.py',
         cast(p_partkey + 1 as int), null, '{"description":"' || p_type || '"}' from part)
"""

EDGE_SQL = """
lines as (select * from lineitem join placed on l_orderkey = o_orderkey),
base_edges as (
  select 1000000000000000 + l_orderkey * 10 + l_linenumber as ord, order_id as source_id, 'p' || l_partkey as target_id,
         'CALLS' as type, l_linenumber as line_number from lines
  union all select 2000000000000000 + l_orderkey * 10 + l_linenumber, order_id, supplier_id, 'INSTANTIATES', l_linenumber
    from lines join suppliers on l_suppkey = s_suppkey
  union all select 3000000000000000 + o_orderkey, customer_id, order_id, 'CALLS', 1 from placed
  union all select 4000000000000000 + s_suppkey, supplier_id, customer_id, 'CALLS', 1
    from suppliers join customers on s_suppkey = c_custkey
  union all select 5000000000000000 + p_partkey, 'p' || p_partkey, supplier_id, 'CALLS', 1
    from part join suppliers on s_suppkey = p_partkey % (select count(*) from supplier)
  union all select 6000000000000000 + c.c_custkey, c.customer_id, parent.c_name, 'INHERITS', 1
    from customers c join customer parent on parent.c_custkey = c.c_custkey // 2 where c.c_custkey > 0
  union all select 7000000000000000 + l_orderkey * 10 + l_linenumber, order_id, p_name, 'CALLS', l_linenumber
    from lines join part on l_partkey = p_partkey),
parts_of as (select ord, id, line_number, string_split(id, '::') as p from entities
             where contains(id, '::') and type not in ('FILE', 'MODULE')),
contains_edges as (
  select 8000000000000000 + ord * 8 + i as ord, array_to_string(p[1:i], '::') as source_id, id as target_id,
         'CONTAINS' as type, line_number
  from parts_of, unnest(range(1, len(p))) as t(i)),
relationships as (select * from base_edges union all select * from contains_edges)
"""

GRAPH_SQL = ENTITY_SQL + "," + EDGE_SQL


def over_entities(body: str) -> str:
    return f"with {ENTITY_SQL} {body}"


def over_graph(body: str) -> str:
    """Prefix a statement with the graph's CTEs; a body that starts with ``,`` adds its own."""
    return f"with recursive {GRAPH_SQL} {body}"
