"""A property graph over the star-schema tables: the data every graph operator is checked on.

Ids are hierarchical (``r0::n3::c7::o42``), so prefix and containment operators apply too. Every
edge family is a plain projection or key join of the tables; nothing is collected per group.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.graph import Graph
from graphloom.operators.containment import containment_edges
from graphloom.session import union_all

ENTITY_BAND = 10**13
EDGE_BAND = 10**15

# The tables' column types (given, so that no scan has to infer them).
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


class TableGraph:
    """The frames the table graph is made of; each is built once and shared by its users."""

    def __init__(self, spark: SparkSession, sf_dir: str, without: str | None = None):
        """``without`` is a condition on orders: they and all edges that touch them are left out."""
        self.spark, self.sf_dir, self.without = spark, sf_dir, without

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def nations(self) -> DataFrame:
        region = self.table("region")
        return (
            self.table("nation").join(region, F.expr("n_regionkey = r_regionkey"))
            .selectExpr(
                "n_nationkey", "n_name",
                "concat('r', n_regionkey, '::n', n_nationkey) as nation_id",
                "concat(r_name, '/', n_name, '.py') as file_path",
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").join(self.nations, F.expr("c_nationkey = n_nationkey")).selectExpr(
            "c_custkey", "c_name", "c_mktsegment", "file_path", "concat(nation_id, '::c', c_custkey) as customer_id"
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.table("supplier").join(self.nations, F.expr("s_nationkey = n_nationkey")).selectExpr(
            "s_suppkey", "s_name", "file_path", "concat(nation_id, '::s', s_suppkey) as supplier_id"
        )

    @cached_property
    def all_orders(self) -> DataFrame:
        return self.table("orders").join(self.customers, F.expr("o_custkey = c_custkey")).selectExpr(
            "o_orderkey", "o_orderstatus", "o_orderpriority", "customer_id", "c_custkey", "file_path",
            "concat(customer_id, '::o', o_orderkey) as order_id",
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.all_orders if self.without is None else self.all_orders.filter(~F.coalesce(F.expr(self.without), F.lit(False)))

    def named(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` whose free text ``name``, an edge's target, is no id of an order left out."""
        if self.without is None:
            return rows
        return rows.join(self.all_orders.filter(self.without).select(F.col("order_id").alias(name)), name, "left_anti")

    @cached_property
    def lines(self) -> DataFrame:
        lineitem = self.table("lineitem").selectExpr(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber as line_number",
            "l_orderkey * 10 + l_linenumber as line_key",
        )
        return lineitem.join(self.orders.select("o_orderkey", "order_id"), F.expr("l_orderkey = o_orderkey"))

    @cached_property
    def entities(self) -> DataFrame:
        def rows(df, band, key, id_expr, type_expr, name, path, line="0", end="null", properties="'{}'"):
            return df.selectExpr(
                f"{band * ENTITY_BAND} + {key} as ord", f"{id_expr} as id", f"{name} as name",
                f"{type_expr} as type", f"{path} as file_path", f"cast({line} as int) as line_number",
                f"cast({end} as int) as end_line", f"{properties} as properties",
            )

        def described(column):
            return f"to_json(named_struct('description', {column}))"

        def span(key):
            return {"line": f"{key} + 1", "end": f"{key} + 10"}

        return union_all([
            rows(self.table("region"), 1, "r_regionkey", "concat('r', r_regionkey)", "'DIRECTORY'", "r_name", "r_name"),
            rows(self.nations, 2, "n_nationkey", "nation_id", "'FILE'", "n_name", "file_path"),
            rows(self.customers, 3, "c_custkey", "customer_id", "'CLASS'", "c_name", "file_path",
                 **span("c_custkey"), properties=described("c_mktsegment")),
            rows(self.suppliers, 4, "s_suppkey", "supplier_id", "'CLASS'", "s_name", "file_path", **span("s_suppkey")),
            rows(self.orders, 5, "o_orderkey", "order_id",
                 "if(o_orderstatus = 'P', 'ASYNC_FUNCTION', 'FUNCTION')", "concat('order_', o_orderkey)",
                 "file_path", **span("o_orderkey"), properties=described("o_orderpriority")),
            rows(self.table("part"), 6, "p_partkey", "concat('p', p_partkey)", "'CONSTANT'", "p_name",
                 "concat('parts/', p_brand, '.py')", line="p_partkey + 1", properties=described("p_type")),
        ])

    @cached_property
    def base_relationships(self) -> DataFrame:
        """All edge families except containment."""

        def rows(df, band, key, type_name, source, target, line="1"):
            return df.selectExpr(
                f"{band * EDGE_BAND} + {key} as ord", f"{source} as source_id", f"{target} as target_id",
                f"'{type_name}' as type", f"{line} as line_number",
                "1D as weight", "false as is_resolved", "'{}' as properties",
            )

        suppliers = self.suppliers.select("s_suppkey", "supplier_id")
        customers = self.customers.select("c_custkey", "customer_id")
        part = self.table("part")
        # The number of suppliers is a one-row scalar subquery, not a join.
        supplier_count = self.table("supplier").agg(F.count(F.lit(1))).scalar()
        sourced = part.select("p_partkey", (F.col("p_partkey") % supplier_count).alias("via"))
        parents = self.named(self.table("customer").selectExpr("c_custkey as parent_key", "c_name as parent_name"), "parent_name")
        named = self.lines.join(
            self.named(part.select("p_partkey", "p_name"), "p_name"), F.expr("l_partkey = p_partkey")
        )
        return union_all([
            rows(self.lines, 1, "line_key", "CALLS", "order_id", "concat('p', l_partkey)", "line_number"),
            rows(self.lines.join(suppliers, F.expr("l_suppkey = s_suppkey")),
                 2, "line_key", "INSTANTIATES", "order_id", "supplier_id", "line_number"),
            rows(self.orders, 3, "o_orderkey", "CALLS", "customer_id", "order_id"),
            rows(suppliers.join(customers, F.expr("s_suppkey = c_custkey")),
                 4, "s_suppkey", "CALLS", "supplier_id", "customer_id"),
            rows(sourced.join(suppliers, F.expr("via = s_suppkey")),
                 5, "p_partkey", "CALLS", "concat('p', p_partkey)", "supplier_id"),
            rows(customers.filter("c_custkey > 0").join(parents, F.expr("c_custkey div 2 = parent_key")),
                 6, "c_custkey", "INHERITS", "customer_id", "parent_name"),
            rows(named, 7, "line_key", "CALLS", "order_id", "p_name", "line_number"),
        ])

    @cached_property
    def relationships(self) -> DataFrame:
        nested = containment_edges(self.entities).selectExpr(
            f"{8 * EDGE_BAND} + ord * 8 + level as ord", "source_id", "target_id", "type", "line_number",
            "1D as weight", "false as is_resolved", "'{}' as properties",
        )
        return self.base_relationships.unionByName(nested)


def table_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableGraph(spark, sf_dir).entities


def table_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableGraph(spark, sf_dir).relationships


def table_graph(spark: SparkSession, sf_dir: str, containment: bool = True) -> Graph:
    tables = TableGraph(spark, sf_dir)
    return Graph(tables.entities, tables.relationships if containment else tables.base_relationships)


def proposed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A deterministic second version of the table graph, for diffs and edit plans.

    By ``o_orderkey % 100``: 0 removed, 1 retyped, 2 moved end line, 4 other description,
    3 gains a sibling ``…x`` that calls ``p0`` (every second one without a file path, and every
    second of those contained in the order's customer).
    """
    base = table_graph(spark, sf_dir)
    step = f"if(ord between {5 * ENTITY_BAND} and {6 * ENTITY_BAND - 1}, ord % 100, -1)"
    entities = base.entities.filter(f"{step} <> 0").selectExpr(
        "ord", "id", "name", f"if({step} = 1, 'CLASS', type) as type", "file_path", "line_number",
        f"if({step} = 2, end_line + 5, end_line) as end_line",
        f"""if({step} = 4, '{{"description":"revised"}}', properties) as properties""",
    )
    siblings = base.entities.filter(f"{step} = 3").selectExpr(
        f"ord + {4 * ENTITY_BAND} as ord", "concat(id, 'x') as id", "concat(name, 'x') as name",
        "'FUNCTION' as type", "if(ord % 200 = 3, '', file_path) as file_path", "line_number",
        "cast(null as int) as end_line", "'{}' as properties",
    )
    # Orders are ends of edges by their own rows, so they are left out of the tables; only names may equal their ids.
    without = TableGraph(spark, sf_dir, f"o_orderkey between 0 and {ENTITY_BAND - 1} and o_orderkey % 100 = 0")
    kept = without.relationships.filter(f"not ord between {4 * EDGE_BAND} and {5 * EDGE_BAND - 1}")
    calls = siblings.selectExpr(
        f"{9 * EDGE_BAND} + ord as ord", "id as source_id", "'p0' as target_id", "'CALLS' as type", "line_number",
        "1D as weight", "false as is_resolved", "'{}' as properties",
    )
    contained = siblings.filter("ord % 400 = 3").selectExpr(
        f"8 * {EDGE_BAND} + ord as ord", "regexp_replace(id, '::[^:]*$', '') as source_id", "id as target_id",
        "'CONTAINS' as type", "line_number", "1D as weight", "false as is_resolved", "'{}' as properties",
    )
    return Graph(entities.unionByName(siblings), union_all([kept, calls, contained]))
