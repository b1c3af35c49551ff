"""A Python code base derived from the tables, one source file per row.

Extraction and resolution are exercised on it: its size grows with the tables, every file is
formatted from a single row (no grouping), and what must come out follows from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.session import union_all
from graphloom.sources.tables import TableGraph

# Source templates. ``{x}`` is replaced by the SQL expression of that name.
PACKAGE_FILE = """from .core import Customer{ck}
"""
CORE_FILE = '''"""{c_name}"""
import os
from typing import Optional
{parent_import}

SEGMENT = '{segment}'
balance: float = 1.5

class Customer{ck}({parent}):
    rank = {ck}

    def __init__(self, name, *, limit: int = 0, **extra) -> None:
        label = name
        self.label = label

    def m{method}(self):
        return audit(self.label)

    async def refresh(self, value):
        note = Ledger(value)
        return value.strip()
'''
ORDER_FILE = """from {package} import Customer{ck}
from parts.p{pk} import price_{pk} as price
from shop.pay import settle

STATUS = '{status}'

def submit_{ok}(qty: int) -> float:
    owner = Customer{ck}('x')
    owner.m{method}()
    part: Part{pk} = price(qty)
    part.label()
    mark = Tag()
    mark.text()
    total = helper(qty)
    return settle(total) + price_{other}(qty)

def helper(qty):
    note = log(qty)
    return note
"""
PART_FILE = '''"""{p_name}"""
SIZE = {size}

class Part{pk}:
    """{p_type}"""
    def label(self):
        return '{brand}'

class Tag:
    def text(self):
        return SIZE

def price_{pk}(qty):
    tag = Tag()
    return qty * SIZE
'''
SUPPLIER_FILE = """from p{pk} import Part{pk} as Base
import json

class Supplier{sk}(Base, enum.Enum):
    @staticmethod
    @retry(times=3)
    def ship(item: str, /, when=None, *args: int):
        if item:
            import time
            pause = time.sleep(1)
        def inner(a):
            deep = Inner(a)
            return ping(a)
        return inner(item)
"""


def _formatted(template: str, **values: str) -> str:
    """SQL expression for a template: literals and column expressions joined by ``concat``."""
    pieces, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [_literal(text), f"cast({values[name]} as string)"]
    pieces.append(_literal(rest))
    return f"concat({', '.join(pieces)})"


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def table_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files as (path, content)."""
    tables = TableGraph(spark, sf_dir)
    part_count = tables.table("part").agg(F.count(F.lit(1))).scalar()
    nations = tables.table("nation").selectExpr("n_nationkey", "concat('r', n_regionkey, '/n', n_nationkey) as nation_dir")
    customers = (
        tables.table("customer").join(nations, F.expr("c_nationkey = n_nationkey"))
        .selectExpr("c_custkey", "c_name", "c_mktsegment", "concat(nation_dir, '/c', c_custkey) as folder")
    )
    parents = customers.selectExpr("c_custkey as parent_key", "folder as parent_folder")
    cores = customers.join(parents, F.expr("c_custkey > 0 and c_custkey div 2 = parent_key"), "left")
    orders = tables.table("orders").join(customers, F.expr("o_custkey = c_custkey")).withColumn("parts", part_count)
    suppliers = tables.table("supplier").withColumn("parts", part_count)

    dotted = "translate({}, '/', '.')".format
    return union_all([
        customers.selectExpr("concat(folder, '/__init__.py') as path", f"{_formatted(PACKAGE_FILE, ck='c_custkey')} as content"),
        cores.selectExpr(
            "concat(folder, '/core.py') as path",
            _formatted(
                CORE_FILE, c_name="c_name", ck="c_custkey", segment="c_mktsegment", method="c_custkey % 7",
                parent="if(parent_key is null, 'Base', concat('Customer', parent_key))",
                parent_import="if(parent_key is null, 'from base.kit import Base', "
                              f"concat('from ', {dotted('parent_folder')}, ' import Customer', parent_key))",
            ) + " as content",
        ),
        orders.selectExpr(
            "concat(folder, '/o', o_orderkey, '.py') as path",
            _formatted(
                ORDER_FILE, package=dotted("folder"), ck="c_custkey", ok="o_orderkey", status="o_orderstatus",
                pk="o_orderkey % parts", method="o_orderkey % 7", other="(o_orderkey * 3 + 1) % parts",
            ) + " as content",
        ),
        tables.table("part").selectExpr(
            "concat('parts/p', p_partkey, '.py') as path",
            _formatted(PART_FILE, p_name="p_name", size="p_size", pk="p_partkey", p_type="p_type", brand="p_brand") + " as content",
        ),
        suppliers.selectExpr(
            "concat('suppliers/s', s_suppkey, '.py') as path",
            _formatted(SUPPLIER_FILE, pk="s_suppkey % parts", sk="s_suppkey") + " as content",
        ),
    ])
