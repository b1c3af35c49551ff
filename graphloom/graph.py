"""The property graph: two DataFrames and the set operations on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.names import SEPARATOR, ancestor_ids
from graphloom.schema import ENTITY_COLUMNS, ENTITY_SCHEMA, RELATIONSHIP_COLUMNS, RELATIONSHIP_SCHEMA
from graphloom.session import materialize


@dataclass(frozen=True)
class Graph:
    """Entities (one row per id) and relationships (a multiset), both ordered by ``ord``.

    ``stored`` says the frames read written tables, so iterative operators need not write the
    edges again.
    """

    entities: DataFrame
    relationships: DataFrame
    stored: bool = False

    @property
    def spark(self):
        return self.entities.sparkSession

    @property
    def links(self) -> DataFrame:
        """Ends and types of the edges (source_id, target_id, type), for what asks for no more of them."""
        return self.relationships.select("source_id", "target_id", "type")

    @property
    def inherits(self) -> DataFrame:
        return self.relationships.filter("type = 'INHERITS'")

    @property
    def contained_functions(self) -> DataFrame:
        return self.relationships.filter("type = 'CONTAINS'")

    @property
    def calls(self) -> DataFrame:
        return self.relationships.filter("type = 'CALLS'")

    def materialized(self) -> "Graph":
        """The same graph backed by written tables in the scratch folder."""
        if self.stored:
            return self
        return Graph(materialize(self.entities), materialize(self.relationships), stored=True)

    def add_entities(self, rows: DataFrame) -> "Graph":
        """Upsert: a known id keeps its position and takes the new values."""
        return Graph(upsert_entities(self.entities, rows), self.relationships)

    def add_relationships(self, rows: DataFrame) -> "Graph":
        """Append; parallel edges stay apart."""
        shifted = _after(self.relationships, complete_relationships(rows))
        return Graph(self.entities, self.relationships.unionByName(shifted))

    def merge(self, other: "Graph") -> "Graph":
        """Other's entities win on equal ids; relationships are concatenated."""
        return Graph(
            upsert_entities(self.entities, other.entities),
            self.relationships.unionByName(_after(self.relationships, other.relationships)),
        )


class ParsedGraph(Graph):
    """A stored graph whose edges are written when they are first asked for: what reads entities only
    neither numbers nor writes them. ``span`` is a number above all of its positions; ``numbered`` turns
    facts into numbered edges, ``linked`` into edges without positions, and ``facts`` are all of them."""

    def __init__(
        self, entities: DataFrame, facts: DataFrame, numbered: Callable[[DataFrame], DataFrame],
        linked: Callable[[DataFrame], DataFrame], span: int,
    ):
        values = {"entities": entities, "facts": facts, "numbered": numbered, "linked": linked, "span": span, "stored": True}
        for name, value in values.items():
            object.__setattr__(self, name, value)

    @cached_property
    def relationships(self) -> DataFrame:
        return materialize(self.numbered(self.facts))

    @property
    def written(self) -> bool:
        """Whether the edges have been written."""
        return "relationships" in self.__dict__

    @property
    def links(self) -> DataFrame:
        rows = self.relationships if self.written else self.linked(self.facts)
        return rows.select("source_id", "target_id", "type")

    def with_entities(self, entities: DataFrame) -> "ParsedGraph":
        """The same edges with other entities."""
        return ParsedGraph(entities, self.facts, self.numbered, self.linked, self.span)

    def edges_from(self, ids: DataFrame) -> DataFrame:
        """Edges among which are all that leave ``ids`` (column ``id``), from the facts of their files alone.

        An edge starts at its file or below it, so the path is a ``::`` prefix of the id. Only a path that
        holds the separator itself has prefixes outside of its file; such files are always read.
        """
        if self.written:
            return self.relationships
        prefixes = F.concat(ancestor_ids(F.col("id")), F.array("id"))
        paths = materialize(ids.select(F.explode(prefixes).alias("path")).distinct()).withColumn("asked", F.lit(True))
        near = self.facts.join(paths, "path", "left").filter(F.col("asked") | F.col("path").contains(SEPARATOR))
        return self.numbered(near.select(*self.facts.columns))

    def edges_of(self, type_: str, *kinds: str) -> DataFrame:
        """Edges of a type that facts of ``kinds`` give, from those facts alone: in the order of
        ``relationships`` but with positions of their own where those are not written."""
        if self.written:
            return self.relationships.filter(F.col("type") == type_)
        return materialize(self.numbered(self.facts.filter(F.col("kind").isin(*kinds))).filter(F.col("type") == type_))

    @cached_property
    def inherits(self) -> DataFrame:
        return self.edges_of("INHERITS", "class")

    @cached_property
    def contained_functions(self) -> DataFrame:
        """CONTAINS edges, at least those to functions."""
        return self.edges_of("CONTAINS", "function", "async")

    @cached_property
    def calls(self) -> DataFrame:
        return self.edges_of("CALLS", "call")


def complete_entities(rows: DataFrame) -> DataFrame:
    """Fill in missing optional entity columns and put all in the table's order and types."""
    return _complete(rows, ENTITY_SCHEMA, {"properties": "{}", "ord": 0})


def complete_relationships(rows: DataFrame) -> DataFrame:
    """Fill in missing optional relationship columns."""
    return _complete(rows, RELATIONSHIP_SCHEMA, {"weight": 1.0, "is_resolved": False, "properties": "{}", "ord": 0})


def _complete(rows: DataFrame, schema, defaults: dict) -> DataFrame:
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in rows.columns else F.lit(defaults.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def _after(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Shift ``ord`` of ``added`` behind ``existing``; both maxima are one-row scalar subqueries."""
    last = existing.agg(F.coalesce(F.max("ord"), F.lit(0))).scalar()
    first = added.agg(F.coalesce(F.min("ord"), F.lit(0))).scalar()
    return added.withColumn("ord", F.col("ord") - first + last + F.lit(1))


def upsert_entities(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Last value wins per id, first position is kept."""
    rows = existing.select(*ENTITY_COLUMNS).unionByName(_after(existing, complete_entities(added)))
    return last_per_id(rows)


def last_per_id(rows: DataFrame) -> DataFrame:
    """One row per id: the values of the last ``ord``, the position of the first.

    ``max_by``/``min`` aggregate before the shuffle, so a hot id never gathers in one task.
    """
    values = F.struct(*[c for c in ENTITY_COLUMNS if c not in ("ord", "id")])
    return (
        rows.groupBy("id")
        .agg(F.min("ord").alias("ord"), F.max_by(values, "ord").alias("v"))
        .select("ord", "id", *[F.col("v")[c].alias(c) for c in ENTITY_COLUMNS if c not in ("ord", "id")])
    )


def row_numbers(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with consecutive numbers (0, 1, …) in that order, without a one-task ranking.

    A range sort numbers rows inside each partition; the offsets come from a running sum over one
    row per partition.
    """
    slot = rows.orderBy(*order).withColumn("slot", F.monotonically_increasing_id())
    placed = materialize(slot).selectExpr(*rows.columns, "shiftright(slot, 33) as part", "slot & 8589934591L as row")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").selectExpr(*rows.columns, f"offset + row as {name}")


def dense_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """Consecutive numbers (0, 1, …) of distinct keys in their order."""
    return row_numbers(df.select(key).distinct(), name, key)


__all__ = [
    "Graph", "ParsedGraph", "complete_entities", "complete_relationships", "upsert_entities", "last_per_id",
    "row_numbers", "dense_numbers", "ENTITY_COLUMNS", "RELATIONSHIP_COLUMNS",
]
