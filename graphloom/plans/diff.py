"""Structural difference of two graphs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.names import SEPARATOR
from graphloom.graph import Graph, ParsedGraph
from graphloom.session import materialize, union_all

# Entity fields that count as a modification, in report order.
COMPARED_FIELDS = ("name", "type", "file_path", "line_number", "end_line", "properties")
SNAPSHOT_FIELDS = ("id",) + COMPARED_FIELDS
# Report order of actions.
ACTION_RANK = {"added": 0, "removed": 1, "modified": 2}
#: Parallel edges that are written out from one row at a time.
COPIES = 2**16


def action_rank(column: str = "action") -> Column:
    rank = F.lit(len(ACTION_RANK))
    for action, value in ACTION_RANK.items():
        rank = F.when(F.col(column) == action, value).otherwise(rank)
    return rank


def diff_entities(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Added, removed and modified entities, from one full outer join on the id.

    ``field_diffs`` lists (field, old, new) as text; properties compare as canonical JSON.
    """
    old = existing.select("id", F.struct(*SNAPSHOT_FIELDS).alias("before"))
    new = proposed.select("id", F.struct(*SNAPSHOT_FIELDS).alias("after"))
    both = old.join(new, "id", "full_outer")
    pairs = F.array(*[
        F.struct(
            F.lit(f).alias("field"),
            F.col("before")[f].cast("string").alias("old"),
            F.col("after")[f].cast("string").alias("new"),
        )
        for f in COMPARED_FIELDS
    ])
    is_old, is_new = F.col("before").isNotNull(), F.col("after").isNotNull()
    changed = F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))
    diffs = F.when(is_old & is_new, changed).otherwise(F.filter(pairs, lambda p: F.lit(False)))
    shown = F.coalesce("after", "before")
    return (
        both.withColumn("field_diffs", diffs)
        .withColumn("action", F.when(~is_old, "added").when(~is_new, "removed").when(F.size("field_diffs") > 0, "modified"))
        .filter("action is not null")
        .select(
            "action", F.col("id").alias("entity_id"),
            F.coalesce(shown["file_path"], F.lit("")).alias("file_path"),
            F.coalesce(shown["type"], F.lit("")).alias("entity_type"),
            "before", "after", "field_diffs",
        )
    )


def unlike_entities(parsed: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames without the rows that are in each of them once, compared within their files.

    ``parsed`` are entities of a parse: bucketed by file, one per id, and the id begins with the file's
    path. So equal rows meet where they lie, and only the others are looked up by id afterwards. A path
    with the separator in it could share its ids with another one: such rows stay.
    """
    # Sides are told apart by a generator: the union keeps the buckets of both, which it does not behind a projection.
    sides = [rows.select(*SNAPSHOT_FIELDS, F.explode(F.array(F.lit(n))).alias("is_new")) for rows, n in ((parsed, 0), (proposed, 1))]
    counted = union_all(sides).groupBy(*SNAPSHOT_FIELDS).agg(F.count(F.lit(1)).alias("n"), F.sum("is_new").alias("new"))
    counted = counted.select(*SNAPSHOT_FIELDS, "new", (F.col("n") - F.col("new")).alias("old"))
    own = (F.substring_index("id", SEPARATOR, 1) == F.col("file_path")) & (F.col("old") == 1) & (F.col("new") == 1)
    unlike = materialize(counted.filter(~F.coalesce(own, F.lit(False))))

    def side(n: str) -> DataFrame:
        return unlike.filter(F.col(n) > 0).select(*SNAPSHOT_FIELDS, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop("col")

    return side("old"), side("new")


def diff_relationships(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Added and removed (source, target, type) keys; of parallel edges the last one is reported.

    Both sides are tagged and aggregated together: one shuffle, with parallel edges already
    merged before it.
    """
    key = ["source_id", "target_id", "type"]
    data = ["line_number", "weight", "is_resolved", "properties"]
    tagged = existing.select(*key, *data, "ord", F.lit(False).alias("is_new")).unionByName(
        proposed.select(*key, *data, "ord", F.lit(True).alias("is_new"))
    )
    return (
        tagged.groupBy(*key)
        .agg(
            F.bool_or("is_new").alias("in_new"),
            F.bool_and("is_new").alias("only_new"),
            F.max_by(F.struct(*data), "ord").alias("d"),
        )
        .filter("only_new or not in_new")
        .select(
            F.when(F.col("only_new"), "added").otherwise("removed").alias("action"),
            "source_id", "target_id", F.col("type").alias("relationship_type"),
            *[F.col("d")[c].alias(c) for c in data],
        )
    )


def changed_keys(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Action and key of what ``diff_relationships`` finds; nothing else of an edge is moved or kept."""
    key = ["source_id", "target_id", "type"]
    tagged = existing.select(*key, F.lit(False).alias("is_new")).unionByName(proposed.select(*key, F.lit(True).alias("is_new")))
    return (
        tagged.groupBy(*key)
        .agg(F.bool_or("is_new").alias("in_new"), F.bool_and("is_new").alias("only_new"))
        .filter("only_new or not in_new")
        .select(
            F.when(F.col("only_new"), "added").otherwise("removed").alias("action"),
            "source_id", "target_id", F.col("type").alias("relationship_type"),
        )
    )


def neighbor_pairs(relationships: DataFrame) -> DataFrame:
    """Distinct undirected neighbours (entity_id, neighbor_id); a self-loop neighbours itself."""
    return relationships.select(
        F.inline(
            F.array(
                F.struct(F.col("source_id").alias("entity_id"), F.col("target_id").alias("neighbor_id")),
                F.struct(F.col("target_id").alias("entity_id"), F.col("source_id").alias("neighbor_id")),
            )
        )
    )


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with an end among ``ids`` (one column), each once."""
    column = ids.columns[0]
    ids = ids.select(column).distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col(column).alias(end), F.lit(True).alias(f"{end}_asked")), end, "left")
    return edges.filter("source_id_asked or target_id_asked").drop("source_id_asked", "target_id_asked")


def change_neighbors(changes: DataFrame, existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Neighbours of changed entities as rows; removed ones look at the existing graph.

    Rows instead of one list per entity: a changed hub may have unboundedly many neighbours.
    """
    removed = changes.filter("action = 'removed'").select("entity_id")
    others = changes.filter("action <> 'removed'").select("entity_id")
    return (
        neighbor_pairs(existing).join(removed, "entity_id", "left_semi")
        .unionByName(neighbor_pairs(proposed).join(others, "entity_id", "left_semi"))
        .distinct()
    )


@dataclass
class ChangeSet:
    """The difference of two graphs as frames.

    The changes are written when first asked for: every later step (neighbours, overlay, edit
    plan) reads these small tables instead of comparing the graphs again.
    """

    existing: Graph
    proposed: Graph

    @cached_property
    def entities(self) -> DataFrame:
        old, new = self.existing.entities, self.proposed.entities
        if isinstance(self.existing, ParsedGraph):
            old, new = unlike_entities(old, new)
        return materialize(diff_entities(old, new))

    @cached_property
    def relationships(self) -> DataFrame:
        return materialize(diff_relationships(self.existing.relationships, self.proposed.relationships))

    @property
    def relationship_keys(self) -> DataFrame:
        """(action, source_id, target_id, relationship_type) of the changed edges, for what shows no more of them."""
        if "relationships" in self.__dict__:
            return self.relationships.select("action", "source_id", "target_id", "relationship_type")
        return changed_keys(self.existing.relationships, self.proposed.relationships)

    def relationships_near(self, ids: DataFrame, types: tuple[str, ...]) -> DataFrame:
        """Actions and keys of the changed edges of ``types`` that touch ``ids`` (one column); other edges are
        left out before the versions are compared, as an edge and its changes have the same key."""
        if "relationships" in self.__dict__:
            return touching(self.relationships.filter(F.col("relationship_type").isin(*types)), ids)
        near = [touching(g.links.filter(F.col("type").isin(*types)), ids) for g in (self.existing, self.proposed)]
        return changed_keys(*near)

    @cached_property
    def neighbors(self) -> DataFrame:
        return materialize(change_neighbors(self.entities, self.existing.links, self.proposed.links))

    def summary(self) -> DataFrame:
        return change_summary(self.entities, self.relationships)


def diff_graphs(existing: Graph, proposed: Graph) -> ChangeSet:
    """The difference of two graphs. No version is written: each comparison reads a side once, and
    later steps read the written changes."""
    return ChangeSet(existing, proposed)


def change_summary(entity_changes: DataFrame, relationship_changes: DataFrame) -> DataFrame:
    """One row with the five counts."""
    kinds = union_all([
        entity_changes.select(F.lit("entities").alias("kind"), "action"),
        relationship_changes.select(F.lit("relationships").alias("kind"), "action"),
    ])

    def count(kind: str, action: str) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("action") == action)).alias(f"{kind}_{action}")

    return kinds.agg(
        count("entities", "added"), count("entities", "removed"), count("entities", "modified"),
        count("relationships", "added"), count("relationships", "removed"),
    )


def has_changes(changes: ChangeSet) -> bool:
    return not changes.entities.isEmpty() or not changes.relationships.isEmpty()


def fingerprint(graph: Graph) -> DataFrame:
    """One-row ``sha256:…`` digest of a graph's content; equal graphs get equal digests."""
    from graphloom.sources.snapshot import digest

    rows = graph.entities.select(F.to_json(F.struct(F.lit("e"), *SNAPSHOT_FIELDS)).alias("text")).unionByName(
        graph.relationships.select(
            F.to_json(
                F.struct(F.lit("r"), "source_id", "target_id", "type", "line_number", "weight", "is_resolved", "properties")
            ).alias("text")
        )
    )
    return digest(rows).select(F.concat(F.lit("sha256:"), "digest").alias("fingerprint"))


# ---- viewer overlay ---------------------------------------------------------------------------

def classify(changes: ChangeSet) -> tuple[DataFrame, DataFrame]:
    """Changed ids and changed edge keys, each with its action."""
    edges = changes.relationship_keys.select(
        F.concat_ws("::", "source_id", "target_id", "relationship_type").alias("edge_key"), "action"
    )
    nodes = changes.entities if "entities" in changes.__dict__ else diff_entities(changes.existing.entities, changes.proposed.entities)
    return nodes.select(F.col("entity_id").alias("id"), "action"), edges


def overlay_nodes(changes: ChangeSet) -> DataFrame:
    """Proposed entities with their diff status, plus ghosts of the removed ones."""
    status = changes.entities.select(F.col("entity_id").alias("id"), F.col("action").alias("diff_status"))
    shown = changes.proposed.entities.join(status, "id", "left").select("id", "name", "type", "diff_status")
    ghosts = changes.entities.filter("action = 'removed'").selectExpr(
        "entity_id as id", "before.name as name", "before.type as type", "'removed' as diff_status"
    )
    return shown.unionByName(ghosts)


def overlay_edges(changes: ChangeSet) -> DataFrame:
    """Proposed edges with their status, plus removed edges whose two ends are shown.

    Keys of both versions are counted together: one shuffle, with parallel edges merged before it. What
    is shown are the ids of either version, as removed entities stay as ghosts.
    """
    key = ["source_id", "target_id", "relationship_type"]
    sides = [
        graph.relationships.select("source_id", "target_id", F.col("type").alias("relationship_type"), F.lit(old).alias("old"), F.lit(n).alias("n"))
        for graph, old, n in ((changes.existing, True, 0), (changes.proposed, False, 1))
    ]
    counted = union_all(sides).groupBy(*key).agg(F.sum("n").alias("n_new"), F.bool_or("old").alias("in_old"))
    # A key without an end or type equals no other one, so its edges have no status.
    known = F.concat(*key).isNotNull()
    runs = counted.filter("n_new > 0").select(
        *key, F.when(known & ~F.col("in_old"), "added").alias("diff_status"), "n_new",
        F.explode(F.expr(f"sequence(0L, n_new - 1, {COPIES}L)")).alias("first"),
    )
    shown = runs.select(*key, "diff_status", F.explode(F.expr(f"sequence(first, least(first + {COPIES}, n_new) - 1)"))).drop("col")
    ids = changes.existing.entities.select("id").unionByName(changes.proposed.entities.select("id"))
    # Keys that depend on a count let no filter of the joins below sink under the counting, which is shared so.
    ends = [F.when(F.col("n_new") == 0, F.col(c)).alias(c) for c in key]
    ghosts = counted.filter("n_new = 0 and in_old").select(*ends, F.lit("removed").alias("diff_status"))
    for end in ("source_id", "target_id"):
        ghosts = ghosts.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return shown.unionByName(ghosts.select(*key, "diff_status"))
