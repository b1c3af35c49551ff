"""File-level edit plans from a change set.

Every part of a plan is a relation (one row per file, change, warning or snippet), so a plan over
millions of changes stays distributed; rendering streams the ordered rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.names import last_segment
from graphloom.plans.diff import ChangeSet, action_rank
from graphloom.session import materialize, union_all

# Placeholder path, voting edge types, neighbours shown per file, snippet lines.
UNKNOWN_FILE = "(unknown)"
VOTING_TYPES = ("CALLS", "USES", "INHERITS")
MAX_SNIPPETS = 10
SNIPPET_WINDOW = 10
# Execution order of file actions.
FILE_ACTIONS = ("create", "modify", "delete")


@dataclass
class EditPlan:
    """Frames of a plan.

    ``change_set`` has frames entities, relationships and neighbors, each asked for only by the parts
    that read it. ``known`` holds the existing entities (None: no existing graph given), ``files`` the
    paths that exist (column ``path``), ``sources`` file texts (path, source) for snippets.
    """

    change_set: object
    known: DataFrame | None = None
    files: DataFrame | None = None
    sources: DataFrame | None = None
    max_snippets: int = MAX_SNIPPETS

    @property
    def changes(self) -> DataFrame:
        return self.change_set.entities

    @property
    def neighbors(self) -> DataFrame:
        return self.change_set.neighbors

    def _changed_edges(self, ids: DataFrame, types: tuple[str, ...]) -> DataFrame:
        """Changed edges of ``types``, at least those that touch ``ids``."""
        if isinstance(self.change_set, ChangeSet):
            return self.change_set.relationships_near(ids, types)
        return self.change_set.relationships.filter(F.col("relationship_type").isin(*types))

    # -- target files ---------------------------------------------------------------------------

    @cached_property
    def inferred_paths(self) -> DataFrame:
        return materialize(self._inferred())

    def _inferred(self) -> DataFrame:
        """(entity_id, inferred) for added entities without a path.

        First the container's file, else the file of something it contains, else the file most of
        its call, use and inheritance targets live in; ties go to the change listed first.
        """
        blank = self.changes.filter("action = 'added' and file_path = ''").select("entity_id")
        if self.known is None:
            return blank.withColumn("inferred", F.lit(None).cast("string"))
        blank = materialize(blank)
        if blank.isEmpty():  # no edge need be read
            return blank.withColumn("inferred", F.lit(None).cast("string"))
        position = F.struct(action_rank(), "source_id", "target_id", "relationship_type").alias("at")
        edges = self._changed_edges(blank, ("CONTAINS", *VOTING_TYPES))
        edges = materialize(edges.select("source_id", "target_id", "relationship_type", position))
        known = self.known.select(F.col("id").alias("other_id"), "file_path")

        def at_end(end: str, other: str, types) -> DataFrame:
            return (
                edges.filter(F.col("relationship_type").isin(*types))
                .select(F.col(end).alias("entity_id"), F.col(other).alias("other_id"), "at")
                .join(blank, "entity_id", "left_semi")
                .join(known, "other_id")
            )

        def first_of(df: DataFrame, rank: int) -> DataFrame:
            return df.groupBy("entity_id").agg(F.min_by("file_path", "at").alias("inferred")).withColumn("rank", F.lit(rank))

        votes = (
            at_end("source_id", "target_id", VOTING_TYPES)
            .filter("file_path <> ''")
            .groupBy("entity_id", "file_path")
            .agg((-F.count(F.lit(1))).alias("votes"), F.min("at").alias("at"))
            .groupBy("entity_id")
            .agg(F.min_by("file_path", F.struct("votes", "at")).alias("inferred"))
            .withColumn("rank", F.lit(2))
        )
        found = union_all([
            first_of(at_end("target_id", "source_id", ["CONTAINS"]), 0),
            first_of(at_end("source_id", "target_id", ["CONTAINS"]), 1),
            votes,
        ])
        best = found.groupBy("entity_id").agg(F.min_by("inferred", "rank").alias("inferred"))
        return blank.join(best, "entity_id", "left").select(
            "entity_id", F.when(F.col("inferred") != "", F.col("inferred")).alias("inferred")
        )

    @cached_property
    def placed(self) -> DataFrame:
        """Changes with the file they go to."""
        return self.changes.join(self.inferred_paths, "entity_id", "left").withColumn(
            "target_file",
            F.when(F.col("file_path") != "", F.col("file_path")).otherwise(F.coalesce("inferred", F.lit(UNKNOWN_FILE))),
        )

    @cached_property
    def file_edits(self) -> DataFrame:
        """One row per file: what to do with it and how many changes it gets."""
        edits = self.placed.groupBy(F.col("target_file").alias("file_path")).agg(
            F.count_if(F.col("action") == "added").alias("added"),
            F.count_if(F.col("action") == "removed").alias("removed"),
            F.count_if(F.col("action") == "modified").alias("modified"),
        )
        if self.files is None:
            edits = edits.withColumn("exists", F.lit(False))
        else:
            present = self.files.select(F.col("path").alias("file_path"), F.lit(True).alias("exists")).distinct()
            edits = edits.join(present, "file_path", "left")
        action = (
            F.when(F.col("exists").isNull() | ~F.col("exists"), F.when(F.expr("removed + modified = 0"), "create"))
        )
        action = F.coalesce(action, F.when(F.expr("added + modified = 0"), "delete").otherwise("modify"))
        return edits.withColumn("action", action).select(
            "file_path", "action", "added", "removed", "modified",
            F.array_position(F.array(*[F.lit(a) for a in FILE_ACTIONS]), F.col("action")).cast("int").alias("action_rank"),
        )

    def execution_order(self) -> DataFrame:
        """Files in the order to work on them: creates, modifies, deletes, each by path."""
        return self.file_edits.select("file_path", "action", "action_rank").orderBy("action_rank", "file_path")

    @cached_property
    def descriptions(self) -> DataFrame:
        """One phrase per change; a file's description is its phrases in change order."""
        short = F.concat(F.lit("`"), last_segment(F.col("entity_id")), F.lit("`"))
        fields = F.array_join(F.transform("field_diffs", lambda d: d["field"]), ", ")
        phrase = (
            F.when(F.col("action") == "added", F.concat(F.lit("Add "), F.lower("entity_type"), F.lit(" "), short))
            .when(F.col("action") == "removed", F.concat(F.lit("Remove "), F.lower("entity_type"), F.lit(" "), short))
            .otherwise(F.concat(F.lit("Modify "), short, F.lit(" ("), fields, F.lit(")")))
        )
        return self.placed.select(
            F.col("target_file").alias("file_path"), "action", "entity_id", phrase.alias("phrase"), action_rank().alias("rank")
        )

    # -- warnings -------------------------------------------------------------------------------

    @cached_property
    def path_warnings(self) -> DataFrame:
        name = F.concat(F.lit("`"), "entity_id", F.lit("`"))
        suggested = F.concat(
            name, F.lit(" names no file. Suggested: `"), "inferred", F.lit("`, where its edges lead; please check"),
        )
        missing = F.concat(name, F.lit(" names no file and its edges lead to none; choose one"))
        return self.inferred_paths.select(
            F.lit(0).alias("kind"), "entity_id",
            F.when(F.col("inferred").isNotNull(), suggested).otherwise(missing).alias("warning"),
        )

    @cached_property
    def removal_warnings(self) -> DataFrame:
        """Per removed entity the first neighbour that stays behind."""
        removed = self.changes.filter("action = 'removed'").select("entity_id")
        staying = (
            self.neighbors.join(removed, "entity_id", "left_semi")
            .join(removed.withColumnRenamed("entity_id", "neighbor_id"), "neighbor_id", "left_anti")
        )
        if self.known is None:
            staying = staying.limit(0)
        else:
            staying = staying.join(self.known.select(F.col("id").alias("neighbor_id")), "neighbor_id", "left_semi")
        return staying.groupBy("entity_id").agg(F.min("neighbor_id").alias("neighbor_id")).select(
            F.lit(1).alias("kind"), "entity_id", "neighbor_id",
            F.concat(
                F.lit("`"), "entity_id", F.lit("` goes, yet `"), "neighbor_id", F.lit("` stays and is linked with it"),
            ).alias("warning"),
        )

    def warnings(self) -> DataFrame:
        return self.path_warnings.unionByName(self.removal_warnings.drop("neighbor_id"))

    # -- context --------------------------------------------------------------------------------

    @cached_property
    def context_neighbors(self) -> DataFrame:
        """The first ``max_snippets`` neighbours of each file's changes (a top-k per file, cut before the shuffle)."""
        seen = (
            self.placed.select("entity_id", F.col("target_file").alias("file_path"), action_rank().alias("rank"))
            .join(self.neighbors, "entity_id")
            .groupBy("file_path", "neighbor_id")
            .agg(F.min(F.struct("rank", "entity_id")).alias("at"))
        )
        order = Window.partitionBy("file_path").orderBy("at", "neighbor_id")
        return seen.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= self.max_snippets).select(
            "file_path", "neighbor_id", "position"
        )

    @cached_property
    def snippets(self) -> DataFrame | None:
        """Code of the shown neighbours: (file_path, position, neighbor_id, code)."""
        if self.known is None or self.sources is None:
            return None
        from graphloom.operators.context import code_slices

        wanted = self.known.select("id", F.col("file_path"), "line_number", "end_line").join(
            self.context_neighbors.select(F.col("file_path").alias("edit_file"), F.col("neighbor_id").alias("id"), "position"), "id"
        )
        return (
            code_slices(wanted, self.sources, SNIPPET_WINDOW, strip=False)
            .filter("code is not null")
            .select(F.col("edit_file").alias("file_path"), "position", F.col("id").alias("neighbor_id"), "code")
        )


def edit_plan(
    changes, known: DataFrame | None = None, files: DataFrame | None = None, sources: DataFrame | None = None, max_snippets: int = MAX_SNIPPETS
) -> EditPlan:
    """Plan for a ``ChangeSet`` (or anything with entities, relationships and neighbors frames)."""
    return EditPlan(changes, known, files, sources, max_snippets)
