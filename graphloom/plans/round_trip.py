"""Build or load, diff, plan: the whole way from a proposed graph to file edits."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from graphloom.plans.diff import diff_graphs
from graphloom.plans.edit_plan import EditPlan, edit_plan
from graphloom.plans.render import ChangeSpec, change_spec, change_spec_dict, markdown_chunks, plan_dict
from graphloom.sources.files import decoded, python_files, read_files
from graphloom.sources.graph_json import read_graph_json
from graphloom.sources.snapshot import build_from_path

NO_CHANGES = "No changes detected between existing and proposed KG."


def plan_for(spark: SparkSession, spec: ChangeSpec, codebase: str, known=None) -> EditPlan:
    """Plan against a code base: its files decide create or modify, its text gives snippets.

    Paths in a graph may be relative to the code base or to the working folder; both are known.
    """
    files = python_files(spark, codebase, suffix="")  # any file may be the target of a change
    prefix = codebase.rstrip("/") + "/"
    inside = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 2**31 - 1)).otherwise(F.col("path"))
    texts = decoded(read_files(files))
    both = F.explode(F.array_distinct(F.array("path", inside))).alias("path")
    return edit_plan(spec, known, files.select(both), texts.select(both, "source"))


def run_round_trip(
    spark: SparkSession, codebase: str, proposed_path: str, existing_path: str | None = None,
    exclude_patterns: list[str] | None = None, dry_run: bool = True,
) -> dict:
    """Returns a dictionary and never raises. Nothing is executed, so ``dry_run`` changes nothing."""
    try:
        existing = (
            read_graph_json(spark, existing_path) if existing_path else build_from_path(spark, codebase, exclude_patterns)
        )
        changes = diff_graphs(existing, read_graph_json(spark, proposed_path))
        spec = change_spec(changes)
        result = {"success": True, "change_spec": change_spec_dict(spec), "summary": spec.summary, "error": None}
        if not any(spec.summary.values()):
            return result | {"edit_plan": {}, "markdown_plan": NO_CHANGES, "warnings": []}
        plan = plan_for(spark, spec, codebase, existing.entities)
        shown = plan_dict(plan, spec.summary, codebase)
        return result | {"edit_plan": shown, "markdown_plan": "".join(markdown_chunks(plan)), "warnings": shown["warnings"]}
    except Exception as error:  # the tool contract: report, do not raise
        return {"success": False, "change_spec": {}, "edit_plan": {}, "markdown_plan": "", "summary": {},
                "warnings": [], "error": str(error)}
