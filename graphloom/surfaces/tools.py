"""Dictionary-returning tools. Each returns ``{"success": bool, …}`` and never raises.

Lists in the results are what the tool reports; the caps among them (``max_results``) are part of
the tools' contract.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import context, impact, neighbors, resolve, search, stats, traverse

TOOLS: dict[str, object] = {}


def register_tool(name: str):
    """Add a function to the tool registry."""

    def wrap(fn):
        TOOLS[name] = fn
        return fn

    return wrap


def reports(**empty):
    """Turn errors into ``success: False`` with the tool's empty result."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(*args, **kwargs):
            try:
                return {"success": True} | fn(*args, **kwargs)
            except Exception as error:
                return {"success": False, "error": str(error.args[0] if error.args else error)} | empty

        return run

    return wrap


def _require(graph: Graph, entity_id: str) -> None:
    if search.entity_by_id(graph.entities, entity_id).isEmpty():
        raise LookupError(f"Entity not found: {entity_id}")


def _split(value) -> list[str] | None:
    """Comma-separated text or a list; empty means not given."""
    if not value:
        return None
    return [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)


def _dicts(df, *columns) -> list[dict]:
    return [row.asDict() for row in df.select(*columns).toLocalIterator()]


@register_tool("find_entity")
@reports(matches=[], count=0)
def find_entity(graph: Graph, query: str, entity_type=None, file_path=None, fuzzy: bool = True, max_results: int = 10) -> dict:
    found = search.find_entities(graph.entities, query, entity_type, file_path, fuzzy, max_results)
    matches = _dicts(found.orderBy("ord", "id"), "id", "name", "type", "file_path", "line_number")
    return {"matches": matches, "count": len(matches)}


@register_tool("get_neighbors")
@reports(neighbors=[], count=0)
def get_neighbors(graph: Graph, entity_id: str, direction: str = "both", relationship_types=None, max_results: int = 20) -> dict:
    _require(graph, entity_id)
    rows = neighbors.distinct_neighbors(graph, entity_id, direction, _split(relationship_types), max_results)
    shown = _dicts(
        rows.orderBy("is_incoming", "ord", "entity_id", "relationship_type"),
        "relationship_type", "direction", "entity_id", "name", "type", "file_path",
    )
    for row in shown:
        if row["type"] == neighbors.UNKNOWN_TYPE:
            del row["file_path"]
    return {"entity_id": entity_id, "neighbors": shown, "count": len(shown)}


@register_tool("get_callers")
@reports(direct_callers=[], transitive_callers=[], call_graph=[], total_callers=0)
def get_callers(graph: Graph, entity_id: str, max_depth: int = 1, types: tuple[str, ...] = ("CALLS",)) -> dict:
    _require(graph, entity_id)
    rows = _dicts(traverse.callers(graph, entity_id, max_depth, types).orderBy("depth", "key"), "caller", "callee", "depth")
    direct = [r["caller"] for r in rows if r["depth"] == 1]
    deeper = [r["caller"] for r in rows if r["depth"] > 1]
    total = len(direct) if max_depth == 1 else len(set(direct)) + len(deeper)
    kind = types[0] if len(types) == 1 else "/".join(types)
    tree = [{"caller": r["caller"], "callee": r["callee"], "relationship_type": kind, "depth": r["depth"]} for r in rows]
    return {"entity_id": entity_id, "direct_callers": direct, "transitive_callers": deeper, "call_graph": tree, "total_callers": total}


@register_tool("traverse")
@reports(traversal_result={}, entity_details=[], stats={"total_entities": 0, "files_touched": 0, "max_depth_reached": 0})
def traverse_from(graph: Graph, start_entity_ids, max_hops: int = 2, include_relationships=None, exclude_types=None) -> dict:
    wanted = _split(start_entity_ids) or []
    known = {r.id for r in graph.entities.filter(F.col("id").isin(wanted)).select("id").distinct().toLocalIterator()}
    starts = [s for s in wanted if s in known]
    if not starts:
        raise LookupError(f"No valid start entities found in: {wanted}")
    reached = traverse.traverse(graph, starts, max_hops, _split(include_relationships), _split(exclude_types))
    details = traverse.traversal_details(graph, reached).orderBy("hops", "key")
    return {
        "traversal_result": {
            r.id: {"hops": r.hops, "path": r.path} for r in reached.orderBy("hops", "key").toLocalIterator()
        },
        "entity_details": _dicts(details, "id", "name", "type", "file_path", F.col("hops").alias("hops_from_start")),
        "stats": traverse.traversal_stats(graph, reached).first().asDict(),
    }


@register_tool("extract_context")
@reports(context={}, total_files=0, total_entities=0)
def extract_context(graph: Graph, sources, entity_id: str, max_hops: int = 1, exclude_types=None) -> dict:
    _require(graph, entity_id)
    rows = context.extract_context(graph, sources, entity_id, max_hops, _split(exclude_types)).orderBy("hops", "key")
    files: dict[str, dict] = {}
    total = 0
    for row in rows.toLocalIterator():
        if row.code is None:
            files.setdefault(row.file_path, {"entities": [{"error": "Could not extract code: file not readable"}]})
            continue
        total += 1
        files.setdefault(row.file_path, {"entities": []})["entities"].append({
            "id": row.id, "name": row.name, "type": row.type, "code": row.code, "line_range": [row.start_line, row.last_line],
        })
    return {"entity_id": entity_id, "context": files, "total_files": len(files), "total_entities": total}


@register_tool("resolve_import")
@reports(resolved_to=None, resolved_entity=None, is_external=False, module="", name="")
def resolve_import(graph: Graph, import_entity_id: str) -> dict:
    _require(graph, import_entity_id)
    row = resolve.resolve_one_import(graph, import_entity_id).first()
    if row is None:
        raise LookupError(f"Not an import: {import_entity_id}")
    entity = None
    if row.resolved_name is not None:
        entity = {"id": row.resolved_to, "name": row.resolved_name, "type": row.resolved_type,
                  "file_path": row.resolved_file, "line_number": row.resolved_line}
    return {"import_entity_id": import_entity_id, "resolved_to": row.resolved_to, "resolved_entity": entity,
            "is_external": bool(row.is_external), "module": row.module or "", "name": row.name}


@register_tool("rebuild")
@reports(entities=0, relationships=0, files_parsed=0)
def rebuild(spark, codebase: str, exclude_patterns=None) -> dict:
    from graphloom.sources.snapshot import SnapshotCache

    cache = SnapshotCache(spark, codebase, _split(exclude_patterns))
    cache.invalidate()
    row = stats.build_summary(cache.get_or_build()).first()
    return {"entities": row.entities, "relationships": row.relationships, "files_parsed": row.files, "codebase_path": cache.target}


@register_tool("diff")
@reports()
def diff(spark, existing_path: str, proposed_path: str) -> dict:
    from graphloom.plans.diff import diff_graphs
    from graphloom.plans.render import change_spec, change_spec_dict
    from graphloom.sources.graph_json import read_graph_json

    changes = diff_graphs(read_graph_json(spark, existing_path), read_graph_json(spark, proposed_path))
    return change_spec_dict(change_spec(changes))


@register_tool("generate_plan")
@reports(plan={}, file_count=0, total_changes=0, warnings=[], markdown="")
def generate_plan(spark, change_spec_path: str, codebase_path: str, existing_path: str | None = None) -> dict:
    from graphloom.plans.render import markdown_chunks, plan_dict, read_change_spec
    from graphloom.plans.round_trip import plan_for
    from graphloom.sources.graph_json import read_graph_json

    spec = read_change_spec(spark, change_spec_path)
    known = read_graph_json(spark, existing_path).entities if existing_path else None
    plan = plan_for(spark, spec, codebase_path, known)
    shown = plan_dict(plan, spec.summary, codebase_path)
    return {"plan": shown, "file_count": len(shown["file_edits"]),
            "total_changes": sum(len(e["entity_changes"]) for e in shown["file_edits"]),
            "warnings": shown["warnings"], "markdown": "".join(markdown_chunks(plan))}


@register_tool("impact_analysis")
@reports(entity=None, direct_impact=[], transitive_impact=[], files_affected=[], risk_level="UNKNOWN", reasons=[])
def analyze_impact(graph: Graph, entity_name: str, depth: int = 2, max_direct: int = 5, max_deeper: int = 10, max_files: int = 10) -> dict:
    """Impact of the first entity whose name contains the text; the lists are cut, the totals are not."""
    matches = find_entity(graph, entity_name, max_results=1)["matches"]
    if not matches:
        raise LookupError(f"Entity '{entity_name}' not found")
    entity_id = matches[0]["id"]
    row = impact.impact(graph, entity_id, depth).first()
    tree = traverse.callers(graph, entity_id, depth)
    direct = tree.filter("depth = 1").orderBy("key").limit(max_direct)
    deeper = tree.filter("depth > 1").orderBy("depth", "key").limit(max_deeper)
    reached = traverse.within_hops(graph.relationships, graph.spark, [entity_id], depth, "outgoing", ["CALLS"])
    files = graph.entities.join(reached, "id", "left_semi").select("file_path").distinct().orderBy("file_path").limit(max_files)
    return {
        "entity": matches[0],
        "direct_impact": [r.caller for r in direct.toLocalIterator()],
        "transitive_impact": [r.caller for r in deeper.toLocalIterator()],
        "files_affected": [r.file_path for r in files.toLocalIterator()],
        "risk_level": row.risk_level,
        "total_affected": row.total_affected, "total_files": row.files_affected,
        "reasons": risk_reasons(row.total_affected, row.files_affected),
    }


def risk_reasons(total: int, files: int, test_files: int = 0) -> list[str]:
    """Why an impact has its level, from the counts alone."""
    levels = ((impact.HIGH_REACH, "wide"), (impact.MEDIUM_REACH, "medium"), (1, "narrow"))
    spread = next((word for bound, word in levels if total >= bound), None)
    found = [f"{spread} reach ({total} dependents)" if spread else "nothing depends on it"]
    if files >= impact.MANY_FILES:
        found.append(f"spread over {files} files")
    if test_files:
        found.append(f"{test_files} of the files are tests")
    return found


@register_tool("understand_function")
@reports(function=None, called_by=[], context={})
def understand_function(graph: Graph, sources, name: str, max_callers: int = 5) -> dict:
    """First match, some of its callers and their number, and the code one hop around it."""
    matches = find_entity(graph, name, max_results=5)["matches"]
    if not matches:
        raise LookupError(f"Function '{name}' not found in codebase")
    entity_id = matches[0]["id"]
    calls = neighbors.direct_callers(graph.relationships, entity_id)
    near = extract_context(graph, sources, entity_id, 1, ["IMPORT", "VARIABLE"])
    return {
        "function": matches[0],
        "called_by": [r.caller for r in calls.orderBy("ord", "caller").limit(max_callers).toLocalIterator()],
        "context": near["context"],
        "total_callers": calls.count(),
    }


@register_tool("export")
@reports()
def export(graph: Graph, output_path: str = "kg_current.json") -> dict:
    from graphloom.sources.graph_json import write_graph_json

    write_graph_json(graph, output_path)
    row = stats.build_summary(graph).first()
    return {"path": output_path, "entities": row.entities, "relationships": row.relationships}


def find_all_by_pattern(graph: Graph, pattern: str, entity_type: str | None = None, max_results: int = 10) -> list[dict]:
    """Matches of a name pattern, ``max_results`` at most."""
    return find_entity(graph, pattern, entity_type, max_results=max_results)["matches"]


@reports(internal_imports=[], external_imports=[])
def get_import_deps(graph: Graph, file_path: str) -> dict:
    """Imports of matching files: those defined in the graph and those from outside."""
    internal, external = [], []
    for row in resolve.import_dependencies(graph, file_path).orderBy("ord").toLocalIterator():
        if row.resolved_name is not None:
            internal.append({"name": row.name, "resolved_to": row.resolved_to, "file": row.resolved_file})
        elif row.is_external:
            external.append({"name": row.name, "module": row.module})
    return {"file": file_path, "internal_imports": internal, "external_imports": external}


def call_tool(name: str, *args, **kwargs) -> str:
    """A tool's result as JSON text."""
    if name not in TOOLS:
        return json.dumps({"success": False, "error": f"Unknown tool: {name}"})
    return json.dumps(TOOLS[name](*args, **kwargs), ensure_ascii=False)


__all__ = ["TOOLS", "register_tool", "call_tool", "find_all_by_pattern", "get_import_deps"]
