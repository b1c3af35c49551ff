"""Text reports over a graph, asked for by commands such as ``/explore name --hops 2``.

A report is a list of sections; a section is a heading with facts (one line each) or a list of rows
that a DataFrame is asked for. Lists are cut to ``--limit`` rows, and always say how many there are.
"""

from __future__ import annotations

import json
import shlex
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F

from graphloom.graph import Graph
from graphloom.operators import context, impact, neighbors, search, traverse
from graphloom.surfaces.tools import risk_reasons

LIMIT = 8
CODE_LINES = 60
#: Words that stand for yes and no in option values.
SWITCH_WORDS = {"true": True, "yes": True, "false": False, "no": False}


# ---- commands -----------------------------------------------------------------------------------

def option_value(text: str):
    """A whole number, a number, a yes/no word, or the text itself."""
    if text.lower() in SWITCH_WORDS:
        return SWITCH_WORDS[text.lower()]
    try:
        return json.loads(text) if text.lstrip("-")[:1].isdigit() else text
    except ValueError:
        return text


def parse_command(command: str) -> tuple[str, dict[str, Any]]:
    """``/name target --key value --key=value --flag`` to a name and options; quotes hold spaces together.

    The first bare word is the target and also answers to ``entity_name`` and ``query``.
    """
    try:
        words = shlex.split(command)
    except ValueError:  # a quote that is never closed is a character like any other
        words = command.split()
    if not words or not words[0][1:].isidentifier() or words[0][0] != "/":
        return "", {}
    options: dict[str, Any] = {}
    bare: list[str] = []
    waiting: str | None = None
    for word in words[1:]:
        if word.startswith("--"):
            key, equals, value = word[2:].partition("=")
            key = key.replace("-", "_")
            options[key] = option_value(value) if equals else True
            waiting = None if equals else key
        elif waiting is not None:
            options[waiting], waiting = option_value(word), None
        elif not options:
            bare.append(word)
    if bare:
        options = {"target": bare[0], "entity_name": bare[0], "query": bare[0]} | options
    return words[0][1:], options


# ---- reports ------------------------------------------------------------------------------------

@dataclass
class Report:
    lines: list[str] = field(default_factory=list)

    def heading(self, text: str, level: int = 2) -> None:
        self.lines += ([""] if self.lines else []) + [f"{'#' * level} {text}"]

    def facts(self, **values) -> None:
        self.lines += [f"{name.replace('_', ' ')}: {value}" for name, value in values.items() if value not in (None, "")]

    def rows(self, title: str, rows: DataFrame, order: Iterable, text: Callable[[Row], str], limit: int) -> None:
        """Up to ``limit`` rows in their order, under a heading that tells how many there are."""
        total = rows.count()
        self.heading(f"{title} — {min(total, limit)} of {total}", 3)
        self.lines += [f"* {text(row)}" for row in rows.orderBy(*order).limit(limit).collect()]

    def code(self, name: str, text: str, most: int) -> None:
        lines = text.splitlines()
        cut = f"  (first {most} of {len(lines)} lines)" if len(lines) > most else ""
        self.lines += [f"`{name}`{cut}", "```python", *lines[:most], "```"]

    def __str__(self) -> str:
        return "\n".join(self.lines)


def place(row) -> str:
    """How a report names an entity."""
    return f"`{row.name}` [{row.type}] {row.file_path}:{row.line_number}" if row.name is not None else f"`{row.id}`"


def with_details(graph: Graph, rows: DataFrame) -> DataFrame:
    """Rows with an ``id`` and the columns ``place`` needs; unknown ids keep null ones."""
    return rows.join(graph.entities.select("id", "name", "type", "file_path", "line_number"), "id", "left")


def named(graph: Graph, text: str, wanted_type: str | None = None) -> DataFrame:
    found = search.search_by_name(graph.entities, str(text), fuzzy=True)
    return found.filter(F.col("type") == wanted_type) if wanted_type else found


def only_match(graph: Graph, options: dict) -> Row:
    if "entity_name" not in options:
        raise ValueError("name the entity: /command NAME")
    row = search.first_rows(named(graph, options["entity_name"]), 1).first()
    if row is None:
        raise LookupError(f"no entity is named like {options['entity_name']!r}")
    return row


def explore(graph: Graph, options: dict, sources: DataFrame | None) -> tuple[str, dict]:
    """Every match of a name with its edges, callers, reach and, on request, code."""
    only_match(graph, options)
    limit, hops = int(options.get("limit", LIMIT)), int(options.get("hops", 1))
    found = named(graph, options["entity_name"], options.get("type"))
    total = found.count()
    report = Report()
    report.heading(f"{total} match(es) of {options['entity_name']}")
    for entity in search.first_rows(found, limit).collect():
        report.heading(place(entity))
        report.facts(ends_at_line=entity.end_line, properties=entity.properties if entity.properties != "{}" else None)
        for direction in ("outgoing", "incoming"):
            edges = neighbors.neighbors(graph.relationships, entity.id, direction).withColumnRenamed("neighbor_id", "id")
            report.rows(direction, with_details(graph, edges), ("ord", "id"), lambda r: f"{r.relationship_type} {place(r)}", limit)
        calls = neighbors.direct_callers(graph.relationships, entity.id).select(F.col("caller").alias("id"), "ord")
        report.rows("callers", with_details(graph, calls), ("ord", "id"), place, limit)
        near = traverse.within_hops(graph.relationships, graph.spark, [entity.id], hops, "outgoing")
        counts = {r.hops: r["count"] for r in near.groupBy("hops").count().collect()}  # one row per hop
        report.heading("reach", 3)
        report.facts(**{f"after_{hop}_hop(s)": counts.get(hop, 0) for hop in range(1, hops + 1)})
        if options.get("show_code") and sources is not None:
            report.heading("code", 3)
            shown = context.code_by_entity(graph, sources, entity.id, min(hops, 1)).filter("code is not null")
            for row in shown.orderBy("hops", "key").limit(limit).collect():
                report.code(row.name, row.code, int(options.get("lines", CODE_LINES)))
    return str(report), {"matches": total}


def impact_report(graph: Graph, options: dict, _sources) -> tuple[str, dict]:
    """Who depends on an entity and how risky a change is."""
    entity = only_match(graph, options)
    limit, depth = int(options.get("limit", LIMIT)), int(options.get("depth", 2))
    tree = traverse.callers(graph, entity.id, depth).select(F.col("caller").alias("id"), "depth", "key")
    affected = impact.affected_callers(graph, entity.id, depth, bool(options.get("include_direct")))
    row = impact.impact_assessment(graph, affected).first()
    report = Report()
    report.heading(f"impact of {place(entity)}")
    report.facts(risk=row.risk_level, because="; ".join(risk_reasons(row.total_affected, row.files_affected, row.test_files)))
    report.rows("direct callers", with_details(graph, tree.filter("depth = 1")), ("key",), place, limit)
    report.rows(f"callers up to depth {depth}", with_details(graph, tree.filter("depth > 1")), ("depth", "key"), lambda r: f"{place(r)}, depth {r.depth}", limit)
    files = graph.entities.join(affected, "id", "left_semi").select("file_path").distinct()
    report.rows("files", files, ("file_path",), lambda r: r.file_path, limit)
    return str(report), row.asDict()


def context_report(graph: Graph, options: dict, sources: DataFrame | None) -> tuple[str, dict]:
    """Code of an entity and of what it reaches, file by file."""
    entity = only_match(graph, options)
    without = str(options.get("exclude_types") or "").replace(",", " ").split()
    rows = context.extract_context(graph, sources, entity.id, int(options.get("hops", 1)), without or None, context.SKILL_WINDOW)
    counts = rows.agg(F.count_distinct("file_path").alias("files"), F.count("code").alias("pieces")).first().asDict()
    report = Report()
    report.heading(f"code around {place(entity)}")
    report.facts(**counts, left_out=", ".join(without))
    shown = None
    for row in rows.orderBy("file_path", "hops", "key").toLocalIterator():  # streamed, one partition at a time
        if row.file_path != shown:
            shown = row.file_path
            report.heading(shown, 3)
        if row.code is None:
            report.facts(no_source_for=row.name)
        else:
            report.code(row.name + (" (asked for)" if row.id == entity.id else ""), row.code, int(options.get("lines", CODE_LINES)))
    return str(report), counts


def plan_report(graph: Graph, options: dict, _sources) -> tuple[str, dict]:
    """The edit plan of a stored change set, as markdown or JSON."""
    from graphloom.surfaces.tools import generate_plan

    if "target" not in options:
        raise ValueError("name the change set: /plan FILE --codebase FOLDER")
    result = generate_plan(graph.spark, options["target"], str(options.get("codebase", ".")), options.get("existing_kg"))
    if not result["success"]:
        raise RuntimeError(result["error"])
    as_json = options.get("format") == "json"
    return json.dumps(result["plan"], indent=2, ensure_ascii=False) if as_json else result["markdown"], result["plan"]


SKILLS: dict[str, Callable] = {"explore": explore, "impact": impact_report, "context": context_report, "plan": plan_report}


def register_skill(name: str):
    """Add a function (graph, options, sources) -> (text, data)."""

    def wrap(fn):
        SKILLS[name] = fn
        return fn

    return wrap


def invoke_skill(command: str, graph: Graph, sources: DataFrame | None = None) -> dict:
    """Run a command; the result says whether it worked and never is an exception."""
    name, options = parse_command(command)
    answer = {"success": False, "skill_name": name, "output": "", "data": {}}
    if name not in SKILLS:
        known = " ".join(f"/{s}" for s in SKILLS)
        return answer | {"output": f"no command {name!r}; there are {known}" if name else f"a command starts with a slash: {known}"}
    try:
        text, data = SKILLS[name](graph, options, sources)
    except Exception as error:  # the contract of commands: report, do not raise
        return answer | {"output": f"{type(error).__name__}: {error}"}
    return answer | {"success": True, "output": text, "data": data}
