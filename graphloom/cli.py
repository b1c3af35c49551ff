"""Command line: ``build``, ``diff`` and ``plan``; a bare path means ``build``."""

from __future__ import annotations

import argparse
import json
import os
import sys

COMMANDS = ("build", "diff", "plan")


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-") and os.path.exists(argv[0]):
        argv.insert(0, "build")
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 0
    try:
        return {"build": _build, "diff": _diff, "plan": _plan}[args.command](args)
    except Exception as error:
        return _fail(f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphloom", description="Build, compare and plan with code graphs")
    commands = parser.add_subparsers(dest="command")
    build = commands.add_parser("build", help="graph of a Python file or folder")
    build.add_argument("target")
    build.add_argument("--exclude", nargs="*", metavar="PATTERN")
    build.add_argument("--parquet", metavar="FOLDER", help="write tables instead of one JSON document")
    build.add_argument("--verbose", "-v", action="store_true")
    diff = commands.add_parser("diff", help="changes between two graphs")
    diff.add_argument("existing")
    diff.add_argument("proposed")
    diff.add_argument("--summary-only", action="store_true")
    plan = commands.add_parser("plan", help="file edits for a set of changes")
    plan.add_argument("change_spec")
    plan.add_argument("--codebase", required=True)
    plan.add_argument("--existing-kg", metavar="FILE")
    plan.add_argument("--format", choices=["markdown", "json"], default="markdown")
    for command in (build, diff, plan):
        command.add_argument("--output", "-o", metavar="FILE")
    return parser


def _fail(message: str) -> int:
    print(f"Error: {message}", file=sys.stderr)
    return 1


def _session():
    from graphloom.session import build_session

    master = None if os.environ.get("SPARK_REMOTE") or os.environ.get("MASTER") else "local[*]"
    spark = build_session("graphloom", master, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _emit(chunks, output: str | None) -> None:
    if output:
        with open(output, "w", encoding="utf-8") as out:
            out.writelines(chunks)
    else:
        sys.stdout.writelines(chunks)
        print()


def _build(args) -> int:
    from graphloom.sources.graph_json import json_chunks, write_graph
    from graphloom.sources.snapshot import build_from_path

    if not os.path.exists(args.target):
        return _fail(f"Target path does not exist: {args.target}")
    if args.verbose:
        print(f"Building graph from: {args.target}", file=sys.stderr)
    graph = build_from_path(_session(), args.target, args.exclude)
    if args.parquet:
        write_graph(graph, args.parquet)
    else:
        _emit(json_chunks(graph), args.output)
    return 0


def _diff(args) -> int:
    from graphloom.plans.diff import diff_graphs
    from graphloom.plans.render import SUMMARY_KEYS, change_spec, change_spec_chunks
    from graphloom.sources.graph_json import read_graph_json

    for label, path in (("Existing", args.existing), ("Proposed", args.proposed)):
        if not os.path.isfile(path):
            return _fail(f"{label} graph file not found: {path}")
    spark = _session()
    changes = diff_graphs(read_graph_json(spark, args.existing), read_graph_json(spark, args.proposed))
    if args.summary_only:
        summary = changes.summary().first()
        _emit([f"{key}: {summary[key]}\n" for key in SUMMARY_KEYS], args.output)
        return 0
    _emit(change_spec_chunks(change_spec(changes)), args.output)
    if args.output:
        print(f"Change spec written to: {args.output}", file=sys.stderr)
    return 0


def _plan(args) -> int:
    from graphloom.plans.render import markdown_chunks, plan_dict, read_change_spec
    from graphloom.plans.round_trip import plan_for
    from graphloom.sources.graph_json import read_graph_json

    if not os.path.isfile(args.change_spec):
        return _fail(f"Change spec file not found: {args.change_spec}")
    if not os.path.exists(args.codebase):
        return _fail(f"Codebase path not found: {args.codebase}")
    if args.existing_kg and not os.path.isfile(args.existing_kg):
        return _fail(f"Existing graph file not found: {args.existing_kg}")
    spark = _session()
    known = read_graph_json(spark, args.existing_kg).entities if args.existing_kg else None
    spec = read_change_spec(spark, args.change_spec)
    plan = plan_for(spark, spec, args.codebase, known)
    if args.format == "json":
        _emit([json.dumps(plan_dict(plan, spec.summary, args.codebase), indent=2, ensure_ascii=False)], args.output)
    else:
        _emit(markdown_chunks(plan), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
