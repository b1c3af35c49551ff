import json
import os

import pytest
from graph_helpers import make_graph, pairs
from graphloom.operators import edit
from graphloom.plans.diff import diff_graphs, fingerprint, has_changes
from graphloom.plans.render import change_spec, change_spec_dict, read_change_lines, read_change_spec, write_change_lines, write_change_spec
from graphloom.plans.round_trip import run_round_trip
from graphloom.sources.files import decoded, python_files, read_files
from graphloom.sources.graph_json import read_graph, read_graph_json, read_graph_lines, write_graph, write_graph_json, write_graph_lines
from graphloom.sources.snapshot import SnapshotCache, build_from_path
from graphloom.surfaces import skills, tools


def entity(eid, kind="FUNCTION", path="f.py", line=1, properties=None, **extra):
    return {"id": eid, "name": eid.split("::")[-1], "type": kind, "file_path": path, "line_number": line,
            "properties": properties or {}} | extra


def document(entities, edges=()):
    return {"entities": {e["id"]: e for e in entities},
            "relationships": [{"source_id": s, "target_id": t, "type": k, "line_number": 1} for s, t, k in edges]}


@pytest.fixture
def load(spark, tmp_path):
    def run(doc, name="g.json"):
        path = tmp_path / name
        path.write_text(json.dumps(doc))
        return read_graph_json(spark, str(path))

    return run


OLD = document(
    [entity("f.py::a"), entity("f.py::b", properties={"y": 1, "x": [2]}), entity("f.py::c", path="g.py")],
    [("f.py::a", "f.py::b", "CALLS"), ("f.py::a", "f.py::b", "CALLS"), ("f.py::c", "f.py::b", "CALLS"), ("f.py::a", "f.py::a", "CALLS")],
)
NEW = document(
    [entity("f.py::a", "ASYNC_FUNCTION", end_line=9), entity("f.py::c", path="g.py"), entity("f.py::d", path=""), entity("h.py::e", path="h.py")],
    [("f.py::a", "f.py::a", "CALLS"), ("f.py::a", "f.py::d", "CALLS"), ("f.py::d", "f.py::c", "CALLS")],
)


def test_change_document_as_lines(spark, load, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def alone(*_):
        raise AssertionError("passed through the driver")

    changes = diff_graphs(load(OLD, "old.json"), load(NEW, "new.json"))
    spec = change_spec_dict(change_spec(changes))
    with monkeypatch.context() as patch:
        patch.setattr(DataFrame, "toLocalIterator", alone)
        write_change_lines(change_spec(changes), f"file://{tmp_path}/spec")
        lines = read_change_lines(spark, f"file://{tmp_path}/spec")
    assert [r.position for r in lines.entities.orderBy("position").collect()] == [0, 1, 2, 3]
    assert {k: v for k, v in change_spec_dict(lines).items() if k != "timestamp"} == {k: v for k, v in spec.items() if k != "timestamp"}


def test_diff_and_change_document(spark, load, tmp_path):
    changes = diff_graphs(load(OLD, "old.json"), load(NEW, "new.json"))
    spec = change_spec_dict(change_spec(changes))
    assert spec["summary"] == {"entities_added": 2, "entities_removed": 1, "entities_modified": 1,
                               "relationships_added": 2, "relationships_removed": 2}
    assert [(c["action"], c["entity_id"]) for c in spec["entity_changes"]] == [
        ("added", "f.py::d"), ("added", "h.py::e"), ("removed", "f.py::b"), ("modified", "f.py::a")]
    added, lone, removed, modified = spec["entity_changes"]
    assert added["neighbor_ids"] == ["f.py::a", "f.py::c"] and lone["neighbor_ids"] == [] and added["before"] is None
    assert removed["neighbor_ids"] == ["f.py::a", "f.py::c"] and removed["before"]["properties"] == {"x": [2], "y": 1}
    assert modified["field_diffs"] == {"type": ["FUNCTION", "ASYNC_FUNCTION"], "end_line": [None, 9]}
    assert modified["neighbor_ids"] == ["f.py::a", "f.py::d"]  # a self-loop neighbours itself
    assert spec["version"] == "1.0" and spec["source_kg_hash"].startswith("sha256:")
    path = str(tmp_path / "spec.json")
    write_change_spec(change_spec(changes), path)
    again = change_spec_dict(read_change_spec(spark, path))
    assert {k: v for k, v in again.items() if k != "timestamp"} == {k: v for k, v in spec.items() if k != "timestamp"}
    (tmp_path / "bad.json").write_text('{"timestamp": "t"}')
    with pytest.raises(KeyError):
        read_change_spec(spark, str(tmp_path / "bad.json"))


def test_no_changes_and_key_order(load):
    same = document([entity("f.py::b", properties={"x": [2], "y": 1})])
    other = document([entity("f.py::b", properties={"y": 1, "x": [2]})])
    a, b = load(same, "a.json"), load(other, "b.json")
    assert not has_changes(diff_graphs(a, b))
    assert fingerprint(a).first() == fingerprint(b).first() != fingerprint(load(OLD)).first()


def test_round_trip_plan(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "f.py").write_text("def a():\n    return b()\n\ndef b():\n    pass\n")
    (tmp_path / "code" / "g.py").write_text("def c():\n    pass\n")
    for name, doc in (("old", OLD), ("new", NEW)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    result = run_round_trip(spark, str(tmp_path / "code"), str(tmp_path / "new.json"), str(tmp_path / "old.json"))
    assert result["success"], result["error"]
    edits = {e["file_path"]: e for e in result["edit_plan"]["file_edits"]}
    assert {p: e["action"] for p, e in edits.items()} == {"f.py": "modify", "g.py": "modify", "h.py": "create"}
    assert result["edit_plan"]["execution_order"] == ["h.py", "f.py", "g.py"]
    assert edits["f.py"]["description"] == "Remove function `b`; Modify `a` (type, end_line)"
    assert edits["g.py"]["description"] == "Add function `d`"
    assert edits["f.py"]["context_snippets"]["f.py::a"].startswith("def a():")
    changed = {c["entity_id"]: c for c in edits["f.py"]["entity_changes"]}
    assert changed["f.py::a"]["field_diffs"] == {"type": ["FUNCTION", "ASYNC_FUNCTION"], "end_line": [None, 9]}
    assert changed["f.py::a"]["neighbor_ids"] == ["f.py::a", "f.py::d"] and changed["f.py::a"]["file_path"] == "f.py"
    assert changed["f.py::b"]["before"]["properties"] == {"x": [2], "y": 1} and changed["f.py::b"]["after"] is None
    assert any("`f.py::d`" in w and "`g.py`" in w for w in result["warnings"])
    assert any("`f.py::b`" in w and "`f.py::a`" in w for w in result["warnings"])
    text = result["markdown_plan"]
    assert "## Edit Plan — 3 file(s), 4 change(s)" in text and "### 3. CREATE: `h.py`" in text and "### Warnings" in text
    same = run_round_trip(spark, str(tmp_path / "code"), str(tmp_path / "old.json"), str(tmp_path / "old.json"))
    assert same["success"] and same["markdown_plan"].startswith("No changes")
    assert not run_round_trip(spark, str(tmp_path), str(tmp_path / "none.json"), str(tmp_path / "old.json"))["success"]


def test_json_and_folder_round_trips(spark, load, small_graph, tmp_path):
    path = str(tmp_path / "out.json")
    write_graph_json(small_graph, path)
    doc = json.load(open(path))
    assert list(doc["entities"]) == ["a.py", "b.py", "a.py::Box", "a.py::helper_fn", "b.py::entry", "a.py::Box::process"]
    assert "end_line" not in doc["entities"]["a.py"] and doc["entities"]["a.py::Box"]["end_line"] == 20
    assert doc["relationships"][0] == {"source_id": "a.py", "target_id": "a.py::Box", "type": "CONTAINS", "line_number": 1}
    back = load(doc)
    assert not has_changes(diff_graphs(small_graph, back))
    write_graph(small_graph, str(tmp_path / "pq"))
    assert not has_changes(diff_graphs(read_graph(spark, str(tmp_path / "pq")), back))
    write_graph_lines(small_graph, str(tmp_path / "lines"))
    assert not list((tmp_path / "lines").glob("*/*.txt")) and list((tmp_path / "lines").glob("relationships/*.gz"))
    lines = read_graph_lines(spark, str(tmp_path / "lines"))
    assert not has_changes(diff_graphs(small_graph, lines))
    assert [r.id for r in lines.entities.orderBy("ord").collect()] == [r.id for r in small_graph.entities.orderBy("ord").collect()]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "pkg" / "venv").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("from .core import Engine\n")
    (root / "pkg" / "core.py").write_text("class Engine:\n    def run(self):\n        return step()\n\ndef step():\n    return 1\n")
    (root / "pkg" / "venv" / "skip.py").write_text("x = 1\n")
    (root / "main.py").write_text("import os\nfrom pkg import Engine\nfrom http import get\n\ndef main():\n    e = Engine()\n    e.run()\n")
    (root / "bad.py").write_bytes(b"x = '\xff'")
    (root / "notes.txt").write_text("no")
    return root


def test_files_and_excludes(spark, tree):
    paths = {p for (p,) in pairs(python_files(spark, str(tree)), "path")}
    assert {os.path.relpath(p, tree) for p in paths} == {"main.py", "bad.py", "pkg/__init__.py", "pkg/core.py", "pkg/venv/skip.py"}
    kept = pairs(python_files(spark, str(tree), ["**/venv/*", "bad.*"]), "path")
    assert {os.path.relpath(p, tree) for (p,) in kept} == {"main.py", "pkg/__init__.py", "pkg/core.py"}
    one = python_files(spark, str(tree / "main.py"), ["main.py"])
    assert one.count() == 1
    texts = {os.path.basename(r.path): r.source for r in decoded(read_files(python_files(spark, str(tree)))).collect()}
    assert texts["bad.py"] is None and texts["skip.py"] == "x = 1\n"


def test_snapshot_cache(spark, tree):
    cache = SnapshotCache(spark, str(tree))
    first = cache.get_or_build()
    ids = {i for (i,) in pairs(first.entities, "id")}
    assert f"{tree}/main.py::main" in ids and not any("bad.py" in i for i in ids)
    before = cache._valid_folder(cache.tree_hash())
    assert before is not None and SnapshotCache(spark, str(tree), ttl_seconds=-1)._valid_folder(cache.tree_hash()) is None
    os.utime(tree / "main.py", (1, 1))
    assert cache._valid_folder(cache.tree_hash()) is None
    cache.get_or_build()
    cache.invalidate()
    assert cache._valid_folder(cache.tree_hash()) is None


def test_tools(spark, tree, small_graph):
    graph = build_from_path(spark, str(tree))
    base = str(tree)
    found = tools.find_entity(graph, "engine", "CLASS")
    assert found["success"] and found["matches"][0]["id"] == f"{base}/pkg/core.py::Engine"
    deps = tools.get_import_deps(graph, "main.py")
    assert [d["name"] for d in deps["internal_imports"]] == ["Engine"] and deps["external_imports"] == [{"name": "get", "module": "http"}]
    assert tools.resolve_import(graph, f"{base}/main.py::import:get")["is_external"]
    assert tools.resolve_import(graph, f"{base}/main.py::import:Engine")["resolved_entity"]["name"] == "Engine"
    texts = decoded(read_files(python_files(spark, str(tree))))
    near = tools.extract_context(graph, texts, f"{base}/pkg/core.py::Engine")
    assert near["context"][f"{base}/pkg/core.py"]["entities"][0]["code"].startswith("class Engine")
    understood = tools.understand_function(graph, texts, "step")
    assert understood["success"] and understood["function"]["name"] == "step"
    around = tools.get_neighbors(small_graph, "a.py::helper_fn")
    assert [(n["entity_id"], n["direction"]) for n in around["neighbors"]] == [
        ("a.py", "incoming"), ("a.py::Box::process", "incoming"), ("b.py::entry", "incoming")]
    assert not tools.get_neighbors(small_graph, "a.py", relationship_types="NOPE")["success"]
    assert tools.get_neighbors(small_graph, "nope")["error"] == "Entity not found: nope"
    calls = tools.get_callers(small_graph, "a.py::helper_fn", 2)
    assert calls["total_callers"] == 2 and calls["transitive_callers"] == []
    walked = tools.traverse_from(small_graph, "a.py, missing", 2)
    assert walked["stats"] == {"total_entities": 4, "files_touched": 1, "max_depth_reached": 2}
    assert not tools.traverse_from(small_graph, "missing")["success"]
    risk = tools.analyze_impact(small_graph, "helper")
    assert risk["risk_level"] == "LOW" and risk["direct_impact"] == ["a.py::Box::process", "b.py::entry"]
    assert json.loads(tools.call_tool("find_entity", small_graph, "zzz"))["count"] == 0
    assert len(tools.TOOLS) == 12
    rebuilt = tools.rebuild(spark, str(tree))
    assert rebuilt["success"] and rebuilt["entities"] == graph.entities.count()


def test_skills(spark, small_graph):
    assert skills.parse_command("/explore name --hops 2 --show-code --type=CLASS --ok yes") == (
        "explore", {"target": "name", "entity_name": "name", "query": "name", "hops": 2, "show_code": True, "type": "CLASS", "ok": True})
    text = skills.invoke_skill("/explore helper", small_graph)["output"]
    assert "### callers — 2 of 2" in text and "after 1 hop(s): 0" in text
    text = skills.invoke_skill("/impact helper --depth 2", small_graph)["output"]
    assert "### direct callers — 2 of 2" in text and "risk: LOW" in text
    sources = spark.createDataFrame([("dir/a.py", "\n".join(f"line {i}" for i in range(1, 40)))], "path string, source string")
    text = skills.invoke_skill("/context helper", small_graph, sources)["output"]
    assert "line 25" in text and "line 30" in text and "line 31" not in text
    assert not skills.invoke_skill("/nope x", small_graph)["success"] and not skills.invoke_skill("nope", small_graph)["success"]


def test_edits(spark, small_graph):
    assert edit.unused_id(small_graph.entities) == "new-entity"
    taken = make_graph(spark, [(i, i, "CLASS", "f", 1, None) for i in ("new-entity", "new-entity-1", "new-entity-3")], [("a", "b", "CALLS", 1)])
    assert edit.unused_id(taken.entities) == "new-entity-2"
    loop = make_graph(spark, [("x", "x", "CLASS", "f", 1, None)], [("x", "x", "CALLS", 1), ("y", "x", "CALLS", 1)])
    assert pairs(edit.rename_entity(loop, "x", "z").relationships, "source_id", "target_id") == {("z", "x"), ("y", "z")}
    history = edit.History(small_graph)
    smaller = history.apply(edit.delete_entity(small_graph, "a.py"))
    assert smaller.entities.count() == 5 and smaller.relationships.count() == 3
    assert history.undo() is small_graph and history.redo() is smaller
    more = edit.add_relationships_checked(small_graph, spark.createDataFrame(
        [("a.py", "b.py", "USES", 1), ("a.py", "a.py", "USES", 1), ("a.py", "nowhere", "USES", 1)],
        "source_id string, target_id string, type string, line_number int"))
    assert more.relationships.count() == 6
    ids = spark.createDataFrame([("a.py",), ("b.py::entry",)], "id string")
    assert edit.delete_entities(small_graph, ids).relationships.count() == 2


def test_command_line(tree, tmp_path, capsys):
    from graphloom.cli import main

    out = str(tmp_path / "kg.json")
    assert main([str(tree), "-o", out, "--exclude", "**/venv/*"]) == 0
    doc = json.load(open(out))
    assert f"{tree}/pkg/core.py::Engine" in doc["entities"]
    for name, content in (("old", OLD), ("new", NEW)):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    old, new, spec = (str(tmp_path / n) for n in ("old.json", "new.json", "spec.json"))
    assert main(["diff", old, new, "--summary-only"]) == 0
    assert "entities_added: 2" in capsys.readouterr().out
    assert main(["diff", old, new, "-o", spec]) == 0
    assert main(["plan", spec, "--codebase", str(tree), "--existing-kg", old]) == 0
    assert "## Edit Plan" in capsys.readouterr().out
    assert main(["plan", spec, "--codebase", str(tree), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["change_spec_summary"]["entities_removed"] == 1
    assert main(["diff", old, str(tmp_path / "missing.json")]) == 1
    (tmp_path / "broken.json").write_text("{")
    assert main(["diff", old, str(tmp_path / "broken.json")]) == 1
    assert main(["build", str(tmp_path / "nothing")]) == 1
    assert main(["plan", spec, "--codebase", str(tmp_path / "nothing")]) == 1


def test_paths_are_inferred_without_comparing_all_edges(spark):
    from graph_helpers import make_graph
    from graphloom.plans.diff import diff_graphs
    from graphloom.plans.edit_plan import edit_plan

    entities = [("k", "k", "CLASS", "a.py", 1, 9), ("t", "t", "FUNCTION", "b.py", 1, 9), ("u", "u", "FUNCTION", "b.py", 1, 9)]
    added = [("x", "x", "FUNCTION", "", 1, None), ("y", "y", "FUNCTION", "", 1, None), ("z", "z", "FUNCTION", "", 1, None)]
    old = make_graph(spark, entities, [("k", "t", "CALLS", 1), ("t", "x", "CONTAINS", 1)])
    # The containment of x is in both versions, so it is no change and gives no path.
    new = make_graph(spark, entities + added, [
        ("t", "x", "CONTAINS", 1), ("x", "k", "CALLS", 1), ("x", "t", "CALLS", 1), ("x", "u", "CALLS", 1), ("k", "y", "CONTAINS", 1), ("z", "t", "INSTANTIATES", 1)])
    changes = diff_graphs(old, new)
    plan = edit_plan(changes, old.entities)
    assert {(r.entity_id, r.inferred) for r in plan.inferred_paths.collect()} == {("x", "b.py"), ("y", "a.py"), ("z", None)}
    assert {r.file_path for r in plan.file_edits.collect()} == {"a.py", "b.py", "(unknown)"}
    assert not {"relationships", "neighbors"} & set(vars(changes))
    # The whole comparison, once made, gives the same paths.
    changes.relationships
    again = edit_plan(changes, old.entities).inferred_paths
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in plan.inferred_paths.collect()}


def test_edge_status_moves_keys_only(spark, load):
    from graphloom.plans.diff import classify, overlay_edges

    changes = diff_graphs(load(OLD, "old.json"), load(NEW, "new.json"))
    edges = classify(changes)[1]
    assert sorted(map(tuple, edges.collect())) == [
        ("f.py::a::f.py::b::CALLS", "removed"), ("f.py::a::f.py::d::CALLS", "added"), ("f.py::c::f.py::b::CALLS", "removed"), ("f.py::d::f.py::c::CALLS", "added")]
    assert not {"entities", "relationships"} & set(vars(changes))  # nothing was written for it
    assert sorted(map(tuple, overlay_edges(changes).collect()), key=str) == [
        ("f.py::a", "f.py::a", "CALLS", None), ("f.py::a", "f.py::b", "CALLS", "removed"), ("f.py::a", "f.py::d", "CALLS", "added"),
        ("f.py::c", "f.py::b", "CALLS", "removed"), ("f.py::d", "f.py::c", "CALLS", "added")]
    assert not {"entities", "relationships"} & set(vars(changes))
    many = make_graph(spark, [], [("a", "b", "CALLS", 1)] * 3 + [("a", None, "CALLS", 1)] * 2)
    shown = overlay_edges(diff_graphs(make_graph(spark, [], [("a", "c", "CALLS", 1)]), many))
    assert sorted(map(tuple, shown.collect()), key=str) == [("a", "b", "CALLS", "added")] * 3 + [("a", None, "CALLS", None)] * 2
