from graph_helpers import pairs
from graphloom.operators import resolve


def resolved(graph, kind):
    return pairs(graph.relationships.filter(f"is_resolved and type = '{kind}'"), "source_id", "target_id")


def test_package_reexport_relative_import_and_typed_calls(build):
    graph = build({
        "pkg/__init__.py": "from .rest import Client\n",
        "pkg/rest.py": "class Client:\n    def get(self): pass\n    def _send(self): self.get()\n",
        "app.py": "from pkg import Client as Cli\nimport pkg\n\ndef main():\n    c = Cli()\n    c.get()\n    c.get.x()\n    c.missing()\n",
        "lib/util.py": "def only(): pass\n",
        "deep/x/util2.py": "from lib.util import only\nfrom util import only as again\nfrom outside import thing\ndef go():\n    only()\n    again()\n    thing()\n",
    })
    assert resolved(graph, "IMPORTS_RESOLVED_TO") == {
        ("pkg/__init__.py::import:Client", "pkg/rest.py::Client"),
        ("app.py::import:Cli", "pkg/rest.py::Client"),
        ("deep/x/util2.py::import:only", "lib/util.py::only"),
        ("deep/x/util2.py::import:again", "lib/util.py::only"),
    }
    assert resolved(graph, "CALLS_RESOLVED") == {
        ("app.py::main", "pkg/rest.py::Client::get"), ("deep/x/util2.py::go", "lib/util.py::only")}
    assert pairs(graph.entities.filter("type = 'EXTERNAL_REF'"), "id", "file_path") == {
        ("external::outside::thing", "external/outside/thing.py")}


def test_module_lookup_prefers_near_then_exact_then_shortest(spark):
    files = spark.createDataFrame(
        [("z/deep/er/m.py", 0), ("a/m.py", 1), ("b/m.py", 2), ("n.py", 3), ("q/n.py", 4), ("ctx/n.py", 5), ("k/o/__init__.py", 6)],
        "path string, ord long",
    )
    requests = spark.createDataFrame(
        [("m", ""), ("m", "b"), ("n", "x"), ("n", "ctx"), ("o", ""), ("none", ""), ("", "a")], "module string, context_dir string")
    found = {(r.module, r.context_dir): r.module_file for r in resolve.module_files(requests, files).collect()}
    assert found == {("m", ""): "a/m.py", ("m", "b"): "b/m.py", ("n", "x"): "n.py", ("n", "ctx"): "ctx/n.py", ("o", ""): "k/o/__init__.py"}


def test_reexport_chain_is_bounded(build):
    files = {f"p{i}.py": f"from p{i + 1} import S\n" for i in range(6)} | {"p6.py": "class S: pass\n"}
    graph = build(files)
    done = {s for s, _ in resolved(graph, "IMPORTS_RESOLVED_TO")}
    # Four imports per chain at most: p2 reaches p6 through p2, p3, p4, p5.
    assert done == {f"p{i}.py::import:S" for i in (2, 3, 4, 5)}


def test_ambiguous_classes_diamond_and_cycle(build, spark):
    graph = build({
        "a.py": "class Tag:\n    def who(self): pass\nclass Top:\n    def m(self): pass\n    def n(self): pass\n"
                "class L(Top):\n    def m(self): pass\nclass R(Top):\n    def n(self): pass\n"
                "class Dia(L, R):\n    def own(self): pass\n",
        "b.py": "class Tag:\n    def other(self): pass\ndef use():\n    t = Tag()\n    t.other()\n",
        "c.py": "def use():\n    t = Tag()\n    t.who()\n    d = Dia()\n    d.n()\n    d.m()\n",
        "e.py": "class X(Y):\n    def x(self): pass\nclass Y(X):\n    def y(self): pass\n",
    })
    assert resolved(graph, "CALLS_RESOLVED") == {
        ("b.py::use", "b.py::Tag::other"),
        ("c.py::use", "a.py::Tag::who"),
        # Depth first through L, then Top: Top.n wins over R.n.
        ("c.py::use", "a.py::Top::n"),
        ("c.py::use", "a.py::L::m"),
    }
    symbols = resolve.Symbols(graph)
    parents = resolve.class_parents(graph, symbols, resolve.resolved_imports(graph, symbols))
    table = pairs(resolve.method_table(graph, symbols, parents).filter("class_id like 'e.py%'"), "class_id", "name")
    assert table == {("e.py::X", "x"), ("e.py::X", "y"), ("e.py::Y", "x"), ("e.py::Y", "y")}


def test_long_inheritance_chain(spark):
    n = 40
    parents = spark.createDataFrame([(i, f"c{i}", f"c{i + 1}") for i in range(n)], "ord long, source_id string, parent_id string")
    closure = resolve.ancestor_classes(parents)
    assert closure.count() == n * (n + 1) // 2
    assert closure.filter("class_id = 'c0' and ancestor_id = 'c40'").first().key == list(range(n))


def test_scalar_lookups(build):
    graph = build({"m/a.py": "import os\nfrom m.b import f\ndef g(): pass\n", "m/b.py": "def f(): pass\n"})
    assert resolve.resolve_call(graph, "g", "m/a.py") == "m/a.py::g"
    assert resolve.resolve_call(graph, "b.f", "m/a.py") == "m/b.py::f"
    assert resolve.resolve_call(graph, "b.f.x", "m/a.py") is None and resolve.resolve_call(graph, "no", "m/a.py") is None
    one = resolve.resolve_one_import(graph, "m/a.py::import:f").first()
    assert (one.resolved_to, one.is_external) == ("m/b.py::f", False)
    assert resolve.resolve_one_import(graph, "m/a.py::import:os").first().is_external is False


def test_method_walks_over_diamonds_and_cycles(spark):
    from graphloom.operators import resolve
    from graphloom.operators.extract import build_graph

    code = "class Top:\n    def far(self): pass\nclass L(Top):\n    def near(self): pass\nclass R(Top):\n    def far(self): pass\nclass D(L, R): pass\nclass X(Y): pass\nclass Y(X, D): pass\n"
    graph = build_graph(spark.createDataFrame([("m.py", code)], "path string, content string"), resolve=False)
    symbols = resolve.Symbols(graph)
    parents = resolve.class_parents(graph, symbols, resolve.resolved_imports(graph, symbols))
    asked = spark.createDataFrame([(f"m.py::{c}", n) for c in ("D", "X", "Y", "R", "gone") for n in ("far", "near", "none")], "class_id string, name string")
    found = {(r.class_id, r.name): r.method_id for r in resolve.find_methods(asked, symbols, parents).collect()}
    # Depth-first: D meets Top through L before R.
    assert found[("m.py::D", "far")] == found[("m.py::X", "far")] == "m.py::Top::far"
    assert found[("m.py::R", "far")] == "m.py::R::far"
    table = {(r.class_id, r.name): r.method_id for r in resolve.method_table(graph, symbols, parents).collect()}
    assert found == {k: v for k, v in table.items() if k[0][-1] in "DXYR"}
