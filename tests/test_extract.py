import json

from graph_helpers import pairs
from graphloom.operators.extract import parsed_entities, parsed_relationships, syntax_facts

SHAPES = '''"""Module text."""
import os
from typing import List, Dict

LIMIT = 42

class Base:
    """A base."""
    shared = 1

    def __init__(self, name: str):
        self.name = name

    def run(self):
        return self.name

    @staticmethod
    def make():
        return LIMIT

    @property
    def title(self):
        return self.name

class Child(Base):
    def run(self):
        return 2

def add(a: int, b: int = 5) -> int:
    result = a + b
    return result

async def fetch(value):
    return value.upper()
'''

CALLS = '''def tool(x):
    return x

def start():
    result = tool(1)
    result.append(2)
    processed = result
    print(processed)

class Calc:
    def plus(self, a):
        return a

    def work(self):
        total = self.plus(1)
        total = 2
        return total
'''


def facts_of(spark, **files):
    rows = [(name + ".py", text) for name, text in files.items()]
    return syntax_facts(spark.createDataFrame(rows, "path string, content string"))


def counts(df):
    return {r["type"]: r["count"] for r in df.groupBy("type").count().collect()}


def test_shapes_parse_and_edges(spark):
    facts = facts_of(spark, m=SHAPES).cache()
    entities = parsed_entities(facts)
    assert entities.count() == 17
    assert entities.select("id").distinct().count() == 16
    assert counts(parsed_relationships(facts)) == {"CONTAINS": 22, "IMPORTS": 3, "INHERITS": 1, "CALLS": 1, "DEFINES_IN": 1}
    by_id = {r.id: r for r in entities.filter("type <> 'FILE'").collect()}
    assert by_id["m.py"].type == "MODULE" and json.loads(by_id["m.py"].properties)["description"] == "Module text."
    assert by_id["m.py::LIMIT"].type == "CONSTANT" and by_id["m.py::fetch"].type == "ASYNC_FUNCTION"
    add = json.loads(by_id["m.py::add"].properties)
    assert add["return_type"] == "int" and [a["name"] for a in add["args"]] == ["a", "b"]
    assert json.loads(by_id["m.py::Base::make"].properties)["decorators"] == ["staticmethod"]
    assert json.loads(by_id["m.py::Child"].properties)["bases"] == ["Base"]
    assert json.loads(by_id["m.py::import:List"].properties) == {
        "description": "From typing import List", "module": "typing", "original_name": "List"}


def test_shapes_resolution(build):
    graph = build({"m.py": SHAPES})
    assert graph.entities.count() == 18
    assert graph.relationships.count() == 31
    resolved = graph.relationships.filter("is_resolved")
    assert pairs(resolved, "source_id", "target_id", "type") == {("m.py::Child", "m.py::Base", "INHERITS")}
    assert pairs(graph.relationships.filter("type = 'IMPORTS_RESOLVED_TO'"), "target_id") == {
        ("external::typing::List",), ("external::typing::Dict",)}


def test_call_edges(build, spark):
    facts = facts_of(spark, c=CALLS)
    assert parsed_entities(facts).count() == 11
    graph = build({"c.py": CALLS})
    assert graph.entities.count() == 9
    assert counts(graph.relationships) == {"CONTAINS": 17, "CALLS": 4, "DEFINES_IN": 4, "CALLS_RESOLVED": 1}
    # A reassigned name keeps its first position and takes the last values.
    total = graph.entities.filter("id = 'c.py::Calc::work::total'").collect()
    assert len(total) == 1 and total[0].line_number == 16


def test_bad_and_empty_files(spark):
    rows = [("empty.py", b""), ("broken.py", b"def broken(\n"), ("null.py", b"x = 1\x00"), ("latin.py", b"x = '\xe9'"), ("gone.py", None)]
    facts = syntax_facts(spark.createDataFrame(rows, "path string, content binary"))
    assert pairs(parsed_entities(facts), "file_path", "type") == {("empty.py", "FILE"), ("empty.py", "MODULE")}


def test_argument_kinds_and_scopes(spark):
    text = (
        "@deco(1)\n@pkg.mark\ndef f(a, /, b: int, *rest, key=1, **more): pass\n"
        "class G(Generic[T], metaclass=M):\n    x: List[int]\n    a = b = Cls()\n"
        "    made = Path.cwd()\n"
        "if True:\n    import z as zz\n    def inner(): return Thing()()\n"
        "a.b = 1\n(p, q) = 1, 2\n"
    )
    facts = facts_of(spark, s=text).cache()
    entities = {r.id: r for r in parsed_entities(facts).filter("type <> 'FILE'").collect()}
    kinds = [(a["name"], a["kind"]) for a in json.loads(entities["s.py::f"].properties)["args"]]
    assert kinds == [("b", "positional-or-keyword"), ("a", "positional-only"), ("rest", "vararg"), ("key", "keyword-only"), ("more", "kwarg")]
    assert json.loads(entities["s.py::f"].properties)["decorators"] == ["deco", "pkg.mark"]
    assert json.loads(entities["s.py::G"].properties)["bases"] is None
    assert json.loads(entities["s.py::G::x"].properties)["type_annotation"] == "List[int]"
    assert {"s.py::G::a", "s.py::G::b", "s.py::inner", "s.py::import:zz"} <= set(entities)
    assert not any("p" == r.name or "q" == r.name for r in entities.values())
    edges = pairs(parsed_relationships(facts).filter("type <> 'CONTAINS'"), "source_id", "target_id", "type")
    assert ("s.py::G", "Generic", "INHERITS") in edges
    assert ("s.py::G", "Path.cwd", "INSTANTIATES") in edges and ("s.py::G", "Cls", "INSTANTIATES") in edges
    assert ("s.py::f", "deco", "CALLS") in edges
    assert ("s.py::inner", "Thing", "INSTANTIATES") in edges and ("s.py::inner", "Thing()", "INSTANTIATES") in edges


def test_edge_order_is_breadth_first_per_function(build):
    graph = build({"o.py": "def f():\n    if a():\n        b(c())\n    d()\n\ndef g(): e()\n"}, resolve=False)
    rows = graph.relationships.filter("type = 'CALLS'").orderBy("ord").select("target_id").collect()
    assert [r.target_id for r in rows] == ["a", "d", "b", "c", "e"]


def test_numbering_a_file_moves_no_facts(spark):
    from graphloom.operators.extract import file_numbers, graph_relationships, stored_facts
    from graphloom.session import materialize

    rows = [(f"a{i}.py", "class A(B):\n    def f(self):\n        x = C()\n        return g(x)\n") for i in range(40)]
    facts = stored_facts(spark.createDataFrame(rows + rows[:2], "path string, content string"))
    edges = graph_relationships(facts, materialize(file_numbers(facts)))
    shuffled = [line for line in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(file_path" in line]
    # At most the file numbers are dealt by path, never the edges.
    assert len(shuffled) <= 1
    places = edges.selectExpr("ord % 134217728 as place", "ord div 134217728 as n").groupBy("n").agg({"place": "max"}).collect()
    assert sorted(r[1] for r in places) == [10] * 38 + [20] * 2


def test_edges_are_written_when_they_are_read(spark, monkeypatch):
    """What reads entities and imports only neither numbers nor writes the edges."""
    from graphloom import graph as graph_module
    from graphloom.operators import extract, resolve

    files = {"a/x.py": "import os\nfrom a.y import Y as Z\nclass X(Z):\n    pass\n", "a/y.py": "class Y:\n    def m(self):\n        return Y()\n"}
    facts = extract.stored_facts(spark.createDataFrame(list(files.items()), "path string, content string"))
    written = []
    keep = graph_module.materialize
    monkeypatch.setattr(graph_module, "materialize", lambda df, *a: written.append(df.columns) or keep(df, *a))
    graph = extract.numbered_graph(facts, extract.file_numbers(facts))
    edges, externals = resolve.import_edges(graph, resolve.resolved_imports(graph))
    assert externals.count() == 0 and [r.target_id for r in edges.collect()] == ["a/y.py::Y"]
    assert not any("source_id" in columns for columns in written)
    last = max(frame.agg({"ord": "max"}).first()[0] for frame in (graph.entities, graph.relationships))
    assert resolve.Symbols(graph).span > last and len([c for c in written if "source_id" in c]) == 1
    assert graph.relationships is graph.relationships and graph.materialized() is graph


def test_near_edges_and_bases_without_writing_all_edges(spark):
    """A walk over few hops and the bases of classes read the facts of their files, with the rows of the whole graph."""
    from graphloom.operators import context, extract
    from graphloom.operators.traverse import traverse

    files = {
        "a.py": "class A:\n    def f(self):\n        return g()\n",
        "b.py": "class B(A, C):\n    x = 1\n\ndef h():\n    y = B()\n    return k(y)\n",
        "odd::c.py": "def inner():\n    return h()\n",  # a prefix of its ids lies outside of the file
    }
    sources = spark.createDataFrame(list(files.items()), "path string, content string")
    facts = extract.stored_facts(sources)
    whole, lazy = (extract.numbered_graph(facts, extract.file_numbers(facts)) for _ in range(2))
    bases = whole.relationships.filter("type = 'INHERITS'")  # writes all edges of this one
    shown = ["source_id", "target_id", "line_number"]
    for start in (["b.py"], ["b.py::h", "a.py"], ["odd"], ["odd::c.py::inner"]):
        near, expected = (
            {repr(r) for r in traverse(graph, start, 2).select("id", "hops", "path", "key").collect()} for graph in (lazy, whole)
        )
        assert near == expected and len(near) > len(start)
    assert lazy.inherits.orderBy("ord").select(*shown).collect() == bases.orderBy("ord").select(*shown).collect() != []
    code = context.extract_context(lazy, sources.withColumnRenamed("content", "source"), "b.py::h", 1)
    assert {(r.id, r.code) for r in code.collect()} == {
        ("b.py::h", "def h():\n    y = B()\n    return k(y)"), ("b.py::h::y", "    y = B()\n    return k(y)"),
    }
    assert whole.written and not lazy.written


def test_lines_are_looked_up_without_calls_and_texts(spark):
    from graphloom.operators import intervals
    from graphloom.operators.extract import build_graph, stored_spans

    code = [("a.py", "def f():\n    g(1)\n    x = 2\n\nf = 3\nclass A:\n    def f(self):\n        return f\n"), ("b.py", "def (\n"), ("c.py", "def f():\n    pass\n")]
    sources = spark.createDataFrame(code, "path string, content string")
    spans, columns = stored_spans(sources), ("id", "file_path", "type", "line_number", "end_line")
    assert pairs(spans, *columns) == pairs(build_graph(sources, resolve=False).entities, *columns)
    assert "properties" not in spans.columns
    asked = spark.createDataFrame([(f, i) for f in ("a.py", "b.py", "c.py") for i in range(10)], "file_path string, line int")
    assert pairs(intervals.definition_at(asked, spans), "file_path", "line", "id") == {
        ("a.py", 6, "a.py::A"), ("a.py", 7, "a.py::A::f"), ("a.py", 8, "a.py::A::f"), ("c.py", 1, "c.py::f"), ("c.py", 2, "c.py::f")}
