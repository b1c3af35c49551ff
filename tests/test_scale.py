"""What queries write and move: steps that only grow with the answer must not read or write all edges."""

from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import extract
from graphloom.plans.diff import diff_entities, diff_graphs, diff_relationships
from graphloom.plans.edit_plan import edit_plan
from graphloom.session import materialize

FILES = {
    "a.py": "import os\n\ndef helper(x):\n    note = log(x)\n    return note\n\ndef main():\n    return helper(1)\n",
    "b.py": "from a import helper\n\nclass Box:\n    def go(self):\n        return helper(self)\n",
    "odd::b.py": "def go():\n    return 1\n",
}


def parsed(spark, files=FILES):
    facts = extract.stored_facts(spark.createDataFrame(list(files.items()), "path string, content string"))
    return extract.numbered_graph(facts, materialize(extract.file_numbers(facts)))


def rows(df):
    return sorted(map(str, df.collect()))


def test_plan_of_a_parse_writes_no_edges(spark):
    """neighbours and changes of a parsed graph come from its facts, equal rows are not shuffled by id."""
    graph = parsed(spark)
    proposed = graph.with_entities(graph.entities.filter("name <> 'helper' or type = 'IMPORT'").withColumn(
        "end_line", F.when(F.col("name") == "go", F.lit(99)).otherwise(F.col("end_line"))))
    changes = diff_graphs(graph, proposed)
    sources = spark.createDataFrame(list(FILES.items()), "path string, source string")
    plan = edit_plan(changes, graph.entities, None, sources, max_snippets=4)
    shown = rows(plan.snippets)
    found = rows(changes.entities)
    near = rows(changes.neighbors)
    assert not graph.written and not proposed.written
    plain, other = Graph(graph.entities, graph.relationships), Graph(proposed.entities, graph.relationships)
    expected = diff_graphs(plain, other)
    assert found == rows(diff_entities(plain.entities, other.entities)) and len(found) == 3
    assert near == rows(expected.neighbors) and near
    assert shown == rows(edit_plan(expected, plain.entities, None, sources, max_snippets=4).snippets) and shown


def test_paths_are_inferred_from_keys_of_edges(spark):
    """edges that suggest a file need their keys only, and none where no change asks for one."""
    graph = parsed(spark)
    added = graph.entities.filter("id = 'a.py::main'").withColumn("id", F.lit("new")).withColumn("file_path", F.lit(""))
    edges = graph.relationships.filter("source_id = 'a.py::main' and type = 'CALLS'").limit(1)
    edges = edges.withColumn("source_id", F.lit("new")).withColumn("target_id", F.lit("b.py::Box"))
    other = Graph(graph.entities.unionByName(added), graph.relationships.unionByName(edges))
    changes = diff_graphs(Graph(graph.entities, graph.relationships), other)
    assert [tuple(r) for r in edit_plan(changes, graph.entities).inferred_paths.collect()] == [("new", "b.py")]
    assert rows(diff_relationships(graph.relationships, other.relationships).select("source_id"))


def test_components_over_numbers(spark):
    """numbered nodes give the components that ids give; unknown ends link nothing."""
    from graphloom.operators import subgraph, traverse

    edges = [("b", "a"), ("c", "b"), ("d", "ghost"), ("ghost", "a"), ("e", "e"), ("g", "f"), ("f", "g"), ("h", "a")]
    relationships = spark.createDataFrame([(s, t, "CALLS", i) for i, (s, t) in enumerate(edges)], "source_id string, target_id string, type string, ord bigint")
    entities = spark.createDataFrame([(i,) for i in ["a", "b", "c", "c", "d", "e", "f", "g", "h", None]], "id string")
    graph = Graph(entities, relationships)
    nodes = traverse.numbered_nodes(graph.entities)
    numbered = subgraph.connected_edges(graph, nodes)
    assert {"source_number", "target_number"} <= set(numbered.columns)
    found = rows(traverse.connected_components(nodes, numbered))
    assert found == rows(traverse.connected_components(entities, subgraph.connected_edges(graph)))
    assert ("h", "a") in [tuple(r) for r in traverse.connected_components(nodes, numbered).collect()]


def test_walks_with_one_path_are_not_compared(spark):
    """methods over chains, cycles, shared ancestors and shortcuts equal the table of all methods."""
    from graphloom.operators import resolve

    bases = {"A0": "", "A1": "A0", "A2": "A1", "A3": "A2", "B": "A2, A0", "C": "B, A3", "D": "C, B", "L1": "L3", "L2": "L1", "L3": "L2", "E": "L1, A0"}
    owned = {"A0": ["f", "g"], "A2": ["g"], "L2": ["h"], "B": ["h"]}
    text = "".join(
        f"class {c}({b}):\n" + "".join(f"    def {m}(self):\n        return 1\n" for m in owned.get(c, [])) + ("" if c in owned else "    x = 1\n")
        for c, b in bases.items())
    graph = parsed(spark, {"k.py": text})
    symbols = resolve.Symbols(graph)
    found = materialize(resolve.class_parents(graph, symbols, resolve.resolved_imports(graph, symbols)))
    requests = spark.createDataFrame([(f"k.py::{c}", m) for c in bases for m in "fgh"], "class_id string, name string")
    methods = {(r.class_id[6:], r.name): r.method_id[6:] for r in resolve.find_methods(requests, symbols, found).collect()}
    assert methods == {(r.class_id[6:], r.name): r.method_id[6:] for r in resolve.method_table(graph, symbols, found).collect()}
    assert methods["D", "g"] == "A2::g" and methods["L1", "h"] == "L2::h" and ("A3", "h") not in methods and methods["E", "f"] == "A0::f"
    _, walked = resolve.walk_methods(requests.filter("class_id = 'k.py::A3' and name = 'g'"), symbols, found)
    assert sorted(r.at for r in walked.collect()) == ["k.py::A2", "k.py::A3"]


CODE = {
    "base.py": "class A:\n    def f(self):\n        return 1\n\nclass B(A):\n    def g(self):\n        return self\n",
    "use.py": "from base import B\n\ndef run():\n    box = B()\n    box.f()\n    box.g()\n    return run2()\n\ndef run2():\n    return log(1)\n",
}


def test_resolved_edges_without_all_parsed_ones(spark):
    """methods and calls read the edges of their kinds, and the resolved edges are those of the whole graph."""
    from graphloom.operators import resolve

    def hinted(graph):
        return extract.type_hints(graph.facts)

    lean, whole = parsed(spark, CODE), parsed(spark, CODE)
    some = resolve.resolve_graph(lean, hinted(lean), parsed_edges=False)
    assert not lean.written
    every = resolve.resolve_graph(whole, hinted(whole))
    assert whole.written
    shown = ["source_id", "target_id", "type", "line_number", "is_resolved", "properties"]
    kinds = F.col("type").isin("CALLS_RESOLVED", "IMPORTS_RESOLVED_TO") | F.col("is_resolved")
    found = rows(some.relationships.select(*shown))
    assert found == rows(every.relationships.filter(kinds).select(*shown)) and sum("'CALLS_RESOLVED'" in r for r in found) == 4
    assert rows(some.entities) == rows(every.entities)
    graph = parsed(spark, CODE)
    symbols = resolve.Symbols(graph)
    parents = materialize(resolve.class_parents(graph, symbols, resolve.resolved_imports(graph, symbols)))
    assert len(rows(resolve.method_table(graph, symbols, parents))) == 3 and not graph.written


def test_parse_hands_on_small_frames(spark):
    """No frame of facts grows with the batch of files it was parsed from."""
    import pyarrow as pa

    n = 3 * extract.FILES_AT_ONCE + 1
    text = "".join(f"a{i} = f({i})\n" for i in range(20))
    batch = pa.record_batch({"path": [f"f{i}.py" for i in range(n)], "content": [text] * n})
    frames = list(extract._parse(iter([batch, batch.slice(0, 0)]), None, extract.FACT_COLUMNS))
    assert max(f.num_rows for f in frames) < extract.ROWS_PER_FRAME + 41 and sum(f.num_rows for f in frames) == 41 * n
    assert [f.num_rows for f in extract._parse(iter([batch.slice(0, 0)]), None, ("path",))] == [0]
