"""Nothing is lost without a word: read errors, unparsable files, line ends, merges, other folders."""

import os
import subprocess
import sys

import pytest
from graph_helpers import pairs
from graphloom.operators import resolve
from graphloom.operators.context import code_slices
from graphloom.operators.extract import parse_errors, parsed_entities, syntax_facts
from graphloom.operators.subgraph import viewer_elements
from graphloom.operators.meeting import shortest_path, shortest_path_length
from graphloom.session import scratch_dir
from graphloom.sources.files import python_files, read_files


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        python_files(spark, str(tmp_path / "nothing"))


def test_read_errors_are_raised_but_missing_files_are_null(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    rows = [("a.py", str(tmp_path / "a.py")), ("gone.py", str(tmp_path / "gone.py"))]
    frame = spark.createDataFrame(rows, "path string, location string")
    assert {r.path: r.content for r in read_files(frame).collect()} == {"a.py": bytearray(b"x = 1\n"), "gone.py": None}
    folder = spark.createDataFrame([("d", str(tmp_path))], "path string, location string")
    with pytest.raises(Exception):
        read_files(folder).collect()


def test_unparsable_files_are_reported(spark):
    chain = "def f():\n    return a" + ".b()" * 400 + "\n"
    rows = [("ok.py", "x = 1\n"), ("bad.py", "def (\n"), ("none.py", None), ("deep.py", chain)]
    facts = syntax_facts(spark.createDataFrame(rows, "path string, content string"))
    reasons = {r.path: r.reason for r in parse_errors(facts).collect()}
    assert set(reasons) == {"bad.py", "none.py"} and reasons["bad.py"].startswith("SyntaxError")
    asked = syntax_facts(spark.createDataFrame(rows, "path string, content string"), kinds=("error",), columns=("path", "kind", "name"))
    assert asked.count() == 2 and {r.path: r.reason for r in parse_errors(asked).collect()} == reasons
    ids = {i for (i,) in pairs(parsed_entities(facts), "id")}
    assert {"ok.py::x", "deep.py::f"} <= ids and not any("bad" in i for i in ids)


def test_line_ends(spark):
    entities = spark.createDataFrame([(e, e, 2, 3) for e in ("unix", "dos", "mac")], "id string, file_path string, line_number int, end_line int")
    texts = [(name, end.join(["one", "two", "three  ", "", "four"])) for name, end in (("unix", "\n"), ("dos", "\r\n"), ("mac", "\r"))]
    sources = spark.createDataFrame(texts, "path string, source string")
    assert {r.code for r in code_slices(entities, sources).collect()} == {"two\nthree"}
    assert {r.code for r in code_slices(entities, sources, strip=False).collect()} == {"two\nthree  "}


def test_built_graphs_merge(build):
    graph = build({"a.py": "import os\nfrom b import f\ndef g():\n    f()\n", "b.py": "def f():\n    pass\n"})
    merged = graph.merge(graph).merge(graph)
    rows = merged.relationships.orderBy("ord").select("source_id", "target_id", "type").collect()
    one = graph.relationships.orderBy("ord").select("source_id", "target_id", "type").collect()
    assert rows == one * 3
    assert merged.entities.count() == graph.entities.count()


def test_deep_inheritance(build):
    levels = 30
    code = "class C0:\n    def m(self):\n        pass\n" + "".join(f"class C{i}(C{i - 1}):\n    pass\n" for i in range(1, levels))
    graph = build({"a.py": code + f"def use():\n    x = C{levels - 1}()\n    x.m()\n"})
    calls = pairs(graph.relationships.filter("type = 'CALLS_RESOLVED'"), "source_id", "target_id")
    assert ("a.py::use", "a.py::C0::m") in calls


def test_one_import_through_reexports(build):
    graph = build({
        "pkg/__init__.py": "from pkg.core import Engine\n", "pkg/core.py": "class Engine:\n    pass\n",
        "main.py": "from pkg import Engine\nimport os\n", "other.py": "from pkg import Missing\n",
    })
    row = resolve.resolve_one_import(graph, "main.py::import:Engine").first()
    assert row.resolved_to == "pkg/core.py::Engine"
    assert resolve.resolve_one_import(graph, "other.py::import:Missing").first().is_external
    assert [r.name for r in resolve.import_dependencies(graph, "main.py").orderBy("ord").collect()] == ["Engine", "os"]


def test_paths_of_unknown_entities(small_graph):
    assert shortest_path_length(small_graph, "nope", "nope").count() == 0 == shortest_path(small_graph, "nope", "nope").count()
    assert shortest_path_length(small_graph, "a.py", "a.py").first().hops == 0


def test_viewer_has_no_cap_of_its_own(small_graph):
    nodes, edges = viewer_elements(small_graph)
    assert nodes.count() == 6 and edges.count() == 5
    assert viewer_elements(small_graph, 2)[0].count() == 2


def test_scratch_needs_a_shared_folder_on_clusters():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        scratch_dir(Cluster)


def test_start_from_another_folder(tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("class A:\n    pass\n")
    program = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from graphloom.session import build_session\n"
        "from graphloom.sources.snapshot import build_from_path\n"
        "spark = build_session('t', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "print('ENTITIES', build_from_path(spark, 'code').entities.count())\n"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ENTITIES 2" in done.stdout, done.stderr[-2000:]


def test_ids_and_relative_paths(spark):
    from pyspark.sql import functions as F

    from graphloom.functions.names import entity_id, relative_path

    rows = spark.createDataFrame([("src/a.py", ["A", "b"]), ("lib/x.py", []), ("src", [])], "path string, scopes array<string>")
    got = rows.select(entity_id(F.col("path"), F.col("scopes")), relative_path(F.col("path"), "src/")).collect()
    assert [tuple(r) for r in got] == [("src/a.py::A::b", "a.py"), ("lib/x.py", "lib/x.py"), ("src", "src")]


def test_digest_is_that_of_its_sums(spark):
    import hashlib

    from graphloom.sources.snapshot import digest

    texts = [f"t{i}" for i in range(1000)]
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    words = [sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes) for i in range(8)]
    rows = digest(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    assert rows.first()[0] == hashlib.sha256(",".join(map(str, words)).encode()).hexdigest()
    # One row a task is summed exactly, not every row.
    assert "SPARK_PARTITION_ID" in rows._jdf.queryExecution().toString()
