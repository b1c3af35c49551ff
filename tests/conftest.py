import pytest

from graph_helpers import make_graph
from graphloom.graph import Graph
from graphloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.default.parallelism": "4", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small_graph(spark):
    """Two files, one class with a method, two callers of one helper."""
    return make_graph(
        spark,
        [
            ("a.py", "a.py", "FILE", "dir/a.py", 1, None),
            ("b.py", "b.py", "FILE", "dir/b.py", 1, None),
            ("a.py::Box", "Box", "CLASS", "dir/a.py", 5, 20),
            ("a.py::helper_fn", "helper_fn", "FUNCTION", "dir/a.py", 25, 30),
            ("b.py::entry", "entry", "FUNCTION", "dir/b.py", 10, 15),
            ("a.py::Box::process", "process", "FUNCTION", "dir/a.py", 8, 15),
        ],
        [
            ("a.py", "a.py::Box", "CONTAINS", 1),
            ("a.py", "a.py::helper_fn", "CONTAINS", 1),
            ("a.py::Box", "a.py::Box::process", "CONTAINS", 8),
            ("a.py::Box::process", "a.py::helper_fn", "CALLS", 12),
            ("b.py::entry", "a.py::helper_fn", "CALLS", 12),
        ],
    )


@pytest.fixture(scope="session")
def build(spark):
    from graphloom.operators.extract import build_graph

    def run(files: dict[str, str], **kwargs) -> Graph:
        return build_graph(spark.createDataFrame(list(files.items()), "path string, content string"), **kwargs)

    return run
