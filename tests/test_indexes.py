"""Text index and nested intervals against scans and plain loops."""

import random

import pytest
from graph_helpers import make_graph, pairs

from graphloom.operators import intervals, search
from graphloom.operators.text_index import TextIndex

NAMES = ["Alpha", "alphabet", "BETA", "", "a", "ab", "ÄÖ straße", "tab\there", "x%y_z", "aaaa", "aaaaaa", "Beta test", "日本語", "İstanbul"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    entities = [(f"f.py::{i}", NAMES[i % len(NAMES)], "CLASS" if i % 2 else "FUNCTION", f"dir{i % 3}/F{i}.py", i, None) for i in range(60)]
    graph = make_graph(spark, entities, [])
    return graph.entities, TextIndex.build(graph.entities, f"file://{tmp_path_factory.mktemp('index')}/i", ("name", "file_path", "description"), parts=8)


@pytest.mark.parametrize("text", ["alp", "ALPHA", "a", "ab", "aa", "aaaaa", "straße", "%y", "_", "語", "no such", "", "t h", "eta", "f1", "\t", "İ"])
def test_index_equals_scan(indexed, text):
    entities, index = indexed
    found = ["ord", "id"]
    assert pairs(index.search(text, max_results=None), *found) == pairs(search.find_entities(entities, text, max_results=None), *found)
    both = ("name", "file_path")
    assert index.search(text, both, "CLASS", max_results=7).collect() == search.search_fields(entities, text, both, "CLASS", 7).collect()


def test_index_reads_few_folders(indexed):
    _, index = indexed
    plan = index.search("İstanbul", max_results=None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan


def test_grams_are_posted_once_a_block(spark, tmp_path):
    entities = make_graph(spark, [(f"f.py::{i}", f"order_{i % 7}", "CLASS", "f.py", i, None) for i in range(500)], []).entities
    index = TextIndex.build(entities, f"file://{tmp_path}/i", ("name",), parts=2)
    blocks = index.rows.select("block").distinct().count()
    assert index.rows.count() == 500 and index.postings.count() <= blocks * 30
    assert index.search("R_3", max_results=None).count() == 71


def test_stabbing_equals_loop(spark):
    rng = random.Random(11)
    spans = [(f"f{rng.randrange(3)}", low := rng.randrange(1, 3000), low + int(rng.expovariate(0.02)), i) for i in range(300)]
    spans += [("f0", 1, 10**6, 900), ("f1", 5, 5, 901)]
    points = [(f"f{rng.randrange(4)}", rng.randrange(0, 3200)) for _ in range(400)]
    found = intervals.stabbed(
        spark.createDataFrame(points, "f string, position long").distinct(), spark.createDataFrame(spans, "f string, low long, high long, n int"), "f"
    )
    assert sorted(map(tuple, found.select("f", "position", "n").collect())) == sorted(
        (f, p, n) for f, p in set(points) for g, low, high, n in spans if f == g and low <= p <= high
    )
    nothing = spark.createDataFrame([], "f string, low long, high long, n int")
    assert intervals.stabbed(spark.createDataFrame(points, "f string, position long"), nothing, "f").count() == 0


def test_innermost_definition(spark, build):
    code = "x = 1\nclass A:\n    def f(self):\n        def g():\n            return 1\n        return g\n\ndef one(): return (lambda: 1)\nclass Flat: y = 2\n"
    graph = build({"a.py": code}, resolve=False)
    asked = spark.createDataFrame([("a.py", i) for i in range(-1, 12)] + [("a.py", None), ("b.py", 3)], "file_path string, line int")
    got = {r.line: r.id for r in intervals.definition_at(asked, graph.entities).collect()}
    assert got == {2: "a.py::A", 3: "a.py::A::f", 4: "a.py::A::f::g", 5: "a.py::A::f::g", 6: "a.py::A::f", 8: "a.py::one", 9: "a.py::Flat"}


def test_containment_labels(spark):
    rng = random.Random(4)
    ids = {"r"}
    for _ in range(200):
        parent = rng.choice(sorted(ids))
        ids.add(f"{parent}::{rng.choice(['a', 'ab', 'b', 'a b', 'é', '~'])}")
    for lost in rng.sample(sorted(ids), 15):
        ids.discard(lost)
    graph = make_graph(spark, [(i, i, "CLASS", "f.py", 1, None) for i in sorted(ids)], [])
    below = lambda a, b: b.startswith(a + "::")
    got = {r.id: (r.depth, r.parent_id, r.descendants) for r in intervals.containment_labels(graph.entities).collect()}
    assert got == {
        i: (len(i.split("::")), max((a for a in ids if below(a, i)), key=len, default=None), sum(below(i, b) for b in ids)) for i in ids
    }
    tour = intervals.tour_numbers(graph.entities)
    some = graph.entities.filter("ord % 5 = 0")
    starts = {r.id for r in some.collect()}
    assert pairs(intervals.descendants_of(tour, some), "ancestor_id", "id", "distance") == {
        (a, b, b.count("::") - a.count("::")) for a in starts for b in ids if below(a, b)
    }
