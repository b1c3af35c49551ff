import random
from collections import deque

import pytest
from graph_helpers import make_graph, pairs
from graphloom.operators import meeting, reach, traverse
from graphloom.operators.subgraph import connected_edges


def random_graph(spark, seed, nodes=30, edges=80):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(nodes)]
    links = [(rng.choice(names), rng.choice(names + ["ghost"]), rng.choice(["CALLS", "CONTAINS"]), 1) for _ in range(edges)]
    return links, make_graph(spark, [(n, n, "CLASS" if int(n[1:]) % 5 == 0 else "FUNCTION", "f.py", 1, None) for n in names], links)


def walk(links, starts, hops, types=None, blocked=lambda n: False):
    seen = {s: (0, s) for s in starts}
    queue = deque(seen)
    while queue:
        at = queue.popleft()
        depth, path = seen[at]
        if depth >= hops:
            continue
        for source, target, kind, _ in links:
            if source == at and target not in seen and (not types or kind in types) and not blocked(target):
                seen[target] = (depth + 1, f"{path} --{kind}--> {target}")
                queue.append(target)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_order_and_paths_equal_a_queue_search(spark, seed):
    links, graph = random_graph(spark, seed)
    rows = traverse.traverse(graph, ["n3", "n0"], 3).orderBy("hops", "key").collect()
    expected = walk(links, ["n3", "n0"], 3)
    assert [(r.id, r.hops, r.path) for r in rows] == [(i, h, p) for i, (h, p) in expected.items()]


def test_filters(spark):
    links, graph = random_graph(spark, 5)
    rows = traverse.traverse(graph, ["n1", "unknown"], 3, ["CALLS"], ["CLASS"]).collect()
    expected = walk(links, ["n1", "unknown"], 3, {"CALLS"}, lambda n: n != "ghost" and int(n[1:]) % 5 == 0)
    assert {(r.id, r.hops, r.path) for r in rows} == {(i, h, p) for i, (h, p) in expected.items()}
    with pytest.raises(KeyError):
        traverse.traverse(graph, ["n1"], 1, ["NOPE"])


def test_callers_follow_cycles_back_to_the_start(spark):
    graph = make_graph(
        spark, [(n, n, "FUNCTION", "f.py", 1, None) for n in "abc"],
        [("b", "a", "CALLS", 1), ("b", "a", "CALLS", 2), ("c", "b", "CALLS", 1), ("a", "c", "CALLS", 1), ("b", "c", "CONTAINS", 1)],
    )
    rows = traverse.callers(graph, "a", 3).orderBy("depth", "key").collect()
    assert [(r.caller, r.callee, r.depth) for r in rows] == [("b", "a", 1), ("b", "a", 1), ("c", "b", 2), ("a", "c", 3)]


def test_small_graph_answers(small_graph):
    reached = traverse.traverse(small_graph, ["a.py"], 2)
    assert pairs(reached, "id", "hops") == {("a.py", 0), ("a.py::Box", 1), ("a.py::helper_fn", 1), ("a.py::Box::process", 2)}
    rows = traverse.callers(small_graph, "a.py::helper_fn").orderBy("key").collect()
    assert [r.caller for r in rows] == ["a.py::Box::process", "b.py::entry"]


def test_shortest_path(spark, small_graph):
    steps = meeting.shortest_path(small_graph, "b.py::entry", "a.py::Box").orderBy("step").collect()
    assert len(steps) == 4 and steps[0].id == "b.py::entry" and steps[-1].id == "a.py::Box"
    assert meeting.shortest_path(small_graph, "b.py", "a.py").count() == 0
    assert meeting.shortest_path(small_graph, "a.py", "a.py").collect()[0].step == 0
    assert meeting.shortest_path_length(small_graph, "a.py", "b.py::entry").first().hops == 2


def one_sided(links, source):
    """Distances from ``source`` in both directions over links between known nodes."""
    near = {}
    for a, b, *_ in links:
        if "ghost" not in (a, b) and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    hops, queue = {source: 0}, deque([source])
    while queue:
        at = queue.popleft()
        for other in near.get(at, ()):
            if other not in hops:
                hops[other] = hops[at] + 1
                queue.append(other)
    return hops


@pytest.mark.parametrize("seed,edges,target", [(7, 34, "n9"), (8, 34, "n21"), (9, 60, "n2"), (10, 20, "n5")])
def test_meeting_searches_keep_the_tie_rule(spark, seed, edges, target):
    links, graph = random_graph(spark, seed, edges=edges)
    hops = one_sided(links, "n0")
    expected = []
    at = target
    while at in hops and hops[at]:
        ways = [(i, a if b == at else b, kind) for i, (a, b, kind, _) in enumerate(links) if at in (a, b) and a != b and "ghost" not in (a, b)]
        _, before, kind = min((i, o, k) for i, o, k in ways if hops.get(o) == hops[at] - 1)
        expected.append((hops[at], at, kind))
        at = before
    expected = sorted([*expected, (0, "n0", None)]) if target in hops else []
    steps = meeting.shortest_path(graph, "n0", target).orderBy("step").collect()
    assert [tuple(r) for r in steps] == expected
    assert [r.hops for r in meeting.shortest_path_length(graph, "n0", target).collect()] == ([hops[target]] if target in hops else [])


def test_meeting_searches_pass_hubs_by(spark):
    """A hub of 500 leaves beside the path is never opened; the search from one side opens it."""
    chain = [(f"c{i}", f"c{i + 1}", "CALLS", 1) for i in range(6)]
    leaves = [("c1", "hub", "CALLS", 1)] + [("hub", f"l{i}", "CALLS", 1) for i in range(500)]
    names = sorted({n for a, b, *_ in chain + leaves for n in (a, b)})
    graph = make_graph(spark, [(n, n, "FUNCTION", "f.py", 1, None) for n in names], chain + leaves)
    found = meeting.meet(traverse.adjacency(connected_edges(graph), "both"), "c0", "c6")
    assert found.distance == 6 and found.edges_followed < 20
    assert meeting.meet(traverse.adjacency(connected_edges(graph), "both"), "c0", "nowhere").distance is None


def test_reach_of_all_within_its_error(spark):
    links, graph = random_graph(spark, 12, nodes=60, edges=140)
    got = dict(pairs(reach.reach_of_all(graph, 3), "id", "reach"))
    assert got == {n: len(walk(links, [n], 3)) - 1 for n in [*(f"n{i}" for i in range(60)), "ghost"]}
    fan = [("top", f"m{i}", "CALLS", 1) for i in range(100)] + [(f"m{i}", f"x{i * 60 + j}", "CALLS", 1) for i in range(100) for j in range(60)]
    wide = make_graph(spark, [("top", "top", "FUNCTION", "f.py", 1, None)], fan)
    got = dict(pairs(reach.reach_of_all(wide, 4), "id", "reach"))
    assert abs(got["top"] - 6100) <= 4 * reach.standard_error() * 6100
    assert got["m3"] == 60 and got["x5"] == 0
    assert reach.reach_of_all(make_graph(spark, [], []), 2).count() == 0
    assert {r.reach for r in reach.reach_of_all(graph, 0).collect()} == {0}


def test_reach_moves_numbers_behind_the_first_hop(spark, monkeypatch):
    written = []
    keep = reach.materialize
    monkeypatch.setattr(reach, "materialize", lambda df, by=None: written.append(df.dtypes) or keep(df, by))
    _, graph = random_graph(spark, 12, nodes=20, edges=40)
    assert reach.reach_of_all(graph, 3).count() == 20
    # Only the table of nodes holds ids.
    assert [columns for columns in written if ("id", "string") in columns] == written[:1]
    assert all(kind != "string" for columns in written[1:] for _, kind in columns)


@pytest.mark.parametrize("seed,edges", [(3, 18), (4, 45)])
def test_components_equal_union_find(spark, seed, edges):
    links, graph = random_graph(spark, seed, nodes=40, edges=edges)
    links = [l for l in links if l[1] != "ghost"]
    parent = {f"n{i}": f"n{i}" for i in range(40)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in links:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    labels = traverse.connected_components(graph.entities, graph.relationships.filter("target_id <> 'ghost'"))
    assert dict(pairs(labels, "id", "component")) == {n: find(n) for n in parent}


def test_long_chain_needs_few_rounds(spark):
    n = 200
    edges = spark.range(n).selectExpr("concat('n', lpad(id, 4, '0')) as source_id", "concat('n', lpad(id + 1, 4, '0')) as target_id")
    nodes = spark.range(n + 1).selectExpr("concat('n', lpad(id, 4, '0')) as id")
    labels = traverse.connected_components(nodes, edges, max_rounds=14)
    assert pairs(labels, "component") == {("n0000",)}


def test_focus_and_paths_do_not_write_the_whole_graph(spark, monkeypatch):
    from graphloom.graph import Graph
    from graphloom.operators import meeting, subgraph

    edges = [("a", "b", "CALLS", 1), ("b", "ghost", "CALLS", 1), ("ghost", "c", "CALLS", 1), ("c", "b", "USES", 2), ("c", "d", "CALLS", 1), ("a", "a", "CALLS", 3), ("a", "b", "CALLS", 1)]
    graph = make_graph(spark, [(n, n, "CLASS", "f.py", 1, None) for n in "abcd"], edges)
    monkeypatch.setattr(Graph, "materialized", lambda self: pytest.fail("the graph is written with all columns"))
    for direction, depth, ids in (("both", 1, "ab"), ("both", 2, "abc"), ("outgoing", 3, "ab"), ("incoming", 2, "a")):
        part = subgraph.focus(graph, "a", depth, direction)
        assert sorted(r.id for r in part.entities.collect()) == list(ids)
        kept = sorted((s, t, k, n) for s, t, k, n in edges if {s, t} <= set(ids))
        assert sorted(tuple(r) for r in part.relationships.select("source_id", "target_id", "type", "line_number").collect()) == kept
    assert subgraph.focus(graph, "ghost", 2).entities.isEmpty() and subgraph.focus(graph, "ghost", 2).relationships.isEmpty()
    assert tuple(subgraph.focus_stats(graph, "a", 2).first()) == (4, 5, 3, 4, 1, 2)
    assert [r.id for r in meeting.shortest_path(graph, "a", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert meeting.shortest_path_length(graph, "a", "d").first().hops == 3
