import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.operators import graph, local_graph

FAN = [("b", "a"), ("c", "a"), ("d", "b")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@pytest.fixture(params=[graph.LOCAL, 0], ids=["in tasks", "in rounds"])
def local(request, monkeypatch):
    """Both ways: whole components in tasks, and rounds of joins."""
    monkeypatch.setattr(graph, "LOCAL", request.param)


def names(df):
    return sorted(r[0] for r in df.collect())


def test_fan(spark):
    e, n = edges(spark, FAN), nodes(spark, "abcd")
    assert names(graph.leaves(n, e)) == ["c", "d"] and names(graph.roots(n, e)) == ["a"]
    assert sorted(tuple(r) for r in graph.closure(e).collect()) == [("b", "a"), ("c", "a"), ("d", "a"), ("d", "b")]
    assert {r.node: r.depth for r in graph.depths(n, e).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert names(graph.cycle_nodes(e)) == [] and names(graph.blocked(e, nodes(spark, "b"))) == ["d"]
    depth = graph.depths(n, e)
    assert [r.node for r in graph.trunk(graph.primary_parents(e, depth), depth).orderBy("step").collect()] == ["d", "b", "a"]


def test_cycle_and_empty(spark, local):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "a")])
    assert names(graph.cycle_nodes(e)) == ["a", "b"]
    assert graph.closure(edges(spark, [])).count() == 0
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_of_a_chain_and_a_star(spark, local):
    pairs = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 130), 100)}


def test_parents_take_the_deepest_then_the_smallest(spark):
    e = edges(spark, [("b", "a"), ("c", "a"), ("x", "a"), ("x", "c"), ("x", "b")])
    assert {r.child: r.parent for r in graph.primary_parents(e, graph.depths(nodes(spark, "abcx"), e)).collect()} == {"b": "a", "c": "a", "x": "b"}


def test_first_edges(spark):
    rows = spark.createDataFrame([("a", "b", 1, 0, "explicit"), ("a", "b", 0, 5, "late"), ("a", "b", 0, 2, "early")], "src string, dst string, priority int, ord int, via string")
    assert [tuple(r) for r in graph.first_edges(rows, "via").collect()] == [("a", "b", "early")]


def test_topological_order():
    assert graph.topological_order(["a", "z", "b"], [("b", "a")]) == ["a", "b", "z"]
    assert graph.topological_order(["a", "b"], [("a", "b"), ("b", "a")]) is None


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9))))
def test_topological_order_respects_edges(pairs):
    pairs = [(str(max(p)), str(min(p))) for p in pairs if p[0] != p[1]]
    order = graph.topological_order([str(k) for k in range(10)], pairs)
    assert all(order.index(d) < order.index(s) for s, d in pairs)


def test_tree():
    assert graph.tree_lines({"b": "a", "c": "a", "d": "b"}, list("abcd")) == ["a", "├── b", "│   └── d", "└── c"]


def brute(pairs):
    """All (a, b) joined by a path; each node's smallest partner on cycles; longest paths with cycles taken together."""
    paths = set(pairs)
    while more := {(a, d) for a, b in paths for c, d in paths if b == c} - paths:
        paths |= more
    nodes = {x for p in pairs for x in p}
    label = {a: min([a, *(b for b in nodes if (a, b) in paths and (b, a) in paths)]) for a in nodes}

    def depth(a):
        return max([0, *(1 + depth(d) for s, d in pairs if label[s] == label[a] != label[d])])

    return paths, label, {a: depth(a) for a in nodes}


def graphs(n, seed=3):
    rnd = random.Random(seed)
    for _ in range(n):
        size = rnd.randint(1, 9)
        yield {(rnd.randrange(size), rnd.randrange(size)) for _ in range(rnd.randint(0, 14))}


def test_local_algorithms():
    for pairs in graphs(300):
        paths, label, depth = brute(pairs)
        src, dst = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
        assert {(int(a), int(b)) for x, y in local_graph.pairs(10, src, dst) for a, b in zip(x, y)} == paths
        strong, deep = local_graph.strong(10, src, dst), local_graph.depths(10, src, dst)
        assert all(strong[a] == label[a] and deep[a] == depth[a] for a in label)
        assert set(np.flatnonzero(local_graph.cyclic(10, src, dst)).tolist()) == {a for a, b in paths if a == b}
        assert set(np.flatnonzero(local_graph.reached(10, src, dst, np.array([0, 1]))).tolist()) == {a for a, b in paths if b in (0, 1)}


def test_graphs_with_cycles(spark, local):
    """Several graphs at once, each with nodes of its own."""
    every = [{(f"{k}/{a}", f"{k}/{b}") for a, b in pairs} for k, pairs in enumerate(graphs(5, seed=5))]
    paths, depth, nodes_, start = set(), {}, set(), {f"{k}/{a}" for k in range(5) for a in (0, 1)}
    for pairs in every:
        p, _, d = brute(pairs)
        paths |= p
        depth |= d
        nodes_ |= set(d)
    e = edges(spark, [p for pairs in every for p in pairs])
    assert {tuple(r) for r in graph.closure(e).collect()} == paths
    assert {r.node: r.depth for r in graph.depths(nodes(spark, sorted(nodes_)), e).collect()} == depth
    assert names(graph.cycle_nodes(e)) == sorted({a for a, b in paths if a == b})
    assert names(graph.blocked(e, nodes(spark, sorted(start)))) == sorted({a for a, b in paths if b in start} - start)
    assert names(graph.reached(e, nodes(spark, sorted(start)))) == sorted({a for a, b in paths if b in start})


def test_trunk(spark, local):
    parents = spark.createDataFrame([(k, k - 1) for k in range(1, 40)] + [(100, 5)], "child long, parent long")
    depth = spark.createDataFrame([(k, k) for k in range(40)] + [(100, 6), (200, 39)], "node long, depth long")
    assert [tuple(r) for r in graph.trunk(parents, depth).orderBy("step").collect()] == [(39 - k, k) for k in range(40)]


def test_cycle_paths():
    found = graph.cycle_paths(list("abcde"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a"), ("e", "e")])
    assert found == [["a", "b", "c", "a"], ["b", "c", "b"], ["e", "e"]]
    chain = [(f"{k:05}", f"{k + 1:05}") for k in range(5000)]
    assert graph.cycle_paths([], chain) == [] and len(graph.tree_lines({b: a for a, b in chain}, [f"{k:05}" for k in range(5001)])) == 5001


def test_counts(spark):
    assert graph.counts(nodes(spark, "abcd"), edges(spark, FAN)).first().asDict() == {"nodes": 4, "edges": 3, "leaves": 2}


def test_tasks_take_some_components_at_a_time(spark, monkeypatch):
    """A task's memory doesn't grow with its share of all edges: what it holds ends with a component, soon after PACK edges."""
    monkeypatch.setattr(graph, "LOCAL", 20)
    monkeypatch.setattr(graph, "PACK", 30, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        e = spark.createDataFrame([(100 * c + k + 1, 100 * c + k) for c in range(40) for k in range(1 + c % 15)], "src long, dst long")

        def run(names, src, dst):
            yield {"n": [len(src)], "components": [",".join(str(x) for x in sorted({v.as_py() // 100 for v in names}))]}

        small, large = graph._in_tasks(e, run, "n long, components string")
        rows = small.collect()
        assert large is None and sum(r.n for r in rows) == e.count() and max(r.n for r in rows) <= 30 + 7 + 15
        assert sorted(int(c) for r in rows for c in r.components.split(",")) == list(range(40))
        depth = {r.node: r.depth for r in graph.depths(e.select("src").withColumnRenamed("src", "node"), e).collect()}
        assert depth == {100 * c + k + 1: k + 1 for c in range(40) for k in range(1 + c % 15)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("local", [graph.LOCAL, 6, 0])
def test_tree_in_tasks_and_in_rounds(spark, monkeypatch, local):
    """Two trees, nodes on and below a cycle, and one alone, against the text made on the driver."""
    monkeypatch.setattr(graph, "LOCAL", local)
    parents = {"b": "a", "c": "a", "d": "b", "e": "b", "f": "e", "é": "e", "g": "c", "h": "g", "z": "y", "p": "q", "q": "p", "r": "q"}
    every = sorted({*parents, *parents.values(), "lone"})
    found = graph.tree(nodes(spark, every), spark.createDataFrame(list(parents.items()), "child string, parent string")).collect()
    assert [r.line for r in sorted(found)] == graph.tree_lines(parents, every) and [r.pos for r in sorted(found)] == list(range(len(found)))
