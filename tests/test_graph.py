"""Closure, delta, order, cycles, DOT and tree flattening."""

import pytest
from pyspark.sql import functions as F

from tarn.operators import graph, tree

TRAP = [("R", "C"), ("R", "A"), ("A", "D"), ("D", "X"), ("C", "X")]


def make(spark, pairs, extra=(), kind="pkg"):
    names = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(n, kind, len(n) * 10) for n in names], "id string, kind string, size long")
    return nodes, spark.createDataFrame(pairs, "parent_id string, child_id string")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_closure_keeps_all_edges(spark):
    found = graph.closure(roots(spark, "R", "R"), *make(spark, TRAP, ["lonely"]))
    assert ids(found.nodes) == ["A", "C", "D", "R", "X"]
    assert sorted(map(tuple, found.edges.collect())) == sorted(TRAP)
    assert (found.num_objects(), found.unpacked_size()) == (5, 50)
    again = graph.closure(found.nodes.select("id"), found.nodes, found.edges)
    assert ids(again.nodes) == ids(found.nodes)


def test_closure_filter_and_errors(spark):
    nodes, edges = make(spark, TRAP)
    assert ids(graph.closure(roots(spark, "R"), nodes, edges, F.col("id") != "A").nodes) == ["C", "R", "X"]
    assert ids(graph.closure(roots(spark, "R"), nodes, edges, lambda met: met.where("id not in ('A', 'C')")).nodes) == ["R"]
    assert graph.closure(roots(spark), nodes, edges).nodes.count() == 0
    with pytest.raises(graph.MissingObjects, match="Q"):
        graph.closure(roots(spark, "Q"), nodes, edges)
    with pytest.raises(graph.MissingObjects, match="X"):
        graph.closure(roots(spark, "R"), nodes.where("id <> 'X'"), edges)


def test_levels_and_cycles(spark):
    nodes, edges = make(spark, TRAP)
    assert {r["id"]: r["level"] for r in graph.levels(nodes, edges).collect()} == {"X": 0, "C": 1, "D": 1, "A": 2, "R": 3}
    order = [r["id"] for r in graph.topological(nodes, edges).collect()]
    assert all(order.index(c) < order.index(p) for p, c in TRAP)
    for bad in ([*TRAP, ("X", "A")], [("A", "A")], [("A", "B"), ("B", "A"), ("Z", "A")]):
        with pytest.raises(graph.CycleFound, match="through A"):
            graph.levels(*make(spark, bad)).collect()


def test_deep_chain(spark):
    nodes, edges = make(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(12)])
    assert graph.closure(roots(spark, "n000"), nodes, edges).nodes.count() == 13


def test_yield_order_and_dot(spark):
    nodes = spark.createDataFrame([("p", "pkg", 1), ("q", "pkg", 1), ("t", "tree", 1), ("b", "blob", 1), ("s", "spec", 1)], "id string, kind string, size long")
    edges = spark.createDataFrame([("p", "q"), ("p", "t"), ("t", "b"), ("s", "p"), ("q", "t")], "parent_id string, child_id string")
    assert [r["id"] for r in graph.yield_order(nodes, edges).collect()] == ["s", "b", "t", "q", "p"]
    found = graph.closure(roots(spark, "s"), nodes, edges)
    assert graph.render_dot(found).split("\n") == ["digraph G {", '  "p" [shape = box]', '  "q" -> "p"', '  "q" [shape = box]', '  "s" [shape = box]', '  "p" -> "s"', "}"]
    assert '  "b" -> "t"' in graph.render_dot(found, show_content=True)


def test_delta(spark):
    nodes, edges = make(spark, [("R", "A"), ("A", "X"), ("R", "B"), ("B", "X"), ("X", "Y")])
    there = spark.createDataFrame([("X", "pkg"), ("elsewhere", "pkg")], "id string, kind string")
    found = graph.delta(roots(spark, "R"), nodes, edges, there)
    assert (found.num_present, ids(found.missing.nodes), ids(found.present)) == (1, ["A", "B", "R"], ["X"])
    deep = graph.delta(roots(spark, "R"), nodes, edges, there, deep=True)
    assert ids(deep.missing.nodes) == ["A", "B", "R", "Y"]
    nothing = graph.delta(roots(spark, "R"), nodes, edges, there.limit(0))
    assert (nothing.num_present, nothing.missing.nodes.count()) == (0, 5)


def test_flatten_and_build(spark):
    files = spark.createDataFrame([(1, "a/b/c", "Blob", "x", None), (1, "a/d", "Symlink", None, "b/c"), (1, "e", "Blob", "y", None)], "root int, path string, type string, id string, target string")
    trees, top = tree.build(files, "sha256")
    root = top.first()["tree_id"]
    assert trees.count() == 3
    flat = tree.flatten(roots(spark, root), tree.entries(trees))
    assert sorted((r["path"], r["type"]) for r in flat.collect()) == [("a", "Tree"), ("a/b", "Tree"), ("a/b/c", "Blob"), ("a/d", "Symlink"), ("e", "Blob")]
    bad = spark.createDataFrame([("t", "..", "Blob", "x", None)], "tree_id string, name string, type string, child_id string, target string")
    with pytest.raises(ValueError, match="plain"):
        tree.flatten(roots(spark, "t"), bad)
    lost = spark.createDataFrame([("t", "d", "Tree", "gone", None)], bad.schema)
    with pytest.raises(graph.MissingObjects, match="gone"):
        tree.flatten(roots(spark, "t"), lost)
