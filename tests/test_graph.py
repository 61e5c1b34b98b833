"""Graph operators against plain Python."""

import random

import pytest

from lodeweave.operators import graph


def table(spark, edges):
    return spark.createDataFrame([(a, b, "resolved") for a, b in edges], "src string, dst string, confidence string")


@pytest.fixture(scope="module")
def web():
    rng = random.Random(4)
    return sorted({(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(90)})


def slow_rank(nodes, edges, rounds=20, d=0.85):
    out = {v: [b for a, b in edges if a == v] for v in nodes}
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(rounds):
        lost = sum(rank[v] for v in nodes if not out[v])
        rank = {v: (1 - d) / len(nodes) + d * lost / len(nodes) + d * sum(rank[a] / len(out[a]) for a in nodes if v in out[a]) for v in nodes}
    return rank


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_pagerank(spark, web, small):
    """By rounds of jobs and in one task."""
    nodes = [f"n{i:02d}" for i in range(40)]
    got = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id string"), table(spark, web * 2), small=small).collect()}
    want = slow_rank(nodes, web)
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[n] - want[n]) < 1e-12 for n in nodes)


def test_pagerank_of_edges_to_unknown_nodes(spark):
    """Edges from and to what isn't a node count alike either way."""
    ids = spark.createDataFrame([("A",), ("B",), ("A",)], "id string")
    edges = table(spark, [("A", "B"), ("A", "X"), ("X", "B"), ("B", "A"), (None, "A")])
    a, b = ({r.id: r["rank"] for r in graph.pagerank(ids, edges, small=k).collect()} for k in (0, graph.SMALL))
    assert a.keys() == b.keys() == {"A", "B"} and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_edges_from_nodes_without_callers_are_summed_once(spark):
    """Rounds read only edges whose source has an edge in; ranks are the same, also if there are none."""
    from lodeweave.storage import Rounds

    edges = sorted({(f"o{i}", f"p{i * k % 7}") for i in range(20) for k in (1, 2, 3)})
    fixed, fed = graph.split_links(table(spark, edges).select("src", "dst"), Rounds(spark, "test"))
    assert fed.count() == 0 and abs(sum(r.weight for r in fixed.collect()) - 20) < 1e-9
    fixed, fed = graph.split_links(table(spark, [*edges, ("p1", "p2"), ("p1", "p1")]).select("src", "dst"), Rounds(spark, "test"))
    assert sorted(tuple(r) for r in fed.collect()) == [("p1", "p1", 2), ("p1", "p2", 2)]
    nodes = sorted({x for e in edges for x in e})
    for more in ([], [("p1", "p2"), ("p1", "p1"), ("p2", "o3")]):
        got = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id string"), table(spark, edges + more), small=0).collect()}
        want = slow_rank(nodes, edges + more)
        assert all(abs(got[n] - want[n]) < 1e-12 for n in nodes)


def test_pagerank_small(spark):
    ids = spark.createDataFrame([("A",), ("B",)], "id string")
    got = {r.id: r["rank"] for r in graph.pagerank(ids, table(spark, [("A", "B")])).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["B"] > got["A"]
    assert graph.pagerank(ids.limit(0), table(spark, [("A", "B")]).limit(0)).count() == 0
    assert {r["rank"] for r in graph.pagerank(ids, table(spark, [("A", "B")]).limit(0)).collect()} == {0.5}


def test_adjacency_reads_edges_once(spark, web):
    plan = graph.adjacency(table(spark, web).where("src <> 'n99'"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan


def breadth_first(edges, start, goal):
    seen, queue = {start}, [[start]]
    while queue:
        path = queue.pop(0)
        if path[-1] == goal:
            return path
        for b in sorted(b for a, b in edges if a == path[-1]):
            if b not in seen:
                seen.add(b)
                queue.append([*path, b])
    return None


def test_shortest_path(spark, web):
    edges = table(spark, web).cache()
    for goal in ("n00", "n07", "n21", "n39"):
        assert graph.shortest_path(edges, "n00", goal) == breadth_first(web, "n00", goal)
    assert graph.shortest_path(edges, "n00", "nowhere") is None
    assert [tuple(r) for r in graph.path_edges(table(spark, [("a", "b"), ("b", "c")]), ["a", "b", "c"]).orderBy("pos").collect()] == [(1, "a", "b", "resolved"), (2, "b", "c", "resolved")]


def test_trace(spark):
    edges = table(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e")])
    start = spark.createDataFrame([("a",)], "id string")
    got = sorted((r.depth, r.src, r.dst) for r in graph.trace(edges, start, 2).collect())
    assert got == [(1, "a", "b"), (1, "a", "c"), (2, "b", "a"), (2, "b", "c"), (2, "c", "d")]
    assert graph.trace(edges, start, 0).count() == 2
    assert {(r.id, r.depth) for r in graph.depths(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}


def test_adjacency_and_top(spark):
    near = {r.id: (r.out_edges, r.in_edges) for r in graph.adjacency(table(spark, [("a", "c"), ("a", "b"), ("b", "c")])).collect()}
    assert near == {"a": (["b", "c"], []), "b": (["c"], ["a"]), "c": ([], ["a", "b"])}
    ranks = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "id string, rank double")
    assert [r.id for r in graph.top_nodes(ranks, 2).collect()] == ["c", "a"]
