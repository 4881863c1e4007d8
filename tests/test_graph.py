"""Strongly connected components against plain searches."""

import random

import pytest

from labelloom.operators import graph, hierarchy


def plain(edges):
    """Components that hold a cycle, as sets."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    to = {a: reach(a) for a in out}
    return {frozenset(b for b in to[a] if a in to.get(b, ())) for a in out if a in to[a]}


def found(spark, edges):
    rows = graph.strongly_connected(spark.createDataFrame(edges, "node string, parent string")).collect()
    assert len({r.node for r in rows}) == len(rows)
    sets = {}
    for r in rows:
        sets.setdefault(r.component, set()).add(r.node)
    assert all(name in members for name, members in sets.items())
    return {frozenset(s) for s in sets.values()}


def random_graph(seed):
    pick = random.Random(seed)
    n = pick.choice([5, 12, 40])
    return [(f"n{pick.randrange(n)}", f"n{pick.randrange(n)}") for _ in range(int(n * pick.choice([0.8, 1.1, 1.5, 2.5])))]


@pytest.mark.parametrize("seeds", [range(0, 4), range(4, 8), range(8, 12)])
def test_random_graphs(spark, seeds):
    """Several graphs as one with parts of their own."""
    edges = [(f"{s}-{a}", f"{s}-{b}") for s in seeds for a, b in random_graph(s)]
    assert found(spark, edges) == plain(edges)


def test_shapes(spark):
    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    eight = [("e", "e1"), ("e1", "e"), ("e", "e2"), ("e2", "e3"), ("e3", "e")]
    tail = [("t0", "t1"), ("t1", "r0"), ("r2", "u0"), ("u0", "u1"), ("e3", "r1")]
    own = [("s", "s"), ("s", "s2"), ("d", "d2"), ("d", "d3"), ("d2", "d4"), ("d3", "d4")]
    chord = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("c2", "c6"), ("c7", "c1")]
    edges = ring + eight + tail + own + chord + ring
    assert found(spark, edges) == plain(edges)
    rows = hierarchy.cycles(spark.createDataFrame(edges + [("x", None), (None, "y")], "node string, parent string")).collect()
    assert {r.node for r in rows} == {n for s in plain(edges) for n in s}
    assert found(spark, []) == set() == found(spark, [("a", "b")])


def test_long_cycle_with_tails(spark):
    """A cycle of 100,000 nodes, a way in and a way out of 50,000 each: rounds grow with the
    logarithm of the length, rows with the edges."""
    n, t = 100_000, 50_000
    at = spark.range(n).selectExpr("concat('n', id) AS node", f"concat('n', (id + 1) % {n}) AS parent")
    into = spark.range(t).selectExpr("concat('i', id) AS node", f"CASE WHEN id = {t - 1} THEN 'n7' ELSE concat('i', id + 1) END AS parent")
    away = spark.range(t).selectExpr("CASE WHEN id = 0 THEN 'n9' ELSE concat('o', id - 1) END AS node", "concat('o', id) AS parent")
    rows = graph.strongly_connected(at.union(into).union(away))
    assert rows.count() == n and rows.select("component").distinct().count() == 1
    assert rows.where("node LIKE 'i%' OR node LIKE 'o%'").isEmpty()
