"""Strongly connected components of large directed graphs.

Rows stay linear in the edges: no pairs of reachable nodes are made. Nodes without a way in
or out are trimmed. Paths through nodes of one way in and one way out are followed by
doubling and become single edges, so long chains and long cycles take a number of rounds
that grows with the logarithm of their length. What is left is coloured forward with the
largest node that reaches each node; nodes that reach their colour's node backward within
the colour are a component.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import stored


def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose beginning has a way in and whose end has a way out."""
    entered = edges.select(F.col("b").alias("a")).distinct()
    left = edges.select(F.col("a").alias("b")).distinct()
    return edges.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b")


def _paths(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Contract paths: (edges, nodes with head and tail of their path, nodes of rings).

    A ring is a cycle on which every node has one way in and one way out.
    """
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_o"), F.min("b").alias("after"))
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("_i"), F.min("a").alias("before"))
    inner = stored(out.where("_o = 1").join(into.where("_i = 1"), "node").select("node", "before", "after"), "path-nodes")
    size = inner.count()
    if not size:
        return None
    # end: the node 2**k steps on, or the first one that is no inner node; last: the inner
    # node before it; low: the least node met.
    reach = inner.select("node", F.col("after").alias("end"), F.col("node").alias("last"), F.col("node").alias("low"))
    for _ in range(math.ceil(math.log2(size)) + 1):
        hop = reach.select(F.col("node").alias("_n"), F.col("end").alias("_e"), F.col("last").alias("_l"), F.col("low").alias("_w"))
        moved = reach.join(hop, F.col("end") == F.col("_n"), "left")
        reach = stored(
            moved.select("node", F.coalesce("_e", "end").alias("end"), F.coalesce("_l", "last").alias("last"), F.least("low", "_w").alias("low")), "path-reach", reach
        )
    names = inner.select(F.col("node").alias("end"))
    rings = stored(reach.join(names, "end", "left_semi").select("node", F.col("low").alias("component")), "rings")
    ended = reach.join(names, "end", "left_anti")
    first = inner.join(inner.select(F.col("node").alias("before")), "before", "left_anti").select("node", F.col("before").alias("head"))
    heads = ended.join(first, "node").select("last", "head")
    placed = stored(ended.join(heads, "last").select("node", "head", F.col("end").alias("tail")), "paths")
    plain = edges.join(inner.select(F.col("node").alias("a")), "a", "left_anti").join(inner.select(F.col("node").alias("b")), "b", "left_anti")
    contracted = plain.select("a", "b").union(placed.select(F.col("head").alias("a"), F.col("tail").alias("b"))).distinct()
    return stored(contracted, "contracted", edges), placed, rings


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components found, edges that are left)."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    colour = stored(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while True:
        # Only colours that changed are sent on; the largest of each target is found before it is shuffled.
        sent = colour.where("new").join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("_n")).agg(F.max("colour").alias("_c"))
        joined = colour.join(sent, F.col("node") == F.col("_n"), "left")
        larger = F.coalesce(F.col("_c") > F.col("colour"), F.lit(False))
        colour = stored(joined.select("node", F.when(larger, F.col("_c")).otherwise(F.col("colour")).alias("colour"), larger.alias("new")), "colours", colour)
        if colour.where("new").isEmpty():
            break
    of = lambda side: colour.select(F.col("node").alias(side), F.col("colour").alias(f"c_{side}"))
    inside = stored(edges.join(of("a"), "a").join(of("b"), "b").where("c_a = c_b").select("a", "b", F.col("c_a").alias("colour")), "coloured-edges")
    back = stored(colour.where("node = colour").select("node", F.lit(True).alias("new")), "reached")
    while True:
        step = back.where("new").join(inside, F.col("node") == F.col("b")).select(F.col("a").alias("node")).distinct()
        fresh = step.join(back.select("node"), "node", "left_anti").withColumn("new", F.lit(True))
        back = stored(back.select("node", F.lit(False).alias("new")).union(fresh), "reached", back)
        if back.where("new").isEmpty():
            break
    members = back.join(colour, "node").select("node", F.col("colour").alias("component"))
    several = members.groupBy("component").count().where("count > 1").select("component")
    found = stored(members.join(several, "component", "left_semi").select("node", "component"), "components")
    done = back.select("node")
    rest = inside.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    return found, stored(rest, "rest-edges", edges)


def strongly_connected(edges: DataFrame, source: str = "node", target: str = "parent") -> DataFrame:
    """``node, component`` of every node that lies on a cycle; a component is named by one of
    its nodes. Null ends are no edges, repeated edges count once."""
    given = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    edges = stored(given, "edges")
    own = stored(edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")), "own-loops")
    edges = stored(edges.where("a <> b"), "edges")
    known = own.limit(0)
    paths: list[DataFrame] = []
    before = -1
    while (count := edges.count()) > 0:
        if count == before:
            found, edges = _coloured(edges)
            known = known.union(found)
        before = edges.count()
        edges = stored(_trim(edges), "trimmed", edges)
        contracted = _paths(edges)
        if contracted is not None:
            edges, placed, rings = contracted
            known = known.union(rings)
            paths.append(placed)
            edges = stored(edges.where("a <> b"), "edges", edges)
            before = -1
    known = stored(known, "known")
    new = lambda rows: rows.join(known.select("node"), "node", "left_anti").select("node", "component")
    for placed in reversed(paths):
        # A path lies on a cycle if its ends lie on one together, or are one node.
        ends = placed.where("head = tail").select(F.col("head").alias("node"), F.col("head").alias("component")).distinct()
        known = stored(known.union(new(ends)), "known", known)
        head = known.select(F.col("node").alias("head"), F.col("component").alias("_h"))
        tail = known.select(F.col("node").alias("tail"), F.col("component").alias("_t"))
        on = placed.join(head, "head").join(tail, "tail").where("_h = _t").select("node", F.col("_h").alias("component"))
        known = stored(known.union(on), "known", known)
    known = stored(known.union(new(own)), "known", known)
    return known
