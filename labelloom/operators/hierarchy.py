"""Ontology and taxonomy trees held as parent links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions import text
from labelloom.operators.graph import strongly_connected
from labelloom.operators.joins import contains_join, labels_in_nodes
from labelloom.session import stored


def build_tree(values: DataFrame) -> DataFrame:
    """Nodes of all prefixes of dotted values; the empty prefix is the root."""
    parts = F.split("value", r"\.")
    depth = F.col("depth")
    upto = lambda n: F.array_join(F.slice("parts", 1, n), ".")
    prefixes = values.select(parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select(
        F.when(depth == 0, "root").otherwise(upto(depth)).alias("value"),
        F.when(depth == 1, "root").when(depth > 1, upto(F.greatest(depth - 1, F.lit(0)))).alias("parent"),
        F.when(depth == 0, "root").otherwise(F.element_at("parts", 1)).alias("category"),
        F.when(depth == 0, "root").otherwise(F.element_at("parts", F.greatest(depth, F.lit(1)))).alias("last"),
        "depth",
    ).distinct()
    parents = prefixes.where("parent IS NOT NULL").select(F.col("parent").alias("value"), F.lit(False).alias("_leaf")).distinct()
    name = F.when(
        (F.col("last") == "unknown") & (depth == 2), F.concat(F.lit("Unknown "), text.title(F.col("category")))
    ).otherwise(text.title(F.col("last")))
    return prefixes.join(parents, "value", "left").select(
        "value", name.alias("name"), "category", "parent", "depth", F.coalesce("_leaf", F.lit(True)).alias("is_leaf")
    )


def ancestors(edges: DataFrame, levels: int = config.MAX_PARENT_DEPTH) -> DataFrame:
    """(node, ancestor, distance) up to ``levels`` steps; a step back onto the path ends it.

    ``edges`` has ``node`` and ``parent``, one parent per node. Each level is one join.
    """
    chain = edges.where("parent IS NOT NULL AND parent <> node").select("node", F.col("parent").alias("p1"))
    step = edges.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    for level in range(2, levels + 1):
        path = ["node", *[f"p{i}" for i in range(1, level)]]
        seen = F.lit(False)
        for c in path:
            seen = seen | (F.col(c) == F.col("_p"))
        chain = chain.join(step, F.col(f"p{level - 1}") == F.col("_n"), "left").select(
            *path, F.when(~F.coalesce(seen, F.lit(False)), F.col("_p")).alias(f"p{level}")
        )
    found = F.array(*[F.struct(F.col(f"p{i}").alias("ancestor"), F.lit(i).alias("distance")) for i in range(1, levels + 1)])
    return chain.select("node", F.inline(found)).where("ancestor IS NOT NULL")


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) at any depth; the reach doubles until nothing is new.

    A path longer than the reach begins with one of exactly that length, so each round joins
    only the pairs at the rim, not all pairs, with what is known.
    """
    pairs = stored(
        edges.where("parent IS NOT NULL AND parent <> node").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "closure"
    )
    reach = 1
    while not pairs.where(F.col("distance") == reach).isEmpty():
        rim = pairs.where(F.col("distance") == reach).select("node", "ancestor", "distance")
        hop = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("distance").alias("_d"))
        longer = rim.join(hop, "ancestor").select("node", F.col("_up").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
        pairs = stored(pairs.unionByName(longer).where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "closure", pairs)
        reach *= 2
    return pairs


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that can be reached from themselves, at any length of the cycle."""
    return strongly_connected(edges).select("node")


def resolve(nodes: DataFrame) -> DataFrame:
    """Each node with the number of children and siblings, and its path from the root."""
    edges = nodes.select(F.col("value").alias("node"), "parent")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    path = (
        closure(edges)
        .groupBy(F.col("node").alias("value"))
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("_up"))
    )
    own = children.select(F.col("parent").alias("value"), F.col("n").alias("children"))
    beside = children.select("parent", (F.col("n") - 1).alias("siblings"))
    up = F.coalesce(F.transform("_up", lambda s: s["ancestor"]), F.array().cast("array<string>"))
    return (
        nodes.join(own, "value", "left")
        .join(beside, "parent", "left")
        .join(path, "value", "left")
        .select(
            "value", "parent",
            F.coalesce("children", F.lit(0)).alias("children"),
            F.coalesce("siblings", F.lit(0)).alias("siblings"),
            F.array_join(F.array_append(up, F.col("value")), " > ").alias("path"),
        )
    )


def leaves(nodes: DataFrame) -> DataFrame:
    inner = nodes.select(F.col("parent").alias("value")).where("value IS NOT NULL")
    return nodes.join(inner, "value", "left_anti")


def contains(values: DataFrame, nodes: DataFrame) -> DataFrame:
    return values.join(nodes.select("value"), "value", "left_semi")


def find_by_label(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    return labels_in_nodes(labels, nodes)


def children(taxonomy: DataFrame) -> DataFrame:
    kids = taxonomy.select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"))
    return taxonomy.select("node_id", "name").join(kids, "node_id")


def descendants(taxonomy: DataFrame) -> DataFrame:
    up = closure(taxonomy.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent")))
    return up.select(F.col("ancestor").alias("node_id"), F.col("node").alias("descendant_id"), "distance")


def find_by_keyword(taxonomy: DataFrame, keywords: DataFrame) -> DataFrame:
    """Nodes whose name, keyword or alias contains a search word."""
    wanted = keywords.select("keyword", F.lower(F.translate("keyword", "_-", "  ")).alias("_needle"))
    loose = F.transform("aliases", lambda a: F.translate(F.lower(a), "_-", "  "))
    texts = taxonomy.select(
        "node_id",
        F.explode(F.concat(F.array(F.lower("name")), F.transform("keywords", lambda k: F.lower(k)), loose)).alias("_hay"),
    )
    found = contains_join(wanted, "_needle", texts, "_hay")
    return wanted.join(found, "_needle").join(texts, "_hay").select("keyword", "node_id").distinct()


def class_terms(class_name: Column) -> Column:
    """The words of a class, and the class as one word."""
    lowered = F.lower(class_name)
    words = F.split(F.trim(F.translate(lowered, "_-", "  ")), r"\s+")
    return F.array_distinct(F.array_append(words, F.replace(lowered, F.lit(" "), F.lit("_"))))


def covered_nodes(classes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(dataset, node_id, domain) of the nodes that a data set's classes cover.

    A node is covered when its name, an alias or a keyword equals a class term.
    """
    terms = classes.select("dataset", F.explode(class_terms(F.col("class_name"))).alias("term")).distinct()
    loose = F.transform("aliases", lambda a: F.translate(F.lower(a), "_-", "  "))
    named = F.concat(F.array(F.lower("name")), F.transform("keywords", lambda k: F.lower(k)), loose)
    nodes = taxonomy.select("node_id", "domain", F.explode(F.array_distinct(named)).alias("term"))
    return terms.join(nodes, "term").select("dataset", "node_id", "domain").distinct()


def taxonomy_coverage(classes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Covered share of the taxonomy per data set."""
    total = taxonomy.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = covered_nodes(classes, taxonomy).groupBy("dataset").agg(F.count(F.lit(1)).alias("covered"))
    return classes.select("dataset").distinct().join(found, "dataset", "left").select(
        "dataset",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        (total - F.coalesce("covered", F.lit(0))).alias("uncovered"),
        F.lit(0).cast("long").alias("partial"),
        F.round(F.coalesce(F.coalesce("covered", F.lit(0)) / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("coverage_ratio"),
    )


def domain_coverage(classes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Covered share per data set and domain, zero rows included."""
    sizes = taxonomy.groupBy("domain").agg(F.count(F.lit(1)).alias("nodes"))
    domains = sizes.agg(F.collect_set("domain").alias("d")).scalar()
    grid = classes.select("dataset").distinct().withColumn("domain", F.explode(domains))
    found = covered_nodes(classes, taxonomy).groupBy("dataset", "domain").agg(F.count(F.lit(1)).alias("covered"))
    return grid.join(sizes, "domain").join(found, ["dataset", "domain"], "left").select(
        "dataset", "domain", "nodes",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        F.round(F.coalesce("covered", F.lit(0)) / F.col("nodes"), 6).alias("coverage_ratio"),
    )
