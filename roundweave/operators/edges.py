"""Graphs whose edges are rows, for those that don't fit an array (``graph`` has the same for arrays).

``edges`` has ``graph, src, dst``; a graph is a conversation's, or any other key. Everything goes by joins and sums on (graph, node), in rounds with a
stop test, so one graph may have any share of the rows. Sets of neighbours are compared by their number and two sums of hashes, and are never gathered, so a node
may have any number of them: two different sets are taken for equal with a chance of 2^-100 and less.

Edges may come more than once, in any order; those with a null end or graph take no part. Graphs must not have cycles (``graph.without_cycles`` comes before
that): pruning would take away what only a cycle holds, and relaxed merging would go on for as many rounds as there are nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.shared import cut


def clean(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends."""
    return edges.select("graph", "src", "dst").dropna().distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """``graph, node``: all ends of edges."""
    return edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()


def reaching(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """``graph, node``: the goals and all nodes that a way leads from to one. A round for each step of the longest such way.

    Only the nodes that are new in a round are joined in the next one, so every edge is followed once.
    """
    found = front = cut(goals.select("graph", "node").distinct())
    while not front.isEmpty():
        before = edges.join(front.select("graph", F.col("node").alias("dst")), ["graph", "dst"]).select("graph", F.col("src").alias("node")).distinct()
        front = cut(before.join(found, ["graph", "node"], "left_anti"))
        found = cut(found.unionByName(front))
    return found


def pruned(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without successors, but for the one with the largest number, are taken away again and again."""
    edges = cut(clean(edges))
    top = edges.groupBy("graph").agg(F.max(F.greatest("src", "dst")).alias("node"))
    return edges.join(reaching(edges, top).select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_semi").select("graph", "src", "dst")


def _set_of(value: Column) -> Column:
    """What a set is known by: its size and two sums of hashes. The values have to be distinct."""
    sums = [F.sum(F.xxhash64(F.lit(seed), value).cast("decimal(20,0)")) for seed in (1, 2)]
    return F.struct(F.count(value).alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums)))


def _classes(keyed: DataFrame, *key: str) -> DataFrame:
    """``graph, node, first``: nodes with equal keys are of a class, which is called by its least node."""
    first = keyed.groupBy("graph", *key).agg(F.min("node").alias("first"))
    first = first.select("first", *(F.col(c).alias(f"__{c}") for c in ("graph", *key)))
    same = F.expr(" AND ".join(f"{c} <=> __{c}" for c in ("graph", *key)))
    return keyed.join(first, same).select("graph", "node", "first")


def strict_classes(edges: DataFrame) -> DataFrame:
    """``graph, node, first``: classes of nodes with equal parents and equal children."""
    edges = clean(edges)
    parents = edges.groupBy("graph", F.col("dst").alias("node")).agg(_set_of(F.col("src")).alias("parents"))
    children = edges.groupBy("graph", F.col("src").alias("node")).agg(_set_of(F.col("dst")).alias("children"))
    return _classes(cut(parents.join(children, ["graph", "node"], "full")), "parents", "children")


def relaxed_classes(edges: DataFrame) -> DataFrame:
    """``graph, node, first``: classes of nodes whose parents are of the same classes, as when nodes with equal parents are merged until there are none.

    All nodes start in one class, and a round splits classes by those of their parents, until a round splits none: a round for each step of
    the longest way.
    """
    edges = cut(clean(edges))
    every = nodes(edges)
    now, classes = cut(every.withColumn("first", F.lit(None).cast(every.schema["node"].dataType))), 0
    while True:
        of_parents = edges.join(now.select("graph", F.col("node").alias("src"), "first"), ["graph", "src"]).select("graph", F.col("dst").alias("node"), "first").distinct()
        # in the first round there is one class, without a name yet
        keys = of_parents.groupBy("graph", "node").agg(_set_of(F.coalesce(F.col("first").cast("string"), F.lit("-"))).alias("key"))
        now = cut(_classes(every.join(keys, ["graph", "node"], "left"), "key"))
        count = now.filter(F.col("node") == F.col("first")).count()
        if count == classes:
            return now
        classes = count


def merged(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct edges between classes, without those within one."""
    of = lambda end: classes.select("graph", F.col("node").alias(end), F.col("first").alias(f"{end}_first"))
    both = clean(edges).join(of("src"), ["graph", "src"]).join(of("dst"), ["graph", "dst"])
    return both.filter("src_first <> dst_first").select("graph", F.col("src_first").alias("src"), F.col("dst_first").alias("dst")).distinct()
