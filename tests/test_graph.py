"""Graph operators: cases worked by hand, and random graphs against plain Python."""

import random

from pyspark.sql import functions as F

from roundweave.operators import graph


def frame(spark, graphs):
    return spark.createDataFrame([(i, [{"src": a, "dst": b} for a, b in g]) for i, g in enumerate(graphs)], "i int, edges array<struct<src:int,dst:int>>").orderBy("i")


def run(spark, graphs, column):
    return [r[0] for r in frame(spark, graphs).select("i", column.alias("x")).orderBy("i").select("x").collect()]


def pairs(rows):
    return [(r["src"], r["dst"]) for r in rows]


def plain_prune(edges):
    while edges:
        top = max(n for e in edges for n in e)
        sources = {a for a, _ in edges}
        left = [(a, b) for a, b in edges if b in sources or b == top]
        if left == edges:
            break
        edges = left
    return edges


def plain_relaxed(edges, rng):
    """Merging of any two nodes with equal parents, in random order."""
    parts = [{n} for n in {x for e in edges for x in e}]
    while True:
        parents = lambda p: frozenset(i for i, q in enumerate(parts) if any((a in q) and (b in p) for a, b in edges))
        known = [parents(p) for p in parts]
        same = [(i, j) for i in range(len(parts)) for j in range(i) if known[i] == known[j]]
        if not same:
            return sorted(map(sorted, parts))
        i, j = rng.choice(same)
        parts[j] |= parts.pop(i)


def ascending(rng):
    n = rng.randint(2, 8)
    return [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1) if rng.random() < 0.4]


def test_prune_by_hand(spark):
    cases = [[(1, 2), (1, 3), (3, 4)], [(1, 2), (2, 3), (1, 4), (3, 5), (4, 5)], [], [(3, 1), (3, 2)]]
    got = run(spark, cases, graph.prune_leaves(F.col("edges")))
    assert list(map(pairs, got)) == [[(1, 3), (3, 4)], cases[1], [], []]


def test_prune_random(spark):
    rng = random.Random(1)
    graphs = [ascending(rng) for _ in range(60)] + [[(rng.randint(1, 6), rng.randint(1, 6)) for _ in range(6)] for _ in range(60)]
    once = run(spark, graphs, graph.prune_leaves(F.col("edges")))
    assert list(map(pairs, once)) == [plain_prune(g) for g in graphs]
    twice = run(spark, graphs, graph.prune_leaves(graph.prune_leaves(F.col("edges"))))
    assert once == twice


def test_strict_by_hand(spark):
    groups = graph.strict_groups(F.col("edges"))
    got = run(spark, [[(1, 2), (1, 3), (2, 4), (3, 4)], [(1, 2), (2, 3), (1, 4), (3, 5), (4, 5)], [(1, 9), (1, 10), (9, 11), (10, 11)]], graph.merged_edges(F.col("edges"), groups))
    assert pairs(got[0]) == [("1", "2+3"), ("2+3", "4")]
    assert len(got[1]) == 5
    assert pairs(got[2]) == [("1", "10+9"), ("10+9", "11")]  # members in the order of their texts


def test_relaxed(spark):
    groups = graph.relaxed_groups(F.col("edges"))
    got = run(spark, [[(1, 2), (2, 3), (1, 4), (3, 5), (4, 5)]], graph.merged_edges(F.col("edges"), groups, as_text=False))
    assert pairs(got[0]) == [("1", "2+4"), ("2+4", "3"), ("2+4", "5"), ("3", "5")]
    rng = random.Random(2)
    graphs = [g for g in (ascending(rng) for _ in range(80)) if g]
    parts = run(spark, graphs, F.array_distinct(F.transform(groups, lambda g: g["members"])))
    assert [sorted(map(sorted, p)) for p in parts] == [plain_relaxed(g, rng) for g in graphs]


def test_cycles():
    assert graph.forward_edges([("1", "2"), ("2", "3"), ("3", "1")]) == [("1", "2"), ("2", "3")]
    assert graph.forward_edges([("1", "1"), ("1", "2"), ("1", "2")]) == [("1", "2"), ("1", "2")]
    assert graph.forward_edges([("2", "10"), ("10", "2")]) == [("10", "2")]  # "10" comes before "2"
    assert graph.forward_edges([]) == []


def test_cycles_keep_ascending(spark):
    rng = random.Random(3)
    graphs = [[(str(a), str(b)) for a, b in ascending(rng)] for _ in range(40)]
    for g in graphs:
        assert sorted(graph.forward_edges(g)) == sorted(g)
    rows = spark.createDataFrame([([{"src": "a", "dst": "b"}],), (None,), ([],)], "edges array<struct<src:string,dst:string>>")
    assert [r[0] and pairs(r[0]) for r in rows.select(graph.acyclic("edges")).collect()] == [[("a", "b")], None, []]


def test_reasons(spark):
    rows = spark.createDataFrame([([(1, 3, "old"), (1, 3, "a"), (2, 3, "b"), (2, 4, "a"), (1, 4, None)], [1, 2], [3, 4])], "r array<struct<src:int,dst:int,reason:string>>, s array<int>, t array<int>")
    assert rows.select(graph.joined_reasons(F.col("r"), F.col("s"), F.col("t"))).first()[0] == "a;\nb"


def test_limited_groups(spark):
    rows = spark.createDataFrame([([(n, m) for m in ([2, 3], [4, 6], [7, 8, 9]) for n in m],)], "g array<struct<node:int,members:array<int>>>")
    limited = lambda *a, **b: [g["members"] for g in rows.select(graph.limited_groups(F.col("g"), *a, **b)).first()[0]]
    assert limited(2) == [[2, 3], [2, 3], [4, 6], [4, 6], [7], [8], [9]]
    assert limited(adjacent=True) == [[2, 3], [2, 3], [4], [6], [7, 8, 9], [7, 8, 9], [7, 8, 9]]


def test_strict_groups_compare_parents_once(spark):
    """Parents and children of all nodes are gathered once, not again for each node: the plan has them once."""
    edges = spark.createDataFrame([([(1, 2), (1, 3), (2, 4), (3, 4)],)], "e array<struct<src:int,dst:int>>")
    rows = edges.select(graph.strict_groups(F.col("e")).alias("g"))
    assert [(x["node"], x["members"]) for x in rows.collect()[0]["g"]] == [(1, [1]), (2, [2, 3]), (3, [2, 3]), (4, [4])]
    assert rows._jdf.queryExecution().analyzed().toString().count("array_distinct(") == 3
