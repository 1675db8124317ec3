"""Graphs as rows against plain versions, also where they are large and have hot nodes."""

import random

from pyspark.sql import functions as F

from roundweave.operators import edges, graph


def prune(pairs, top_of=max):
    pairs = set(pairs)
    while pairs:
        top = top_of({n for e in pairs for n in e})
        leaves = {d for _, d in pairs} - {s for s, _ in pairs} - {top}
        if not leaves:
            break
        pairs = {e for e in pairs if e[1] not in leaves}
    return pairs


def neighbours(pairs):
    parents, children = {}, {}
    for s, d in pairs:
        for n in (s, d):
            parents.setdefault(n, set())
            children.setdefault(n, set())
        parents[d].add(s)
        children[s].add(d)
    return parents, children


def strict(pairs):
    parents, children = neighbours(pairs)
    first = {}
    for n in sorted(parents):
        first.setdefault((frozenset(parents[n]), frozenset(children[n])), n)
    return {n: first[frozenset(parents[n]), frozenset(children[n])] for n in parents}


def relaxed(pairs):
    """Merge nodes with equal parents, again and again."""
    of = {n: n for e in pairs for n in e}
    while True:
        parents, _ = neighbours({(of[s], of[d]) for s, d in pairs})
        first = {}
        for n in sorted(parents):
            first.setdefault(frozenset(parents[n]), n)
        new = {n: first[frozenset(parents[of[n]])] for n in of}
        if new == of:
            return of
        of = new


def table(spark, graphs):
    return spark.createDataFrame([(g, s, d) for g, pairs in graphs.items() for s, d in pairs], "graph long, src long, dst long")


def random_graphs(seed):
    rng = random.Random(seed)
    found = {}
    for g in range(25):
        n = rng.randint(2, 14)
        found[g] = {(i, j) for i in range(1, n) for j in range(i + 1, n + 1) if rng.random() < rng.choice([0.1, 0.3, 0.6])} or {(1, 2)}
    return found


def test_small_graphs(spark):
    graphs = random_graphs(1)
    rows = table(spark, graphs)
    rows = rows.unionByName(rows.limit(20)).unionByName(spark.createDataFrame([(0, None, 3), (None, 1, 2), (1, 4, None)], rows.schema)).repartition(3)
    got = {g: set() for g in graphs}
    for r in edges.pruned(rows).collect():
        got[r["graph"]].add((r["src"], r["dst"]))
    assert got == {g: prune(p) for g, p in graphs.items()}
    for classes, plain in ((edges.strict_classes(rows), strict), (edges.relaxed_classes(rows), relaxed)):
        of = {(r["graph"], r["node"]): r["first"] for r in classes.collect()}
        want = {g: plain(p) for g, p in graphs.items()}
        assert of == {(g, n): f for g, w in want.items() for n, f in w.items()}
        merged = {(r["graph"], r["src"], r["dst"]) for r in edges.merged(rows, classes).collect()}
        assert merged == {(g, want[g][s], want[g][d]) for g, p in graphs.items() for s, d in p if want[g][s] != want[g][d]}
    none = rows.limit(0)
    assert edges.pruned(none).count() == edges.strict_classes(none).count() == edges.relaxed_classes(none).count() == 0


def test_arrays_and_rows_agree(spark):
    graphs = random_graphs(2)
    arrays = spark.createDataFrame([(g, sorted(p)) for g, p in graphs.items()], "graph long, edges array<struct<src:int,dst:int>>")
    for of_arrays, of_rows in ((graph.strict_groups, edges.strict_classes), (graph.relaxed_groups, edges.relaxed_classes)):
        one = {(r["graph"], r["node"]): min(r["members"]) for r in arrays.select("graph", F.inline(of_arrays(F.col("edges")))).collect()}
        two = {(r["graph"], r["node"]): r["first"] for r in of_rows(table(spark, graphs)).collect()}
        assert one == two


def test_a_graph_of_a_hundred_thousand_edges(spark):
    """Eight layers; one node has a third of all edges, and thousands of nodes have equal neighbours."""
    rng = random.Random(3)
    layers = [list(range(k * 4000, (k + 1) * 4000)) for k in range(8)]
    pairs = {(0, n) for n in layers[1] + layers[2] + layers[3]} | {(layers[3][0], n) for n in layers[4]}
    pairs |= {(n, 4 * 8000) for n in layers[4]}  # 4000 nodes between the same two
    for a, b in zip(layers, layers[1:]):
        pairs |= {(rng.choice(a), rng.choice(b)) for _ in range(12_000)}
    assert len(pairs) > 95_000
    rows = table(spark, {7: pairs})
    assert {(r["src"], r["dst"]) for r in edges.pruned(rows).collect()} == prune(pairs)
    assert {r["node"]: r["first"] for r in edges.strict_classes(rows).collect()} == strict(pairs)
    assert {r["node"]: r["first"] for r in edges.relaxed_classes(rows).collect()} == relaxed(pairs)


def test_ids_that_are_no_numbers(spark):
    def top(ids):
        return str(max(map(int, ids))) if all(i.strip().lstrip("+-").isdigit() for i in ids) else max(ids)

    rng = random.Random(5)
    graphs = []
    for _ in range(60):
        names = rng.sample(["1", "2", "3", "9", "10", "11", "100", "a", "b10", "é", "007", "12 ", "-4"], 6)
        graphs.append(sorted({(names[i], names[j]) for i in range(5) for j in range(i + 1, 6) if rng.random() < 0.5}))
    graphs += [[("9", "10"), ("9", "8")], [("1", "9"), ("1", "10"), ("1", "x")], [], [("1", "007")]]
    rows = spark.createDataFrame(list(enumerate(graphs)), "i int, edges array<struct<src:string,dst:string>>")
    got = {r["i"]: {(e["src"], e["dst"]) for e in r["left"]} for r in rows.select("i", graph.prune_labels(F.col("edges")).alias("left")).collect()}
    assert got == {i: prune(g, top) for i, g in enumerate(graphs)}
