"""Dependency graphs of rounds, as arrays of edges (src, dst) in a row.

All of it is row-wise: a graph has at most some hundred edges, so that a
conversation's edges stay together and nothing is shuffled. Only the removal of
cycles, a depth-first search in the order of labels, is a small Python function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from roundweave.functions import text as T

EDGES = ArrayType(StructType().add("src", "string").add("dst", "string"))


def forward_edges(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Edges without those that close a cycle, in the order in which they are walked.

    Roots and neighbours are taken in the order of their labels as strings. An edge
    to a node that is still being walked closes a cycle.
    """
    out_of: dict[str, list[str]] = {}
    for a, b in edges:
        out_of.setdefault(a, []).append(b)
    kept, done, open_ = [], set(), set()
    for root in sorted({x for e in edges for x in e}):
        if root in done:
            continue
        done.add(root)
        open_.add(root)
        walk = [(root, iter(sorted(out_of.get(root, ()))))]
        while walk:
            node, rest = walk[-1]
            for to in rest:
                if to in open_:
                    continue
                kept.append((node, to))
                if to not in done:
                    done.add(to)
                    open_.add(to)
                    walk.append((to, iter(sorted(out_of.get(to, ())))))
                    break
            else:
                open_.discard(node)
                walk.pop()
    return kept


@F.pandas_udf(EDGES)
def acyclic(edges: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Edges (labels) without those that close a cycle; null stays null."""
    for batch in edges:
        yield batch.map(lambda row: None if row is None else [{"src": a, "dst": b} for a, b in forward_edges([(e["src"], e["dst"]) for e in row])])


def without_cycles(rows: DataFrame, edges: Column, name: str = "walked") -> DataFrame:
    """``rows`` with a column of the edges (labels) that don't close a cycle.

    The same as ``acyclic``, as a step of its own: what is built on its result can't be put into one expression with it.
    """
    out = rows.schema.add(name, EDGES)
    kind = pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if row is None else [{"src": a, "dst": b} for a, b in forward_edges([(e["src"], e["dst"]) for e in row])] for row in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, kind)], names=out.names)

    return rows.select("*", edges.alias("__edges")).mapInArrow(run, out)


def nodes_of(edges: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.transform(edges, lambda e: e["src"]), F.transform(edges, lambda e: e["dst"]))))


def prune_leaves(edges: Column) -> Column:
    """Edges (int) that are left when nodes without successors are taken away again and again.

    In every pass the node with the largest number stays. There are as many passes as the longest way to a
    leaf has edges; once a pass takes nothing away, those after it do nothing.
    """

    def one_pass(now: Column) -> Column:
        known = F.struct(F.array_distinct(F.transform(now, lambda e: e["src"])).alias("sources"), F.array_max(nodes_of(now)).alias("top"))
        return T.let(known, lambda k: F.filter(now, lambda e: F.array_contains(k["sources"], e["dst"]) | (e["dst"] == k["top"])))

    def step(state: Column, _: Column) -> Column:
        again = T.let(one_pass(state["now"]), lambda left: F.struct(left.alias("now"), (F.size(left) == F.size(state["now"])).alias("done")))
        return F.when(state["done"], state).otherwise(again)

    return F.aggregate(edges, F.struct(edges.alias("now"), F.lit(False).alias("done")), step, lambda state: state["now"])


def prune_labels(edges: Column) -> Column:
    """The same for ids that are texts: the largest is that by number while all ids that are left are whole numbers, else that by text.

    A number is compared in its plain form, so an id like ``007`` is never the largest.
    """

    def top(ids: Column) -> Column:
        numbers = F.transform(ids, lambda i: F.trim(i).cast("decimal(38,0)"))
        return F.when(F.forall(ids, lambda i: F.regexp_like(i, F.lit(r"^\s*[+-]?[0-9]{1,37}\s*$"))), F.array_max(numbers).cast("string")).otherwise(F.array_max(ids))

    def one_pass(now: Column) -> Column:
        known = F.struct(F.array_distinct(F.transform(now, lambda e: e["src"])).alias("sources"), T.let(nodes_of(now), top).alias("top"))
        return T.let(known, lambda k: F.filter(now, lambda e: F.array_contains(k["sources"], e["dst"]) | (e["dst"] == k["top"])))

    def step(state: Column, _: Column) -> Column:
        again = T.let(one_pass(state["now"]), lambda left: F.struct(left.alias("now"), (F.size(left) == F.size(state["now"])).alias("done")))
        return F.when(state["done"], state).otherwise(again)

    return F.aggregate(edges, F.struct(edges.alias("now"), F.lit(False).alias("done")), step, lambda state: state["now"])


def parents_of(edges: Column, node: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(edges, lambda e: e["dst"] == node), lambda e: e["src"])))


def children_of(edges: Column, node: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(edges, lambda e: e["src"] == node), lambda e: e["dst"])))


def strict_groups(edges: Column) -> Column:
    """Groups of nodes with equal parents and equal children: array of (node, members)."""
    known = F.transform(nodes_of(edges), lambda n: F.struct(n.alias("node"), parents_of(edges, n).alias("p"), children_of(edges, n).alias("c")))
    alike = lambda k, x: F.transform(F.filter(k, lambda y: (y["p"] == x["p"]) & (y["c"] == x["c"])), lambda y: y["node"])
    return T.let(known, lambda k: F.transform(k, lambda x: F.struct(x["node"].alias("node"), alike(k, x).alias("members"))))


def relaxed_groups(edges: Column) -> Column:
    """Groups of nodes with equal parents, merged until there are none: array of (node, members).

    Nodes are of one class if the sets of their parents' classes are the same. All start in one class, which is
    split until nothing changes: after as many passes as the longest way has edges. Edges may
    ascend or not, but must not form a cycle; the partition doesn't depend on the order of merging.
    """
    none = F.transform(nodes_of(edges), lambda n: F.struct(n.alias("node"), F.lit(0).alias("rep"), parents_of(edges, n).alias("parents")))

    def one_pass(now: Column) -> Column:
        def key(x: Column) -> Column:
            return F.array_sort(F.array_distinct(F.transform(F.filter(now, lambda s: F.array_contains(x["parents"], s["node"])), lambda s: s["rep"])))

        keyed = F.transform(now, lambda x: F.struct(x["node"].alias("node"), key(x).alias("key"), x["parents"].alias("parents")))
        first = lambda k, x: F.get(F.filter(k, lambda y: y["key"] == x["key"]), F.lit(0))["node"]
        return T.let(keyed, lambda k: F.transform(k, lambda x: F.struct(x["node"].alias("node"), first(k, x).alias("rep"), x["parents"].alias("parents"))))

    def step(state: Column, _: Column) -> Column:
        again = T.let(one_pass(state["now"]), lambda new: F.struct(new.alias("now"), (new == state["now"]).alias("done")))
        return F.when(state["done"], state).otherwise(again)

    classes = F.aggregate(none, F.struct(none.alias("now"), F.lit(False).alias("done")), step, lambda state: state["now"])
    return T.let(classes, _by_class)


def _by_class(classes: Column) -> Column:
    return F.transform(classes, lambda x: F.struct(x["node"].alias("node"), F.transform(F.filter(classes, lambda y: y["rep"] == x["rep"]), lambda y: y["node"]).alias("members")))


def limited_groups(groups: Column, size: int | None = None, adjacent: bool = False) -> Column:
    """Groups of more than ``size`` members taken apart again, and with ``adjacent`` those
    whose numbers leave a gap. A limit on relaxed merging."""

    def stays(m: Column) -> Column:
        short = F.size(m) <= size if size else F.lit(True)
        return short & (F.array_max(m) - F.array_min(m) + 1 == F.size(m)) if adjacent else short

    return F.transform(groups, lambda g: F.struct(g["node"].alias("node"), F.when(stays(g["members"]), g["members"]).otherwise(F.array(g["node"])).alias("members")))


def label(members: Column, as_text: bool) -> Column:
    """Members joined by ``+``: in the order of their texts, or of their numbers."""
    names = F.transform(members, lambda m: m.cast("string"))
    return F.array_join(F.array_sort(names) if as_text else names, "+")


def merged_edges(edges: Column, groups: Column, as_text: bool = True) -> Column:
    """Edges between merged nodes, distinct and sorted, without those within one."""
    name = lambda n: F.get(F.filter(groups, lambda g: g["node"] == n), F.lit(0))["members"]
    named = F.transform(edges, lambda e: F.struct(label(name(e["src"]), as_text).alias("src"), label(name(e["dst"]), as_text).alias("dst")))
    return F.array_sort(F.array_distinct(F.filter(named, lambda e: e["src"] != e["dst"])))


def merge_lists(groups: Column) -> Column:
    """Member lists of the groups of two and more, each once; groups with round 1 are passed over."""
    return F.array_distinct(F.transform(F.filter(groups, lambda g: (F.size(g["members"]) > 1) & ~F.array_contains(g["members"], 1)), lambda g: g["members"]))


def joined_reasons(reasons: Column, sources: Column, targets: Column) -> Column:
    """Reasons between members of two merged nodes, first seen first, joined.

    ``reasons`` is an array of (src, dst, reason); of several for a pair the last counts.
    """
    last = lambda a, b: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(reasons, lambda r: (r["src"] == a) & (r["dst"] == b)), lambda r: F.coalesce(r["reason"], F.lit("")))), -1)
    every = F.flatten(F.transform(sources, lambda a: F.transform(targets, lambda b: last(a, b))))
    return F.array_join(F.array_distinct(F.filter(every, lambda r: r != "")), ";\n")
