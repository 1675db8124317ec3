"""Merkle manifest of a dataset (operator 13).

Every row is a leaf: SHA-256 of its fields, each with its length in front. Per source the leaves
ascend by id, and every three consecutive nodes become one until one is left; the
subroots, ordered by source, become the root in the same way.

Rows are range-partitioned by source and id; counts of these parts say at which place of
which source a part begins. What a part or any union of parts knows of the trees is a sparse forest: nodes
keyed by source, level and index whose siblings are not all there yet. Forests form a commutative monoid: the union of two,
in which every run of siblings that is complete becomes its parent (how many nodes a level has is known
from the count, so the last run of a level is known to be short). A part of consecutive leaves leaves at most four nodes
per level, and so does every union of neighbours; sources that are complete leave at once with their subroots. The forests are
reduced as a tree, ``FAN`` of them at a time, in rounds that are tables in the shared folder.

The nodes that these rounds consume are all that a proof needs from outside of its part: a part asks for the siblings of
its first and last ancestors on each level (a join on keys), builds its own nodes again and has the proofs of all its leaves.
No text leaves the first projection; nothing but two numbers comes to the driver.

Edge cases: each null field is ``-``; null sources are a source of their own, which comes first; null ids come first in their source;
rows with one id are ordered by their leaves, so equal rows are interchangeable and the result doesn't depend on how the table is split. A
row with a null id is not tampered with. One row alone is its own subroot and root, and its proof is empty (H of nothing). An empty table gives an
empty table. Other columns and their names don't matter, as only the five fields are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundweave.llm.common import saved

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a part, about; parts that are merged at a time.
PART_ROWS = 16_384
FAN = 32
OPEN, CONSUMED, SUBROOT = 0, 1, 2
POWERS = [ARITY**i for i in range(40) if ARITY**i < 2**63]
#: Nodes of a forest; ``total`` is the number of leaves of their tree.
NODES = "part int, g string, level int, index long, hash string, total long, kind int"
#: A way up: the place in each run and the run.
WAY = "array<struct<at:int,run:array<string>>>"


def joined_hash(hashes: Iterable[str]) -> str:
    return sha256("".join(hashes).encode()).hexdigest()


def leaf_hash(fields: Iterable[Column]) -> Column:
    """H of fields, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def sizes(total: int) -> list[int]:
    """Nodes on each level, from the leaves to the root."""
    found = [total]
    while found[-1] > 1:
        found.append(-(-found[-1] // ARITY))
    return found


class Forest:
    """Nodes of one tree that are known, by level and index."""

    def __init__(self, total: int):
        self.sizes = sizes(total)
        self.nodes: list[dict[int, str]] = [{} for _ in self.sizes]

    def run(self, level: int, index: int) -> range:
        """The siblings of a node, itself included."""
        first = index - index % ARITY
        return range(first, min(first + ARITY, self.sizes[level]))

    def resolve(self) -> list[tuple[int, int]]:
        """Adds the parents of all complete runs; the nodes that these consume."""
        consumed = []
        for level in range(len(self.sizes) - 1):
            known = self.nodes[level]
            for first in [i for i in known if i % ARITY == 0]:
                run, parent = self.run(level, first), first // ARITY
                if parent not in self.nodes[level + 1] and all(i in known for i in run):
                    self.nodes[level + 1][parent] = joined_hash(known[i] for i in run)
                    consumed += [(level, i) for i in run]
        return consumed

    def left(self, consumed: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, int]]:
        """Level, index, hash and kind of the nodes that are not consumed."""
        gone, top = set(consumed), len(self.sizes) - 1
        for level, known in enumerate(self.nodes):
            for i, h in known.items():
                if (level, i) not in gone:
                    yield level, i, h, SUBROOT if level == top else OPEN

    def ways(self, first: int, n: int) -> list[str]:
        """For n consecutive leaves the siblings on their way up, one after the other."""
        above: dict[int, str] = {0: ""}
        for level in range(len(self.sizes) - 2, -1, -1):
            step, known = ARITY**level, self.nodes[level]
            here = range(first // step, (first + n - 1) // step + 1)
            above = {j: "".join(known[i] for i in self.run(level, j) if i != j) + above[j // ARITY] for j in here}
        return [above[i] for i in range(first, first + n)]

    def way(self, index: int) -> list[dict]:
        """Place and run on each level from a leaf up."""
        found = []
        for level in range(len(self.sizes) - 1):
            run = self.run(level, index)
            found.append({"at": index - run.start, "run": [self.nodes[level][i] for i in run]})
            index //= ARITY
        return found

    def folded(self, index: int, leaf: str) -> str:
        """The subroot that a leaf in this place would make."""
        for level in range(len(self.sizes) - 1):
            known = self.nodes[level]
            leaf = joined_hash(leaf if i == index else known[i] for i in self.run(level, index))
            index //= ARITY
        return leaf


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


NODES_ARROW = pa.schema([("part", pa.int32()), ("g", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string()), ("total", pa.int64()), ("kind", pa.int32())])


def _segments(leaves: pa.Table, spans: pa.Table) -> Iterator[tuple[str | None, int, int, pa.Table]]:
    """Of each tree in a part: its name, the place of its first leaf here, its leaves in all, and those here in order."""
    starts = {g: (start, total) for g, start, total in zip(*(spans.column(c).to_pylist() for c in ("g", "start", "total")))}
    leaves = leaves.take(pc.sort_indices(leaves, [(c, "ascending") for c in ("g", "k", "leaf")], null_placement="at_start"))
    names, at = leaves.column("g").to_pylist(), 0
    while at < len(names):
        end = at + 1
        while end < len(names) and names[end] == names[at]:
            end += 1
        yield names[at], *starts[names[at]], leaves.slice(at, end - at)
        at = end


def _planted(total: int, start: int, mine: pa.Table) -> Forest:
    forest = Forest(total)
    forest.nodes[0] = dict(enumerate(mine.column("leaf").to_pylist(), start))
    return forest


def _fragment(key: tuple, leaves: pa.Table, spans: pa.Table) -> pa.Table:
    """What a part leaves open, and the subroots of trees that lie in it."""
    rows = []
    for g, start, total, mine in _segments(leaves, spans):
        forest = _planted(total, start, mine)
        rows += [(key[0].as_py(), g, level, i, h, total, kind) for level, i, h, kind in forest.left(forest.resolve())]
    return _table(rows, NODES_ARROW)


def _merged(key: tuple, nodes: pa.Table) -> pa.Table:
    """The union of forests with all complete runs resolved; nodes that these consume are kept for the proofs."""
    trees: dict[str | None, Forest] = {}
    for g, level, i, h, total in zip(*(nodes.column(c).to_pylist() for c in ("g", "level", "index", "hash", "total"))):
        if g not in trees:
            trees[g] = Forest(total)
        trees[g].nodes[level][i] = h
    part, rows = key[0].as_py(), []
    for g, forest in trees.items():
        consumed, total = forest.resolve(), forest.sizes[0]
        rows += [(part, g, level, i, forest.nodes[level][i], total, CONSUMED) for level, i in consumed]
        rows += [(part, g, level, i, h, total, kind) for level, i, h, kind in forest.left(consumed)]
    return _table(rows, NODES_ARROW)


class Trees:
    """The trees over ``leaves``, which has ``g`` (a tree each), ``k`` (the order within) and ``leaf``, and may have more."""

    def __init__(self, leaves: DataFrame, name: str):
        parts = max(1, -(-leaves.count() // PART_ROWS))
        # equal rows are dealt out by where they stand; which of them is which makes no difference
        dealt = leaves.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, "g", "k", "leaf", "__tie")
        self.leaves = saved(dealt.drop("__tie").withColumn("part", F.spark_partition_id()), f"{name}-leaves")
        before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.leaves.groupBy("part", "g").agg(F.count(F.lit(1)).alias("rows"))
        placed = counts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy("g")))
        self.spans = saved(placed, f"{name}-spans")
        nodes = self._reduced(name)
        self.roots = nodes.filter(F.col("kind") == SUBROOT).select("g", F.col("hash").alias("root"))
        self.consumed = nodes.filter(F.col("kind") == CONSUMED).select("g", "level", "index", "hash")

    def _reduced(self, name: str) -> DataFrame:
        """The forests of all parts merged, ``FAN`` at a time; all nodes that were written on the way."""
        own = self.leaves.select("part", "g", "k", "leaf").groupBy("part").cogroup(self.spans.groupBy("part"))
        made = nodes = saved(own.applyInArrow(_fragment, NODES), f"{name}-forest")
        parts = (self.leaves.agg(F.max("part")).first()[0] or 0) + 1
        while parts > 1:
            upward = made.filter(F.col("kind") == OPEN).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
            made = saved(upward.groupBy("part").applyInArrow(_merged, NODES), f"{name}-forest")
            nodes, parts = nodes.unionByName(made), -(-parts // FAN)
        return nodes

    def outside(self) -> DataFrame:
        """``part, g, level, index, hash``: nodes that a part's proofs need and that it may not be able to make itself."""
        powers = F.array(*map(F.lit, POWERS))
        height = F.size(F.filter(powers, lambda p: p < F.col("total")))
        levels = self.spans.withColumn("level", F.explode(F.sequence(F.lit(0), height))).filter(F.col("level") < height)
        levels = levels.withColumn("__step", F.element_at(powers, F.col("level") + 1) * ARITY)
        runs = F.array_distinct(F.array(F.expr("start DIV __step"), F.expr("(start + rows - 1) DIV __step")))
        asked = levels.select("part", F.col("g").alias("__g"), F.col("level").alias("__level"), F.explode(runs).alias("__run"))
        asked = asked.select("part", "__g", "__level", F.explode(F.array(*(F.col("__run") * ARITY + i for i in range(ARITY)))).alias("__index"))
        same = asked["__g"].eqNullSafe(self.consumed["g"]) & (asked["__level"] == self.consumed["level"]) & (asked["__index"] == self.consumed["index"])
        return asked.join(self.consumed, same).select("part", "g", "level", "index", "hash")

    def proved(self, prove: Callable[[Forest, int, pa.Table, list], pa.Table], schema: str, ways: DataFrame | None = None) -> DataFrame:
        """Rows of ``prove(forest, first place, leaves, way)`` for each tree in each part; ``ways`` has for each ``g`` the way on from its root."""
        spans = self.spans.withColumn("way", F.lit(None).cast(WAY))
        if ways is not None:
            spans = self.spans.join(ways.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g")))
        known = spans.select("part", "g", "start", "total", "way").unionByName(self.outside(), allowMissingColumns=True)

        def run(leaves: pa.Table, known: pa.Table) -> pa.Table:
            own = pc.is_null(known.column("level"))
            spans, nodes = known.filter(own), known.filter(pc.invert(own))
            way_of = dict(zip(spans.column("g").to_pylist(), spans.column("way").to_pylist()))
            around: dict[str | None, list] = {}
            for g, *node in zip(*(nodes.column(c).to_pylist() for c in ("g", "level", "index", "hash"))):
                around.setdefault(g, []).append(node)
            made = []
            for g, start, total, mine in _segments(leaves, spans):
                forest = _planted(total, start, mine)
                forest.resolve()
                for level, i, h in around.get(g, ()):
                    forest.nodes[level][i] = h
                made.append(prove(forest, start, mine, way_of[g] or []))
            return pa.concat_tables(made)

        return self.leaves.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, schema)


def _ways(forest: Forest, start: int, mine: pa.Table, way: list) -> pa.Table:
    """Of each source its way from the subroot to the root, and both."""
    subroots = mine.column("leaf").to_pylist()
    found = [forest.way(i) for i in range(start, start + len(subroots))]
    root = [forest.folded(start + n, h) for n, h in enumerate(subroots)]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))
    return pa.table({"source": mine.column("k"), "subroot": mine.column("leaf"), "root": pa.array(root, pa.string()), "way": pa.array(found, kind)})


def _proofs(forest: Forest, start: int, mine: pa.Table, way: list) -> pa.Table:
    """Of each document the digest of its proof, and the root that its tampered leaf folds to."""
    after = "".join(h for step in way for i, h in enumerate(step["run"]) if i != step["at"])
    proofs = [joined_hash([w, after]) for w in forest.ways(start, len(mine))]
    folded = []
    for i, leaf in enumerate(mine.column("tampered").to_pylist(), start):
        top = forest.folded(i, leaf)
        for step in way:
            top = joined_hash(top if n == step["at"] else h for n, h in enumerate(step["run"]))
        folded.append(top)
    plain = {"g": mine.column("g"), "doc_id": mine.column("k"), "leaf": mine.column("leaf")}
    return pa.table(plain | {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A row whose decimal id has an even crc32 is tampered with after its manifest is made: its text loses all ``\n``.
    """
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    leaf = leaf_hash(F.col(c) for c in FIELDS)
    tampered = F.when(changed, leaf_hash(cut if c == "text" else F.col(c) for c in FIELDS))
    leaves = docs.select(F.col("source").alias("g"), F.col("doc_id").cast("long").alias("k"), leaf.alias("leaf"), tampered.alias("tampered"))
    trees = Trees(leaves.withColumn("tampered", F.coalesce("tampered", "leaf")), "documents")
    top = Trees(trees.roots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("k"), F.col("root").alias("leaf")), "sources")
    sources = saved(top.proved(_ways, f"source string, subroot string, root string, way {WAY}"), "sources")
    rows = trees.proved(_proofs, "g string, doc_id long, leaf string, proof_sha256 string, folded_root string", sources.select(F.col("source").alias("g"), "way"))
    found = rows.join(sources.drop("way"), F.col("g").eqNullSafe(F.col("source")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
