"""Metrics in batches give what one pass gives; rephrasers are asked once and may fail."""

import json
import random

import pytest
from pyspark.sql import functions as F

from roundweave.operators import edit, metrics
from roundweave.streaming import read_samples


def test_any_split_gives_the_same(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, float("nan"), rng.random(), 1e6 * rng.random(), 1e-9])) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, x double").cache()
    scores = {"x": F.col("x"), "half": F.when(F.col("id") % 2 == 0, F.col("x")), "none": F.lit(None).cast("double")}
    want = sorted(metrics.results(metrics.partial_states(table, scores)).collect())
    good = [x for _, x in rows if x is not None and x == x]
    assert [tuple(r)[:2] for r in want] == [("half", sum(x is not None and x == x for i, x in rows if i % 2 == 0)), ("none", 0), ("x", len(good))]
    assert want[2]["mean"] == pytest.approx(sum(good) / len(good), rel=1e-12) and want[1]["mean"] is None
    for cuts in ([200], [1, 2, 399], sorted(rng.sample(range(1, 400), 6))):
        states = [metrics.partial_states(table.filter(F.col("id").between(a, b - 1)), scores) for a, b in zip([0, *cuts], [*cuts, 400])]
        rng.shuffle(states)
        assert sorted(metrics.results(metrics.merged(*states)).collect()) == want
    assert [r["n"] for r in metrics.results(metrics.partial_states(table.limit(0), scores)).collect()] == [0, 0, 0]


def test_scores_are_worked_out_once(spark):
    """However often a state uses a score, the plan has it once."""
    table = spark.createDataFrame([("a b", [1, 2], [3, 1]), ("c", [1], [1]), ("", [], [])], "t string, predicted array<int>, labels array<int>")
    states = metrics.partial_states(table, metrics.accuracy() | {"length": F.length(F.regexp_replace("t", " +", "_")) / 2})
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("slice(labels") == 1
    assert sorted(map(tuple, metrics.results(states).collect())) == [("accuracy", 1, 1.0), ("length", 3, 2 / 3)]


def test_table(spark, tmp_path):
    held = metrics.MetricTable(spark, str(tmp_path / "m"))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "predicted array<int>, labels array<int>")
    assert held.dump() is None and held.result().collect() == []
    held.add(rows(([1, 2, 0], [9, 1, 2]), ([5, 5, 0], [9, 5, -100])), metrics.accuracy(), 0)
    held.add(rows(([1, 2, 0], [9, 3, 3])), metrics.accuracy(), 1)
    held.add(rows(([1, 2, 0], [9, 1, 3])), metrics.accuracy(), 1)  # done again after a crash
    assert held.dump() == [("accuracy", pytest.approx(2.5 / 3))]
    assert held.dump() is None
    held.add(rows(([1], [1]), ([7, 0], [1, 7])), metrics.accuracy(), 0)
    assert metrics.MetricTable(spark, str(tmp_path / "m")).dump() == [("accuracy", 1.0)]


def test_similarity_of_a_stream(spark, tmp_path):
    pairs = [("a b c", "a b d"), ("x y", "x y"), ("", "z"), ("a b c d", "a c d"), ("p q r s", "p q r s")]
    (tmp_path / "in").mkdir()
    for i, (p, q) in enumerate(pairs):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"predicted": p, "label": q}))
    held = metrics.MetricTable(spark, str(tmp_path / "m"))
    stream = read_samples(spark, str(tmp_path / "in"), "predicted string, label string", files_per_batch=2)
    stream.writeStream.foreachBatch(held(metrics.similarity())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    one = metrics.results(metrics.partial_states(spark.createDataFrame(pairs, "predicted string, label string"), metrics.similarity()))
    assert sorted(held.result().collect()) == sorted(one.collect()) and held.result().filter("n = 5").count() == 4


MESSAGES = "conv_id long, messages array<struct<role:string,content:string>>, groups array<array<int>>"


def conversation(conv, thoughts, groups):
    turns = [("user", "q")]
    for t in thoughts:
        turns += [("assistant", f"<think>{t}</think><tool_call>{{}}</tool_call>"), ("user", "<tool_response>r</tool_response>")]
    return conv, turns, groups


def test_rephraser(spark, tmp_path):
    """Each thought is asked once, over groups, conversations and runs; failures leave the join."""
    log = str(tmp_path / "asked")

    def call(texts):
        import os
        import uuid

        if "bad" in "".join(texts) and len(texts) > 1:
            raise RuntimeError("one of these")
        if texts[0].startswith("bad"):
            return [] if "empty" in texts[0] else None if "none" in texts[0] else [3]
        os.makedirs(log, exist_ok=True)
        for t in texts:
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return [f" {t.upper()}\n" for t in texts]

    rows = spark.createDataFrame([conversation(i, ["one", "two", "three", "bad empty", "x"], [[2, 3], [5, 6]]) for i in range(6)] + [conversation(9, ["bad none", "y"], [[2, 3]]), conversation(10, ["bad", "z"], [[2, 3]]), conversation(11, ["", ""], [[2, 3]]), conversation(12, ["q", "w"], [[1, 2, 3]])], MESSAGES).repartition(4)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        told = edit.rephrased_with(rows, call, cache, batch=3, tasks=2)
        new = {r["conv_id"]: r["m"] for r in told.select("conv_id", edit.merged(F.col("messages"), F.col("groups"), pairwise=False, rephrased=F.col("rephrased")).alias("m")).collect()}
        assert [m["content"] if m else None for m in new[0]][1::2] == ["<think>ONE;\nTWO</think><tool_call>{}\n{}</tool_call>", None, "<think>three</think><tool_call>{}</tool_call>", "<think>bad empty;\nx</think><tool_call>{}\n{}</tool_call>", None]
        assert new[9][1]["content"].startswith("<think>bad none;\ny</think>") and new[10][1]["content"].startswith("<think>bad;\nz</think>")
        assert new[11][1]["content"].startswith("<think></think>") and new[12][1]["content"].startswith("<think>q</think>")
    import os

    assert sorted(open(f"{log}/{f}").read() for f in os.listdir(log)) == ["one;\ntwo"]
    assert [tuple(r)[1:] for r in spark.read.parquet(cache).collect()] == [("ONE;\nTWO",)]
