"""Streams: results in order through crashes, and conversations that are whole when their answer comes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from roundweave.streaming import assembly, ordered, read_samples

SCHEMA = "_idx long, v string"


def batches(folder, parts):
    folder.mkdir()
    for n, rows in enumerate(parts):
        file = folder / f"{n:04d}.json"
        file.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(file, (1.7e9 + n, 1.7e9 + n))  # files come in the order of their times
    return str(folder)


def lines(folder):
    """All that was appended, in the order of parts, files and lines."""
    return [json.loads(line) for part in sorted((folder / "rows").iterdir()) for f in sorted(part.glob("part-*")) for line in f.read_text().splitlines()]


def test_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [{"_idx": i, "v": f"v{i}"} for i in range(120)]
    mixed = rng.sample(rows, 120)
    parts = [mixed[i : i + 15] + ([mixed[0], mixed[3]] if i > 30 else []) for i in range(0, 120, 15)]
    source = read_samples(spark, batches(tmp_path / "in", parts), SCHEMA, files_per_batch=1)
    out = tmp_path / "out"
    ordered.write_in_order(source, str(out), str(tmp_path / "check")).awaitTermination(300)
    assert lines(out) == rows
    sink = ordered.OrderedSink(spark, str(out), source.schema)
    assert sink.held().count() == 0 and sorted(map(tuple, sink.written().collect())) == [(r["_idx"], r["v"]) for r in rows]
    assert len(list((out / "held").iterdir())) == 1


@pytest.mark.parametrize("at", ["_end", "_commit", "after"])
def test_crash_between_batches(spark, tmp_path, monkeypatch, at):
    """A crash before or after the commit loses and doubles nothing."""
    rows = [{"_idx": i, "v": f"v{i}"} for i in range(40)]
    mixed = random.Random(1).sample(rows, 40)
    source = lambda: read_samples(spark, folder, SCHEMA, files_per_batch=1)
    folder, out, check = batches(tmp_path / "in", [mixed[i : i + 10] for i in range(0, 40, 10)]), tmp_path / "out", str(tmp_path / "check")
    seen = []

    def crash(self, *args):
        if at == "after":
            done(self, *args)
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("crash")
        return done(self, *args) if at != "after" else None

    name = "_commit" if at == "after" else at
    done = getattr(ordered.OrderedSink, name)
    monkeypatch.setattr(ordered.OrderedSink, name, crash)
    with pytest.raises(Exception, match="crash"):
        ordered.write_in_order(source(), str(out), check).awaitTermination(300)
    before = [(r["_idx"], r["v"]) for r in ordered.OrderedSink(spark, str(out), source().schema).written().orderBy("_idx").collect()]
    assert before == [(r["_idx"], r["v"]) for r in rows][: len(before)]
    monkeypatch.setattr(ordered.OrderedSink, name, done)
    ordered.write_in_order(source(), str(out), check).awaitTermination(300)
    assert lines(out) == rows


def test_gaps_wait(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, str(i)) for i in ids], SCHEMA)
    sink = ordered.OrderedSink(spark, str(tmp_path / "o"), rows(1).schema, first=5)
    assert sink.written().count() == sink.held().count() == 0
    for batch, (new, written, held) in enumerate([((7, 9), [], [7, 9]), ((), [], [7, 9]), ((5, 5), [5], [7, 9]), ((6, 7, 5), [5, 6, 7], [9]), ((10, 8), [5, 6, 7, 8, 9, 10], [])]):
        for _ in range(2):  # a batch that was committed isn't done again
            sink(rows(*new), batch)
        assert [r["_idx"] for r in sink.written().orderBy("_idx").collect()] == written and sorted(r["_idx"] for r in sink.held().collect()) == held
    for bad in (4, None):
        with pytest.raises(ValueError):
            sink(rows(bad), 9)


TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


def test_whole_when_the_answer_comes(spark, tmp_path):
    def turn(conv, n, minute, text=""):
        return {"conv_id": conv, "turn": n, "role": "assistant" if n % 2 else "user", "text": text or f"t{n}", "ts": f"2024-01-01T{10 + minute // 60}:{minute % 60:02d}:00Z"}

    end = "<think>x</think><answer>y</answer>"
    parts = [
        [turn(1, 0, 0), turn(1, 3, 1, end), turn(2, 0, 0)],  # the answer comes before what leads to it
        [turn(1, 2, 2), turn(2, 1, 2, "<answer>z</answer>")],
        [turn(1, 1, 3), turn(1, 2, 3), turn(3, 0, 3), turn(3, 1, 3)],
        [turn(1, 1, 4, "again"), turn(2, 2, 4), {"conv_id": None, "turn": 0, "role": "user", "text": "x", "ts": "2024-01-01T10:04:00Z"}],
        [turn(9, 0, 200)],
        [turn(9, 1, 201, end)],
        [turn(2, 5, 400)],
    ]
    source = read_samples(spark, batches(tmp_path / "in", parts), TURNS, files_per_batch=1)
    made = assembly.assembled(source, "ts", "1 minute", 30 * 60_000)
    seen = []
    query = made.writeStream.foreachBatch(lambda rows, n: seen.extend((n, r["conv_id"], r["state"], [(t["turn"], t["text"]) for t in r["turns"]]) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(600)
    by_batch = lambda state: sorted(x[1:2] + x[3:] for x in seen if x[2] == state)
    assert by_batch("whole") == [(1, [(0, "t0"), (1, "t1"), (2, "t2"), (3, end)]), (2, [(0, "t0"), (1, "<answer>z</answer>")]), (9, [(0, "t0"), (1, end)])]
    assert {(c, n) for n, c, state, _ in seen if state == "whole"} == {(2, 1), (1, 2), (9, 5)}  # in the very batch
    assert by_batch("late") == [(1, [(1, "again")]), (2, [(2, "t2")])]
    assert (3, [(0, "t0"), (1, "t1")]) in by_batch("broken off")


def test_equals_the_batch_form(spark, tmp_path):
    """Turns of the given conversations in any order, tagged with an answer at their end."""
    from tests.conftest import SF

    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role <> 'system'")
    own = "PARTITION BY conv_id ORDER BY turn"
    turns = turns.selectExpr("conv_id", f"row_number() OVER ({own}) - 1 AS turn", "role", f"CASE WHEN role = 'assistant' AND lead(turn) OVER ({own}) IS NULL THEN concat('<answer>', text, '</answer>') ELSE text END AS text", "timestamp_seconds(1700000000 + hash(conv_id, turn) % 600) AS ts").cache()
    turns.repartition(4, F.xxhash64("conv_id", "turn")).write.json(str(tmp_path / "in"))
    source = read_samples(spark, str(tmp_path / "in"), TURNS, files_per_batch=1)
    query = assembly.assembled(source, "ts", "1 hour", 10**9).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(600)
    got = {(r["conv_id"], r["state"]): r["turns"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["conv_id"], r["state"]): r["turns"] for r in assembly.assembled_at_once(turns, "ts").collect() if r["state"] != "broken off"}
    assert got == want and len(want) > 4
