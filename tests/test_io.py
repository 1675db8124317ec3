"""Sources, sinks, selection and streams."""

import json

import pytest
from pyspark.sql import functions as F

from roundweave import sources, streaming
from roundweave.operators import select, stats
from tests.conftest import SF


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_bad_lines(spark, tmp_path):
    good, bad = {"a": 1}, "{broken"
    fine, mixed = lines(tmp_path / "f.jsonl", [good, "", good]), lines(tmp_path / "m.jsonl", [good, bad, good])
    assert sources.read_jsonl(spark, fine, "a int").count() == 2
    assert sources.read_jsonl(spark, mixed, "a int", "skip").collect() == [(1,), (1,)]
    assert sources.read_jsonl(spark, mixed, "a int", "empty").count() == 0
    assert sources.read_jsonl(spark, fine, "a int", "empty").count() == 2
    with pytest.raises(Exception):
        sources.read_jsonl(spark, mixed, "a int").collect()


def test_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sources.read_json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2
    assert sources.read_any(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "t.txt").write_text("x\ny\n")
    assert sources.read_any(spark, str(tmp_path / "t.txt")).count() == 2
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert sources.read_any(spark, str(tmp_path / "p")).count() == 3
    found = sources.load_sources(spark, {"x": {"file_name": str(tmp_path / "p"), "size": 2}})
    assert found["x"].count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", None), (3, "c", "oops")], "_idx int, v string, error string")
    sources.write_with_errors(rows, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "good")).count() == 2 and spark.read.json(str(tmp_path / "bad")).first()["error"] == "oops"
    sources.write_ordered(rows, str(tmp_path / "o"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert [json.loads(x)["_idx"] for x in written.splitlines()] == [1, 2, 3]
    with pytest.raises(ValueError):
        sources.replace_if_clean(rows, rows, str(tmp_path / "o"))
    sources.replace_if_clean(rows.limit(1), rows.limit(0), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 1
    assert sources.training_view(spark.createDataFrame([("s", 1)], "system string, x int")).columns == ["system"]


def test_positions():
    assert select.positions(-1, 5) == [4] and select.positions(slice(1, None, 2), 5) == [1, 3] and select.positions([3, 3], 5) == [3, 3]
    with pytest.raises(ValueError):
        select.positions("x", 5)
    with pytest.raises(IndexError):
        select.positions(5, 5)
    assert select.neighbours(0, 5) == (0, 1) and select.neighbours(2, 5) == (1, 2)


def test_sample_and_pending(spark):
    rows = spark.range(20).withColumnRenamed("id", "_idx")
    assert select.sample(rows, "_idx", 5, 1).collect() == select.sample(rows, "_idx", 5, 1).collect()
    assert select.sample(rows, "_idx", 50, 1).count() == 20
    done = spark.createDataFrame([(3,), (-1,)], "_idx long")
    assert select.pending(rows, "_idx", done, done).count() == 19


def test_scores():
    assert stats.bleu4("abcdef", "abcdef") == pytest.approx(1.0)
    assert stats.bleu4("", "a") == 0.0 and stats.bleu4("xyz", "abc") == 0.0
    assert stats.rouge_f("a b c".split(), "a b d".split(), 1) == pytest.approx(2 / 3)
    assert stats.rouge_l("a b c d".split(), "a c d".split()) == pytest.approx(6 / 7)


def test_packing(spark):
    rows = spark.createDataFrame([([1, 1, 2, 2, 2, 0],), ([1, 2, 2, 3, 3, 3],), ([0],), ([],)], "m array<int>")
    got = [(r[0], r[1]) for r in rows.select(stats.sequence_lengths(F.col("m")).alias("l")).select("l", stats.running_offsets(F.col("l"))).collect()]
    assert got == [([2, 3], [0, 2, 5]), ([1, 2, 3], [0, 1, 3, 6]), ([], [0]), ([], [0])]


def test_stream_equals_batch(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns.repartition(3).write.json(str(tmp_path / "in"))
    stream = streaming.canonical_turns(streaming.read_samples(spark, str(tmp_path / "in"), turns.schema, files_per_batch=1))
    query = streaming.write(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")), streaming.canonical_turns(turns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    events.write.json(str(tmp_path / "in"))
    stream = streaming.event_counts(streaming.read_samples(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"), "ts", "1 day", "1 day")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == events.count()
