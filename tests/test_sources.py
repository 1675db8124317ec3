"""Sources with line numbers, Arrow files, infos of sources, and sinks that are read again."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roundweave import sources
from roundweave.operators import select


def test_line_numbers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    lines = [json.dumps({"v": i}) if i % 4 else "" for i in range(5000)]
    (tmp_path / "d" / "a.jsonl").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "d" / "b.jsonl").write_text("\n".join(lines[3000:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of a file
    try:
        got = sources.read_indexed(spark, str(tmp_path / "d"), "v int").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["_idx"], r["v"]) for r in got) == [(i, i) for i in range(5000) if i % 4]
    (tmp_path / "bad.jsonl").write_text('{"v": 1}\n{oops\n')
    with pytest.raises(Exception):
        sources.read_indexed(spark, str(tmp_path / "bad.jsonl"), "v int").collect()


@pytest.mark.parametrize("stream", [True, False])
def test_arrow_files(spark, tmp_path, stream):
    rows = pa.table({"a": pa.array([1, 2, None], pa.int64()), "b": ["x", None, "é"], "c": pa.array([[1.5], [], None], pa.list_(pa.float64()))})
    for name in ("one", "two"):
        with pa.OSFile(str(tmp_path / f"{name}.arrow"), "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, rows.schema) as w:
            w.write_table(rows, max_chunksize=2)
    got = sources.read_any(spark, str(tmp_path))
    assert got.columns == ["a", "b", "c"] and sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(rows).collect() * 2))


def test_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1}\n\n{"v": "text"}\n')
    (tmp_path / "b.jsonl").write_text('{"v": 1}\n\n{"v": null}\n')
    assert sources.read_jsonl(spark, str(tmp_path / "a.jsonl"), "v int", "empty").count() == 0
    assert sources.read_jsonl(spark, str(tmp_path / "b.jsonl"), "v int", "empty").count() == 2


def test_infos(spark, tmp_path):
    data = str(tmp_path / "x.jsonl")
    (tmp_path / "x.jsonl").write_text('{"v": 1}\n{"v": 2}\n')
    infos = {"a": {"file_name": data, "size": 1}, "b": {"file_name": data, "split": "test", "streaming": True}}
    (tmp_path / "infos.json").write_text(json.dumps(infos))
    (tmp_path / "infos.yaml").write_text("a: {file_name: %s, size: 1}\nb: {file_name: %s, split: test, streaming: true}\n" % (data, data))
    for where in (infos, str(tmp_path / "infos.json"), str(tmp_path / "infos.yaml")):
        assert sources.source_infos(where) == infos and sources.any_streaming(where)
        assert {n: r.count() for n, r in sources.load_sources(spark, where).items()} == {"a": 1}
        assert {n: r.count() for n, r in sources.load_sources(spark, where, "test").items()} == {"b": 2}
    assert {n: r.count() for n, r in sources.load_sources(spark, data).items()} == {"x": 2} and not sources.any_streaming(data)


def test_kept_and_logged(spark, tmp_path):
    rows = spark.range(3)
    assert sources.kept_as(rows, str(tmp_path / "k")).count() == 3
    assert sources.kept_as(rows.limit(1), str(tmp_path / "k")).count() == 3
    assert sources.kept_as(rows.limit(1), str(tmp_path / "k"), overwrite=True).count() == 1
    sources.append_log(rows, str(tmp_path / "log"))
    assert sources.append_log(rows.limit(1), str(tmp_path / "log")).count() == 4
    sources.write_summary(spark.createDataFrame([(2, 0.5, None)], "n int, share double, note string"), str(tmp_path / "s"))
    assert "".join(p.read_text() for p in (tmp_path / "s").glob("part-*")) == "n: 2\nshare: 0.5\nnote: \n"


def test_media_and_lists(spark):
    rows = spark.createDataFrame([(["a.png", "/b.png"], "c.png"), (None, None)], "images array<string>, image string")
    got = rows.select(sources.in_folder(F.col("images"), None, "/data/"), select.listed(F.col("image"), "string"), select.listed(F.col("images"), "array<string>")).collect()
    assert tuple(got[0]) == (["/data/a.png", "/b.png"], ["c.png"], ["a.png", "/b.png"]) and tuple(got[1]) == (None, [], [])
    assert rows.select(sources.in_folder(F.col("images"), "/m", "/data")).first()[0] == ["/m/a.png", "/b.png"]
