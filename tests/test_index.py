"""Resampling and positions over sources against plain lists."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roundweave import sources
from roundweave.operators.index import SourceIndex, entries, resampled


@pytest.mark.parametrize("n, size, weight, m", [(10, None, None, 10), (10, 4, None, 4), (10, 23, None, 23), (10, 0, None, 0), (10, None, 0.25, 3), (10, 7, 3.0, 21), (0, None, 2.0, 0), (1, 5, None, 5)])
@pytest.mark.parametrize("seed", [-1, 3])
def test_resampled(spark, n, size, weight, m, seed):
    rows = spark.range(n).withColumn("v", F.col("id") * 2)
    got = resampled(rows, "id", n, size, weight, seed).collect()
    assert sorted(r["entry"] for r in got) == list(range(m)) and entries(n, size, weight) == m
    times = [sum(r["id"] == i for r in got) for i in range(n)]
    assert not n or {m // n, -(-m // n)} >= set(times)
    assert all(r["v"] == 2 * r["id"] for r in got)


def test_numbers_that_products_of_do_not_fit_64_bits(spark):
    n, m = 3 * 10**11 + 7, 10**12 + 3
    rows = spark.createDataFrame([(i,) for i in (0, 1, 12345678901, n - 1)], "row long")
    for seed in (-1, 5):
        got = resampled(rows, "row", n, m, seed=seed).collect()
        index = SourceIndex({"s": rows}, "row", {"s": n}, {"s": m}, seed=seed)
        back = index.select([r["entry"] for r in got]).count()
        assert 12 <= len(got) <= 16 and back == len(got)
    assert sorted(r["entry"] for r in resampled(rows, "row", n, m, seed=-1).collect() if r["row"] == 1) == [e for e in range(3, 8) if e * n // m == 1]


def test_bad_sizes(spark):
    for bad in ({"size": 3}, {"size": 3, "weight": 1.0}):
        with pytest.raises(ValueError):
            entries(0, **bad)
    with pytest.raises(ValueError):
        entries(5, -1)
    with pytest.raises(ValueError):
        entries(5, weight=-0.5)


@pytest.fixture(scope="module")
def index(spark):
    named = {n: spark.range(k).select(F.col("id").alias("row"), (F.col("id") + 100 * i).alias("v"), F.lit(i).alias(f"only_{n}")) for i, (n, k) in enumerate({"a": 7, "b": 0, "c": 5}.items())}
    return SourceIndex(named, "row", {"a": 7, "b": 0, "c": 5}, sizes={"c": 12}, seed=4)


def test_positions(spark, index):
    plain = sorted((r["at"], r["_dataset_name"], r["v"]) for r in index.entries().collect())
    assert [p[0] for p in plain] == list(range(19)) == list(range(len(index))) and [p[1:] for p in plain[:7]] == [("a", i) for i in range(7)]
    rng = random.Random(2)
    asked = [0, -1, [], [3, 3, -19, 18], slice(None), slice(5, 9), slice(-4, None), slice(None, None, -1), slice(15, 2, -3), slice(30, 40), slice(3, 3)]
    asked += [slice(rng.randint(-22, 22), rng.randint(-22, 22), rng.choice([-5, -1, 1, 2, 7])) for _ in range(6)]
    for i in asked:
        got = [(r["_dataset_name"], r["v"]) for r in sorted(index.select(i).collect(), key=lambda r: r["at"])]
        want = plain[i] if isinstance(i, slice) else [plain[p] for p in ([i] if isinstance(i, int) else i)]
        assert got == [(name, v) for _, name, v in want], i


@pytest.mark.parametrize("bad, error", [("a", ValueError), (1.0, ValueError), ((1, 2), ValueError), (["a"], ValueError), (None, ValueError), (19, IndexError), ([0, -20], IndexError)])
def test_bad_positions(index, bad, error):
    with pytest.raises(error):
        index.select(bad)


def test_only_what_is_asked_for_is_read(spark, index):
    plan = index.select(slice(1, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "100" not in plan.replace("100 *", "") and "only_c" not in plan


def test_streaming(spark):
    index = SourceIndex({"a": spark.range(3)}, "id", {"a": 0}, streaming=True)
    assert index.length() == -1
    for ask in (lambda: index.select(0), index.entries):
        with pytest.raises(ValueError):
            ask()


@pytest.mark.parametrize("fmt", ["jsonl", "parquet", "csv", "txt", "arrow"])
def test_loading(spark, tmp_path, fmt):
    """Numbers follow the names of files and the order in them, blank lines don't count, and splits make no difference."""
    folder = tmp_path / "d"
    folder.mkdir()
    rows = [{"output": f"text {i}", "instruction": f"do {i}"} for i in range(900)]
    for name, part in (("b", rows[600:]), ("a", rows[:600])):
        if fmt == "jsonl":
            (folder / f"{name}.jsonl").write_text("\n\n".join(map(json.dumps, part)) + "\n")
        elif fmt == "csv":
            (folder / f"{name}.csv").write_text("output,instruction\n" + "\n".join(f"{r['output']},{r['instruction']}" for r in part) + "\n")
        elif fmt == "txt":
            (folder / f"{name}.txt").write_text("\n".join(r["output"] for r in part) + "\n")
        elif fmt == "parquet":
            import pyarrow.parquet as pq

            pq.write_table(pa.Table.from_pylist(part), folder / f"{name}.parquet", row_group_size=50)
        else:
            table = pa.Table.from_pylist(part)
            with pa.OSFile(str(folder / f"{name}.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table)
    text = "value" if fmt == "txt" else "output"
    infos = {"x": {"file_name": str(folder), "size": 30}, "y": {"file_name": str(folder), "weight": 0.5}, "z": {"file_name": str(folder)}, "t": {"file_name": str(folder), "split": "test", "size": 1000}}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in ("4096", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            index = sources.load_index(spark, infos, seed=-1)
            assert index.size == [30, 450, 900]
            got = [r[text] for r in sorted(index.select(slice(480, None)).collect(), key=lambda r: r["at"])]
            assert got == [r["output"] for r in rows] if fmt != "arrow" else sorted(got) == sorted(r["output"] for r in rows)
            loaded = sources.load_sources(spark, infos, seed=2)
            seen.append({n: sorted(r[text] for r in d.collect()) for n, d in loaded.items()})
            assert {n: len(v) for n, v in seen[-1].items()} == {"x": 30, "y": 450, "z": 900}
            assert all("__row" not in d.columns and "_idx" not in d.columns for d in loaded.values())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]
    assert {n: d.count() for n, d in sources.load_sources(spark, infos, "test").items()} == {"t": 1000}


def test_converters(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"instruction": f"i{n} ", "input": "x", "output": f"o{n}"}) + "\n" for n in range(4)))
    (tmp_path / "b.jsonl").write_text('{"messages": "as it is"}\n')
    infos = {"a": {"file_name": str(tmp_path / "a.jsonl"), "converter": "alpaca", "size": 2}, "b": {"file_name": str(tmp_path / "b.jsonl"), "streaming": False}}
    loaded = sources.load_sources(spark, infos, seed=-1)
    assert [[(m["role"], m["value"], m["loss_weight"]) for m in r["messages"]] for r in loaded["a"].collect()] == [[("user", f"i{n} x", 0.0), ("assistant", f"o{n}", 1.0)] for n in (0, 2)]
    assert loaded["b"].first()["messages"] == "as it is" and loaded["a"].columns == ["messages"]
    one = sources.load_index(spark, {"a": infos["a"]}, seed=-1).select(-1).first()
    assert (one["at"], one["_dataset_name"], one["messages"][1]["value"]) == (0, "a", "o2")
    with pytest.raises(ValueError):
        sources.load_sources(spark, {"a": {"file_name": str(tmp_path / "a.jsonl"), "converter": "none"}})
    infos["b"]["streaming"] = True
    assert sources.load_index(spark, infos).length() == -1
