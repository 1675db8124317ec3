"""Orders by chance, media in folders, and the cost of training."""

import base64
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from roundweave.operators import select, stats
from roundweave.sources import media
from roundweave.streaming import ordered, read_samples


def test_shuffles_do_not_depend_on_splits(spark):
    rows = spark.range(500).withColumnRenamed("id", "i")
    one, two = (select.shuffled(rows.repartition(n), "i", 3).collect() for n in (1, 7))
    assert one == two and sorted(r["i"] for r in one) == list(range(500)) != [r["i"] for r in one]
    assert one != select.shuffled(rows, "i", 4).collect()
    one, two = (select.buffer_shuffled(rows.repartition(n), "i", 20, 3).collect() for n in (1, 7))
    order = [r["i"] for r in one]
    assert one == two and sorted(order) == list(range(500)) != order
    place = {i: n for n, i in enumerate(order)}
    assert max(i - n for i, n in place.items()) < 20  # nothing goes before all but 20 of those in front of it have come
    held = [sum(i <= n and place[i] >= n for i in range(500)) for n in range(500)]
    assert max(held) <= 20
    assert [r["i"] for r in select.buffer_shuffled(rows, "i", 1, 3).collect()] == list(range(500))


def test_streams_shuffle_like_batches(spark, tmp_path):
    """Rows come in any order, over any batches; a buffer of 16 gives the order of a batch."""
    rows = [{"_idx": i, "v": f"v{i}"} for i in range(100)]
    want = [r["_idx"] for r in select.buffer_shuffled(spark.createDataFrame(rows, "_idx long, v string"), "_idx", 16, 5).collect()]
    for seed, size in ((1, 20), (2, 33)):
        mixed, home = random.Random(seed).sample(rows, 100), tmp_path / str(seed)
        (home / "in").mkdir(parents=True)
        for n in range(0, 100, size):
            file = home / "in" / f"{n:03d}.json"
            file.write_text("\n".join(map(json.dumps, mixed[n : n + size])))
            os.utime(file, (1.7e9 + n, 1.7e9 + n))
        stream = read_samples(spark, str(home / "in"), "_idx long, v string", files_per_batch=1)
        ordered.write_in_order(stream, str(home / "out"), str(home / "check"), buffer=16, seed=5).awaitTermination(300)
        sink = ordered.OrderedSink(spark, str(home / "out"), stream.schema, buffer=16, seed=5)
        assert 0 < sink.held().count() <= 16
        sink.finish()
        assert sink.held().count() == 0
        got = [json.loads(x)["_idx"] for part in sorted((home / "out" / "rows").iterdir()) for f in sorted(part.glob("part-*")) for x in f.read_text().splitlines()]
        assert got == want


def test_buffer_over_many_batches(spark, tmp_path):
    """Numbers that come nearly in order, three at a time: much is written while older rows are still held back."""
    rows = spark.range(30).selectExpr("id AS _idx", "cast(id AS string) AS v")
    want = [r["_idx"] for r in select.buffer_shuffled(rows, "_idx", 8, 2).collect()]
    sink = ordered.OrderedSink(spark, str(tmp_path / "o"), rows.schema, buffer=8, seed=2)
    last = 0
    for n, first in enumerate([0, 6, 3, 9, 12, 18, 15, 21, 24, 27]):
        sink(rows.filter(F.col("_idx").between(first, first + 2)), n)
        assert sink._last()["next"] >= last
        last = sink._last()["next"]
    assert last == 30
    sink.finish()
    got = [json.loads(x)["_idx"] for part in sorted((tmp_path / "o" / "rows").iterdir()) for f in sorted(part.glob("part-*")) for x in f.read_text().splitlines()]
    assert got == want


def test_folder_of_media(spark, tmp_path):
    (tmp_path / "m" / "deep er").mkdir(parents=True)
    files = {"a.png": b"\x89PNG" + bytes(range(256)) * 3, "deep er/b.JPG": b"jpg", "c.unknown": b"y", "d": b"x", "e.txt": "é".encode()}
    for name, content in files.items():
        (tmp_path / "m" / name).write_bytes(content)
    (tmp_path / "m" / "empty.png").write_bytes(b"")  # no image
    found = {r["path"]: (r["bytes"], r["mime"]) for r in media.listing(spark, str(tmp_path / "m")).collect()}
    kinds = {"a.png": "image/png", "deep er/b.JPG": "image/jpeg", "c.unknown": "image/jpeg", "d": "image/jpeg", "e.txt": "text/plain"}
    root = f"{tmp_path}/m/"
    by_name = {k.replace("%20", " ").removeprefix(root): v for k, v in found.items()}
    assert by_name == {n: (len(c), kinds[n]) for n, c in files.items()}
    assert media.listing(spark, str(tmp_path / "m"), "*.png").count() == 1  # without the empty one
    assert "content" not in media.listing(spark, str(tmp_path / "m"))._jdf.queryExecution().executedPlan().toString()
    paths = spark.createDataFrame([(root + "a.png",), ("file://" + root + "e.txt",), (root + "a.png",), (root + "gone.png",), (None,)], "path string")
    urls = {r["path"]: r["url"] for r in media.data_urls(spark, str(tmp_path / "m"), paths).collect()}
    assert urls == {root + "a.png": "data:image/png;base64," + base64.b64encode(files["a.png"]).decode(), "file://" + root + "e.txt": "data:text/plain;base64," + base64.b64encode(files["e.txt"]).decode()}
    images = select.image_paths(spark.createDataFrame([([root + "a.png", root + "gone.png"],)], "images array<string>"))
    assert [r["path"] for r in select.missing_images(images, media.listing(spark, str(tmp_path / "m"))).collect()] == [root + "gone.png"]


@pytest.mark.parametrize("backward, recompute, flash, tied", [(True, False, False, False), (False, False, False, True), (True, True, True, True)])
def test_flops(spark, backward, recompute, flash, tied):
    """Two layers of width 4 with two heads, one of keys, over two rows of 6 tokens; counted by hand."""
    mlp, proj, scores = 3 * 2 * 4 * 8, 2 * (2 * 16) + 2 * (2 * 16 * 1 // 2), 2 * 2 * 4 * 36
    inner = 2 * 6 * 2 * (mlp + proj) + 2 * 2 * scores
    embedding = 2 * 6 * 4 * 10 * (1 if tied else 2)
    by_hand = (1 + 2 * backward + recompute) * inner + (1 + 2 * backward) * embedding + (2 * 2 * scores if flash else 0)
    config = F.struct(*(F.lit(v).alias(k) for k, v in {"hidden": 4, "vocab": 10, "intermediate": 8, "heads": 2, "kv_heads": 1, "layers": 2, "tied": tied}.items()))
    made = spark.range(1).select(stats.model_flops(config, F.lit(2), F.lit(6), backward, recompute, flash)).first()[0]
    assert made == by_hand


def test_devices(spark):
    names = spark.createDataFrame([("NVIDIA H800 PCIe", 2), ("RTX 4090", 1), ("A100", 8)], "name string, n int")
    assert [r[0] for r in names.select(stats.device_flops(F.col("name"), F.col("n"))).collect()] == [2 * 989e12, 98e12, 8 * 312e12]
    with pytest.raises(Exception, match="no device like"):
        names.select(stats.device_flops(F.lit("abacus"), F.col("n"))).collect()
    assert names.select(stats.utilisation(F.lit(2.0), F.lit(3e12), F.lit(24e12))).first()[0] == 0.25
