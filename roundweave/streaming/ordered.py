"""Results that arrive out of order, appended in order.

Every row has a number, from 0 without gaps once all have arrived. A batch adds its rows to those held back;
the numbers that follow without a gap on what was written are written next, and the others are held back. What was
written and what is held back after a batch becomes valid with one small commit file, so a crash at any point leaves the state of the batch before, and
the batch is done again. A batch that was committed isn't done twice.

The same sink shuffles with a bounded buffer: a row then goes to a place behind its own number, and is written once all numbers up to that
place have come, as none that comes later can stand before it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from roundweave.operators.select import buffer_place, buffer_shuffled


class Folder:
    """Small files in a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def put(self, name: str, content: dict) -> None:
        """Writes a file that is there as a whole or not at all."""
        part = self._at(f"{name}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self._fs.rename(part, self._at(name)):
            raise OSError(f"can't move {part} to {name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class OrderedSink:
    """A ``foreachBatch`` function that appends rows to ``path`` in the order of ``key``.

    A number that comes again, in one batch or later, counts once: the first stays; within a batch it is any one of them. Numbers
    under ``first``, and null ones, are an error, as they could never be written. ``buffer`` shuffles the rows within
    as many places, by ``seed``; what is still held back when all rows have come is written by ``finish``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "_idx", first: int = 0, buffer: int = 1, seed: int = 0):
        self.spark, self.schema, self.key, self.first = spark, schema, key, first
        self.buffer, self.seed = buffer, seed
        self.folder = Folder(spark, path)

    def _last(self) -> dict:
        done = [n for n in self.folder.names("commits") if not n.endswith(".part")]
        return self.folder.read(f"commits/{done[-1]}") if done else {"batch": -1, "next": self.first, "held": None, "parts": []}

    def _rows(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{folder}") if folder else self.spark.createDataFrame([], self.schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last = self._last()
        if batch_id <= last["batch"]:
            return
        key, start = F.col(self.key), last["next"]
        new = batch.select(*self.schema.names)
        if not new.filter(key.isNull() | (key < self.first)).isEmpty():
            raise ValueError(f"{self.key} has to be a number from {self.first}")
        held = self._rows(last["held"])
        new = new.filter(key >= start).dropDuplicates([self.key]).join(held.select(self.key), self.key, "left_anti").select(*self.schema.names)
        # what there is now is kept for good before its end is looked for, as a stream's rows may not come alike twice
        name = f"held/{batch_id:012d}"
        held.unionByName(new).write.mode("overwrite").parquet(f"{self.folder.path}/{name}-all")
        place = buffer_place(key, self.buffer, self.seed)
        there = self._rows(f"{name}-all")
        end = self._end(there.select(key.cast("long").alias("n")), start)
        part = f"rows/{batch_id:012d}"
        if end > start:
            self._write(there.filter(place < end), part)
        there.filter(place >= end).write.mode("overwrite").parquet(f"{self.folder.path}/{name}")
        self._commit({"batch": batch_id, "next": end, "held": name, "parts": [*last["parts"], part] if end > start else last["parts"]})
        self.folder.delete(f"{name}-all")
        if last["held"]:
            self.folder.delete(last["held"])

    def _write(self, rows: DataFrame, part: str) -> None:
        buffer_shuffled(rows, self.key, self.buffer, self.seed).write.mode("overwrite").json(f"{self.folder.path}/{part}")

    def finish(self) -> None:
        """Writes what the buffer still holds, when no more rows come. Rows behind a number that is missing stay held back."""
        last = self._last()
        part, name, key = f"rows/{last['batch']:012d}-end", f"held/{last['batch']:012d}-end", F.col(self.key)
        held = self._rows(last["held"])
        self._write(held.filter(key < last["next"]), part)
        held.filter(key >= last["next"]).write.mode("overwrite").parquet(f"{self.folder.path}/{name}")
        self.folder.put(f"commits/{last['batch']:012d}-end", last | {"held": name, "parts": [*last["parts"], part]})
        if last["held"]:
            self.folder.delete(last["held"])

    def _end(self, numbers: DataFrame, start: int) -> int:
        """The first number from ``start`` on that isn't there: one join on numbers, whatever the gaps."""
        if numbers.filter(F.col("n") == start).isEmpty():
            return start
        numbers = numbers.filter(F.col("n") >= start)  # rows that a buffer holds back may have smaller ones
        lone = numbers.join(numbers.select((F.col("n") - 1).alias("n")), "n", "left_anti")
        return lone.agg(F.min("n")).first()[0] + 1

    def _commit(self, state: dict) -> None:
        self.folder.put(f"commits/{state['batch']:012d}", state)

    def written(self) -> DataFrame:
        """What was written so far; sorted by ``key`` within and over the parts."""
        parts = self._last()["parts"]
        return self.spark.read.schema(self.schema).json([f"{self.folder.path}/{p}" for p in parts]) if parts else self._rows(None)

    def held(self) -> DataFrame:
        """What waits for a number that is missing."""
        return self._rows(self._last()["held"])


def write_in_order(rows: DataFrame, path: str, checkpoint: str, key: str = "_idx", first: int = 0, buffer: int = 1, seed: int = 0) -> StreamingQuery:
    """Append what has arrived to ``path`` in the order of ``key``, or shuffled with a buffer, and stop."""
    sink = OrderedSink(rows.sparkSession, path, rows.schema, key, first, buffer, seed)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
