"""Sources and sinks of samples: JSON lines, JSON arrays and other files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from roundweave.operators.convert import converted
from roundweave.operators.index import SourceIndex, resampled

MESSAGES = "array<struct<role:string,content:string>>"
#: What training needs of a sample.
TRAINING_COLUMNS = ("messages", "images", "system")
#: Format of a file by its suffix.
FORMATS = {"jsonl": "json", "json": "json", "txt": "text", "csv": "csv", "parquet": "parquet", "orc": "orc", "arrow": "arrow"}
#: Bytes at the head of an Arrow file in which its schema is.
ARROW_HEAD = 1 << 20


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, bad_lines: str = "fail") -> DataFrame:
    """Rows of JSON lines; blank lines are passed over.

    ``bad_lines`` is ``fail`` (any is an error), ``skip``, or ``empty`` (any makes the
    result empty; a pass over the data finds out). A line is bad if it isn't JSON or doesn't fit the schema.
    """
    if bad_lines == "skip":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if bad_lines == "empty":
        kept = StructType([*rows.schema.fields, StructField("__bad", StringType())])
        lines = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", kept, {"columnNameOfCorruptRecord": "__bad"}).alias("r")).select("r.*")
        return rows if lines.filter("__bad IS NOT NULL").isEmpty() else spark.createDataFrame([], rows.schema)
    if bad_lines != "fail":
        raise ValueError(f"bad_lines can't be {bad_lines}")
    return rows


def read_indexed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines with ``_idx``, the number of their line from 0, over several files in the order of their names.

    Blank lines count but give no row; a line that isn't JSON is an error.
    """
    lines = with_numbers(spark.read.text(path), "text")
    return lines.filter("trim(value) <> ''").select("_idx", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("_idx", "r.*")


def read_arrow(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Rows of Arrow IPC files. Each is read whole by a task; without a ``schema`` the first file's head says it."""
    files = spark.read.format("binaryFile").load(path)
    if schema is None:
        head = bytes(files.orderBy("path").select(F.substring("content", 1, ARROW_HEAD)).first()[0])
        schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(head[8:] if head.startswith(b"ARROW1") else head)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                opened = pa.ipc.open_file(data) if data.slice(0, 6).to_pybytes() == b"ARROW1" else pa.ipc.open_stream(data)
                parts = (opened.get_batch(i) for i in range(opened.num_record_batches)) if hasattr(opened, "num_record_batches") else iter(opened)
                for part in parts:
                    yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in kinds], names=kinds.names)

    return files.select("content").mapInArrow(run, schema)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def format_of(path: str) -> str:
    """Format by suffix; parquet where the suffix says nothing."""
    return FORMATS.get(path.rsplit(".", 1)[-1].lower(), "parquet")


def file_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """Format of a file or a folder of files, by the suffix of the first, and the name that it follows from."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    name = path
    if fs.getFileStatus(hadoop).isDirectory():
        names = sorted(f.getPath().getName() for f in fs.listStatus(hadoop) if not f.getPath().getName().startswith(("_", ".")))
        name = names[0] if names else path
    return format_of(name), name


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file or a folder of files, by the suffix of the first."""
    fmt, name = file_format(spark, path)
    if fmt == "arrow":
        return read_arrow(spark, path, **options)
    if fmt == "csv":
        options = {"header": True} | options
    if fmt == "json" and not name.endswith("jsonl"):
        first = spark.read.text(path, wholetext=False).filter("trim(value) <> ''").first()
        options = {"multiLine": bool(first and first[0].lstrip().startswith("["))} | options
    return spark.read.format(fmt).options(**options).load(path)


def source_infos(where: str | dict[str, dict]) -> dict[str, dict]:
    """Infos of sources by name: a dict as it is, a local YAML or JSON file of them, or a path that is the only source.

    There is no hub here: what isn't a local file of infos is taken for data.
    """
    if isinstance(where, dict):
        return where
    suffix = where.rsplit(".", 1)[-1].lower()
    if suffix in ("yaml", "yml"):
        import yaml

        with open(where) as f:
            return yaml.safe_load(f) or {}
    if suffix == "json" and os.path.isfile(where):
        with open(where) as f:
            infos = json.load(f)
        if isinstance(infos, dict) and all(isinstance(i, dict) and "file_name" in i for i in infos.values()):
            return infos
    return {os.path.basename(where.rstrip("/")).split(".")[0]: {"file_name": where}}


#: Formats whose readers may count lines without parsing them.
LINES = ("json", "csv", "text")


def with_numbers(rows: DataFrame, fmt: str = "parquet", name: str = "_idx") -> DataFrame:
    """Rows just read from files with their number from 0: by the names of the files, and in the order of each file.

    Rows of a split are numbered in a row as they are read, so the number of a row follows from its split's first row and from how many rows
    the splits before have; no row is moved, and how files are split makes no difference. Rows of Arrow files, which aren't read in
    splits, are numbered in the order in which Spark reads the files.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    where = [F.lit(""), F.spark_partition_id().cast("long")] if fmt == "arrow" else [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    placed = rows.select(*columns, where[0].alias("__file"), where[1].alias("__split"), F.monotonically_increasing_id().alias("__line"))
    # the readers of lines pass over blank ones only where they parse them, so their columns have to be read here as well
    read = F.max(F.xxhash64(*columns)) if fmt in LINES else F.lit(0)
    counts = placed.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__line").alias("__first"), read.alias("__read")).filter("__read IS NOT NULL")
    before = Window.orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__file", "__split", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(starts, ["__file", "__split"]).select(*columns, (F.col("__line") + F.col("__shift")).alias(name))


def _of_split(infos: str | dict[str, dict], split: str) -> dict[str, dict]:
    """Infos of the sources of a split; one without a split is for training."""
    return {name: info for name, info in source_infos(infos).items() if info.get("split", "train") == split}


def load_sources(spark: SparkSession, infos: str | dict[str, dict], split: str = "train", seed: int = 0) -> dict[str, DataFrame]:
    """Sources of a split by name; an info has ``file_name`` and may have ``size`` (so many rows), ``weight`` (times as many), ``converter`` and ``split``.

    Sizes are met exactly, by rows at even distances in the order of the files; where a source has too few, some come more often than others, by one at most.
    """
    found = {}
    for name, info in _of_split(infos, split).items():
        rows = read_any(spark, info["file_name"])
        if info.get("size") is not None or info.get("weight") is not None:
            numbered = with_numbers(rows, file_format(spark, info["file_name"])[0], "__row")
            rows = resampled(numbered, "__row", numbered.count(), info.get("size"), info.get("weight"), seed, "__entry").drop("__row", "__entry")
        found[name] = converted(rows, info["converter"]) if info.get("converter") else rows
    return found


def load_index(spark: SparkSession, infos: str | dict[str, dict], split: str = "train", seed: int = 0) -> SourceIndex:
    """An index over the sources of a split, each with its size, weight and converter; one that asks to be streamed makes it a streaming one."""
    found = _of_split(infos, split)
    named = {name: with_numbers(read_any(spark, info["file_name"]), file_format(spark, info["file_name"])[0]) for name, info in found.items()}
    of = lambda what: {name: info[what] for name, info in found.items() if info.get(what) is not None}
    streaming = any_streaming(found)
    counts = {name: 0 if streaming else rows.count() for name, rows in named.items()}
    adjusted = ({}, {}) if streaming else (of("size"), of("weight"))
    return SourceIndex(named, "_idx", counts, *adjusted, seed, {name: partial(converted, name=way) for name, way in of("converter").items()}, streaming)


def any_streaming(infos: str | dict[str, dict]) -> bool:
    """Whether one of the sources asks to be streamed; then all are."""
    return any(bool(info.get("streaming")) for info in source_infos(infos).values())


def in_folder(paths: Column, media_dir: str | None, dataset_dir: str) -> Column:
    """Paths of media with the folder of relative ones in front: ``media_dir``, or that of the data."""
    root = (media_dir or dataset_dir).rstrip("/")
    return F.transform(paths, lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root + "/"), p)))


def kept_as(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """``rows`` from Parquet at ``path``; they are made and written there first if it isn't there, or is to be overwritten."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if overwrite or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_log(rows: DataFrame, path: str) -> DataFrame:
    """Log rows added to a folder of JSON lines, and all of it read again."""
    rows.write.mode("append").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A table of one row as text, a line ``name: value`` for each column."""
    lines = F.array_join(F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns)), "\n")
    rows.select(lines.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def training_view(rows: DataFrame) -> DataFrame:
    """Only the columns that training needs."""
    return rows.select(*(c for c in TRAINING_COLUMNS if c in rows.columns))


def write_ordered(rows: DataFrame, path: str, order: str = "_idx") -> None:
    """JSON lines in order: range-sorted, so file by file and line by line."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("errorifexists").json(path)


def write_with_errors(rows: DataFrame, path: str, errors: str, error: str = "error") -> None:
    """Rows without an error to one folder, the others (id and error) to another."""
    rows.filter(F.col(error).isNull()).drop(error).write.mode("append").json(path)
    rows.filter(F.col(error).isNotNull()).select("_idx", error).write.mode("append").json(errors)


def replace_if_clean(rows: DataFrame, bad: DataFrame, path: str) -> None:
    """Write rows beside ``path`` and put them in its place, only if there is no bad row.

    What was there is moved aside first and deleted last, and moved back if the new rows can't take its place; so a crash
    at any point leaves it at ``path`` or at ``path.old``.
    """
    spark = rows.sparkSession
    if not bad.isEmpty():
        raise ValueError("rows without a match: nothing was replaced")
    new, now, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path, f"{path}.old"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(now) and not fs.rename(old, now):  # left by a crash
        raise OSError(f"can't move {path}.old back")
    rows.write.mode("overwrite").json(f"{path}.new")
    fs.delete(old, True)
    there = fs.exists(now)
    if there and not fs.rename(now, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, now):
        if there:
            fs.rename(old, now)
        raise OSError(f"can't move {path}.new to {path}")
    fs.delete(old, True)


def write_changed(rows: DataFrame, path: str) -> None:
    """Only the rows in which rounds were pruned or merged."""
    rows.filter((F.coalesce("pruned", F.lit(0)) > 0) | (F.coalesce("merged", F.lit(0)) > 0)).write.mode("append").json(path)
