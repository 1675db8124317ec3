"""Row-wise operators over streams of conversation turns and samples.

A file stream of JSON lines takes the same functions as a batch; what needs all
turns of a conversation waits for them in a window that a watermark closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roundweave.functions import text as T


def read_samples(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def canonical_turns(turns: DataFrame) -> DataFrame:
    """Turns with their text in canonical form; works on batches and streams."""
    c = F.col("text")
    return turns.withColumn("text", F.when(F.col("role") == "assistant", T.canonical_assistant(c)).otherwise(T.canonical_user(c)))


def conversations(turns: DataFrame, time: str, delay: str, gap: str) -> DataFrame:
    """Conversations out of a stream of turns: a session of turns closes after a gap, once the watermark is past it."""
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.withWatermark(time, delay).groupBy(F.session_window(time, gap), "conv_id").agg(listed.alias("turns"))


def event_counts(events: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Counts and sums of events by type in tumbling windows; late events are dropped behind the watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, and stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
