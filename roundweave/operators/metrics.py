"""Metrics that are gathered batch by batch and read off at the end.

A metric is the mean of a score over rows. Its partial state is a count and a sum in decimals, so states can be
added up in any order and any grouping with the same result to the last digit, which sums of doubles don't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundweave.operators import stats

#: Scores keep this many digits behind the point.
SCORE, SUM = "decimal(28,15)", "decimal(38,15)"
STATE = f"metric string, n bigint, total {SUM}"


def partial_states(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """``metric, n, total``: what a batch adds to each metric. Null and NaN scores don't count; a metric without scores has n = 0."""
    # scores are costly and used several times, so each is a column before it is used
    named = [f"s{i}" for i in range(len(scores))]
    scored = rows.select(*(score.cast("double").alias(s) for s, score in zip(named, scores.values())))
    exact = scored.select(*(F.when(~F.isnan(s), F.col(s)).cast(SCORE).alias(s) for s in named))
    sums = exact.agg(*(F.struct(F.lit(name).alias("metric"), F.count(s).alias("n"), F.coalesce(F.sum(s), F.lit(0)).cast(SUM).alias("total")).alias(f"m{i}") for i, (name, s) in enumerate(zip(scores, named))))
    return sums.select(F.explode(F.array(*sums.columns)).alias("s")).select("s.*")


def merged(*states: DataFrame) -> DataFrame:
    """States added up by metric."""
    made = states[0]
    for s in states[1:]:
        made = made.unionByName(s)
    return made.groupBy("metric").agg(F.sum("n").alias("n"), F.sum("total").cast(SUM).alias("total"))


def results(states: DataFrame) -> DataFrame:
    """``metric, n, mean``; the mean of no scores is null."""
    return merged(states).select("metric", "n", F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n")).alias("mean"))


def accuracy(predicted: str = "predicted", labels: str = "labels") -> dict[str, Column]:
    """The scores of rows with token ids: the share of labels met, of those not ignored."""
    return {"accuracy": stats.masked_accuracy(F.col(predicted), F.col(labels))}


def similarity(predicted: str = "predicted", label: str = "label") -> dict[str, Column]:
    """The scores of rows with texts, in percent."""
    scores = stats.text_scores(F.col(predicted), F.col(label))
    return {"rouge-1": scores["rouge1"], "rouge-2": scores["rouge2"], "rouge-l": scores["rougel"], "bleu-4": scores["bleu4"]}


class MetricTable:
    """States of batches in a folder, one table for each epoch between two dumps.

    A batch is added under its number, and added again, as after a crash, it takes its own place. ``dump`` reads the metrics
    off and begins anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _epochs(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))

    def _rows(self, epoch: int) -> DataFrame:
        return self.spark.read.schema(f"{STATE}, batch bigint").option("recursiveFileLookup", False).parquet(f"{self.path}/epoch={epoch}")

    def epoch(self) -> int:
        """The epoch that batches are added to: the one after the last that was dumped."""
        return (self._epochs() or [0])[-1]

    def add(self, rows: DataFrame, scores: dict[str, Column], batch: int) -> None:
        partial_states(rows, scores).write.mode("overwrite").parquet(f"{self.path}/epoch={self.epoch()}/batch={batch}")

    def __call__(self, scores: dict[str, Column]):
        """A ``foreachBatch`` function that adds each batch of a stream."""
        return lambda rows, batch: self.add(rows, scores, batch)

    def result(self) -> DataFrame:
        """``metric, n, mean`` of what was added since the last dump."""
        epoch = self.epoch()
        if epoch not in self._epochs():
            return self.spark.createDataFrame([], "metric string, n bigint, mean double")
        return results(self._rows(epoch).drop("batch"))

    def dump(self) -> list[tuple[str, float | None]] | None:
        """Metrics and their means, one for each metric; None if nothing was added. What comes later is counted anew."""
        if not (found := sorted((r["metric"], r["mean"]) for r in self.result().collect())):
            return None
        empty = self.spark.createDataFrame([], STATE)
        empty.write.mode("overwrite").parquet(f"{self.path}/epoch={self.epoch() + 1}/batch=-1")
        return found
