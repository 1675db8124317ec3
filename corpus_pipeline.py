"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where
docs is what the stage before has kept, and returns a DataFrame. ``run`` writes
what each stage returns as Parquet to the shared folder and reads it again for the next
one, so that a lost executor costs no more than one stage. What a stage has kept for itself is deleted when it is
written, and its input with it. All stages but the last return the columns of documents.

1. toxicity: documents that score 0.7 or more go.
2. near_dedup: one document of each component of near-duplicates stays.
3. pii: personal data, and terms that reveal it, are replaced in the text.
4. mixing: documents are taken as often as the mix of sources says, in mixed order.
5. bpe: texts are encoded; ids and the text decoded from them are returned.

Edge cases are those of the operators; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roundweave.llm import bpe, mixing, near_dedup, pii, toxicity
from roundweave.llm.common import discard, saved, scratch, table
from roundweave.llm.queries import rank_file


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs, *rank_file(), keys=("doc_id", "source"))


STAGES = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("pii", _pii),
    ("mixing", _mixing),
    ("bpe", _bpe),
]

#: The stages learn weights, hash and encode, which SQL can't express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
