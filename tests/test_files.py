"""Queries through files on rows that lines and formats could lose: nulls, line ends, quotes, repeated rows, an empty table."""

import duckdb
import pytest

from roundweave.plans import ORACLES, QUERIES
from tests.conftest import same_rows

DOCUMENTS = "jsonl_strict jsonl_skip jsonl_all_or_nothing ordered_lines replaced_folder formats_by_suffix kept_tokens".split()
TEXTS = ["plain", "", None, "line\nend", "carriage\rreturn   and \x85", 'quote " and \\ slash, comma', "日本語 😀", "  blanks  ", "\t"]


def _rows(kind):
    if kind == "empty":
        return []
    return [(i, None if i % 4 == 1 else f"src{i % 3}, \"x\"", None if i % 5 == 2 else "en", len(t or ""), t) for i, t in enumerate(TEXTS * 3)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    spark.createDataFrame(_rows(request.param), "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", DOCUMENTS)
def test_odd_documents(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    theirs = db.sql(ORACLES[name]).df()
    if name == "jsonl_all_or_nothing":
        theirs = theirs.fillna(0)  # no row, no sum
    same_rows(QUERIES[name](spark, folder).toPandas(), theirs)


def test_more_splits_than_lines_of_one(spark, folder):
    """Numbers of lines don't depend on how the files are cut."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = sorted((r["_idx"], r["doc_id"]) for r in QUERIES["ordered_lines"](spark, folder).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [i for i, _ in got] == list(range(len(got))) and [d for _, d in got] == sorted(d for _, d in got)
