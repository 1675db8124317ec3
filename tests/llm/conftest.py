"""Odd documents that every operator must take."""

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, key string, id long, label int, size int, score double, node long, __id long, __hash string, __spans string, __found long, __key string, __row int, row int, hash string, spans int, found_id long, made string"


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [
        (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (5, long), (5, "another text with the same id as a long one"),
        (None, "a row without an id and with some words"), (None, None), (6, "ab"), (7, "é日😀 " * 30), (8, "+1 (936) 555-7063 a.b@c.example 10.0.0.1 4111111111111111"),
        (9, "same words again " * 40), (10, "same words again " * 40), (11, "x" * 5000),
    ]
    return [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None if t is None else len(t), "clash", None, 1, None, n, 0.5, None, 70 + n, f'h{n}', 'sp', n, None, n, n, 'h', n, None, 'm') for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 4 else i % 2, None if i % 5 == 0 else int(i % 3 == 0)) for i in range(1, 12)] + [(None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", F.col("text")).collect()}
