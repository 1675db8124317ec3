"""A local session whose Python workers find the package."""

import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(SF):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return db


def same_rows(ours, theirs):
    """Whether two pandas frames have the same columns and, in any order, the same rows."""
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def plain(frame):
        cells = frame[columns].astype(object).where(frame[columns].notna(), None)
        return cells.map(lambda x: str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)).sort_values(columns).reset_index(drop=True)

    a, b = plain(ours), plain(theirs)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head().to_string()
