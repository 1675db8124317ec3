"""Queries over whole texts: nothing of a turn is cut, whatever its length and script."""

import duckdb
import pytest

from roundweave.plans import ORACLES, QUERIES
from tests.conftest import same_rows

#: Queries over tagged turns, replies and traces.
TAGGED = """conv_stats tag_parse canonical_turn evict_rounds merge_messages rephrase_merge merge_images drop_images critical_path_status critical_path_messages
grounding status_counts first_examples reduction_summary saved_hist multi_tag_rate question_text tool_calls clean_messages reply_parts trace_rollup
judge_accuracy first_truthy label_clean lenient_json call_normalise trace_turns trace_repairs role_check role_repair patch_counts
training_rows streamed_turns changed_rows""".split()
LONG = "Ärger im Süden: 日本語のテキスト 😀\nnext line\twith a tab, 12.5% " * 20 + "Zürich North Lake 1987 the end"


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    rows = []
    for conv in range(24):
        rows += [(conv, 0, "system", "s")] if conv % 2 else []
        rows += [(conv, k + conv % 2, "assistant" if k % 2 else "user", f"{LONG} {conv} {k}") for k in range(2 * (1 + conv % 4) + conv % 2)]
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def test_all_characters_count(spark, long_turns):
    folder, rows = long_turns
    least = {}
    for conv, _, role, text in rows:
        least[conv] = least.get(conv, 0) + (role != "system") * len(text)
    assert all(r["total_chars"] > least[r["conv_id"]] for r in QUERIES["conv_stats"](spark, folder).collect())
    for name, column in (("question_text", "question"), ("reply_parts", "think")):
        assert all("the end" in r[column] and "日本語のテキスト 😀\nnext" in r[column] for r in QUERIES[name](spark, folder).collect() if r[column] != "s")


@pytest.mark.parametrize("name", TAGGED)
def test_whole(spark, long_turns, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{long_turns[0]}/conversations.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, long_turns[0]).toPandas(), db.sql(ORACLES[name]).df())
