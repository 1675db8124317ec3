"""The pipeline: every stage against a plain version of what it keeps."""

from collections import Counter

import corpus_pipeline
from roundweave.llm import mixing, near_dedup, pii, toxicity
from roundweave.llm.common import saved, shared_dir, table
from tests.conftest import SF
from tests.llm.test_documents import plain_near


def test_stages(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(saved(stage(spark, seen[-1], SF), name))
    raw, clean, single, private, mixed, encoded = seen
    assert all(x.columns == columns for x in seen[:5])
    toxic = {r["doc_id"] for r in toxicity.toxicity(raw, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in raw.collect()} - toxic
    near = plain_near({r["doc_id"]: r["text"] or "" for r in clean.collect()})
    assert {r["doc_id"] for r in single.collect()} == {k for k, v in near.items() if v[2]}
    assert pii.personal_data(private).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert private.count() == single.count()
    times = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(private.select("doc_id", "source", mixing.word_count(private["text"]).alias("size"))).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == {k: n for k, n in times.items() if n}
    assert Counter((r["doc_id"], r["decoded"]) for r in encoded.collect()) == Counter((r["doc_id"], r["text"]) for r in mixed.collect())


def test_run(spark):
    first, again = (corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens") for _ in range(2))
    assert first.count() and sorted(first.collect()) == sorted(again.collect())


def test_empty(spark):
    docs, labels = table(spark, SF, "documents").limit(0), SF
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, labels)
    assert docs.count() == 0 and near_dedup.WORDS == 5


def test_odd_rows_go_through_all_stages(spark, odd, labels, tmp_path):
    """Nulls, equal rows, long texts and columns with clashing names, through the whole chain."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd.columns
    mixed = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in last) == mixed and 0 < sum(mixed.values()) <= 30


def test_what_stages_keep_is_deleted(spark):
    """Of a run only the input of its last stage stays in the shared folder."""
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count()
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["mixing"]
