"""The pipeline's stages: columns, decisions that take effect, and intermediates that go with the stage after."""

import os

import corpus_pipeline
from pagescale.llm import setsketch
from pagescale.session import scratch_names, shared_dir

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, previous, sizes = docs.columns, set(), [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = scratch_names()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        # what the stage before wrote in between is gone, what this one wrote may stay until the next
        assert not any(os.path.exists(f"{shared_dir(spark)}/{x}") for x in previous)
        previous = scratch_names() - before
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        assert docs.columns == columns or name == "mixing"
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3]
    kept = spark.read.parquet(str(tmp_path / "minhash_near_dedup"))
    again = setsketch.groups(kept.select("doc_id", "text"), words=5, percent=80)
    assert again.where("id <> component").isEmpty()  # no pair of near copies is left
    changed = spark.read.parquet(str(tmp_path / "line_dedup"))
    assert changed.where("n_chars <> length(text)").count() == spark.read.parquet(str(tmp_path / "toxicity")).where("n_chars <> length(text)").count()
    order = [r.position for r in docs.orderBy("position").collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
