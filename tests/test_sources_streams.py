"""Readers, writers and restartable streams on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale import schema as S
from pagescale.functions.registry import register_functions
from pagescale.operators.joins import best_per_key
from pagescale.operators.metrics import score_pairs
from pagescale.session import shared_dir, spread
from pagescale.sources import files, sinks
from pagescale.streaming import incremental as I

REC = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


SF = "/root/testdata/sf0.001"


def test_records_of_both_roots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, 3, "s", None, {"id": "y"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"k1": {"id": "z", "n": 5}, "k2": [1]}))
    (tmp_path / "c.json").write_text('[{"id": ')
    (tmp_path / "d.json").write_text("[]")
    got = {(r.id, r.n) for r in files.read_records(spark, str(tmp_path), REC).collect()}
    assert got == {("x", 1), ("y", None), ("z", 5)}
    bad = {r.path.rsplit("/", 1)[1]: (r.unreadable, r.n_stray) for r in files.bad_records(spark, str(tmp_path)).collect()}
    assert bad == {"a.json": (False, 3), "b.json": (False, 1), "c.json": (True, 0), "d.json": (False, 0)}


def test_metric_tree(spark, tmp_path):
    for ds, res, n in (("laws", "512", 2), ("laws", "1024", 1), ("med", "512", 3), ("med", "old", 4)):
        p = tmp_path / f"{ds}_square" / res
        p.mkdir(parents=True)
        (p / "metric.json").write_text(json.dumps([{"id": f"i{i}", "edit_dist": 0.1 * i, "text_len": i} for i in range(n)]))
    got = {(r.dataset, r.resolution): r["count"] for r in files.read_metric_tree(spark, str(tmp_path)).groupBy("dataset", "resolution").count().collect()}
    assert got == {("laws", 512): 2, ("laws", 1024): 1, ("med", 512): 3}


def test_corpus_predictions_images(spark, tmp_path):
    (tmp_path / "book.txt").write_text("﻿line\nmore", encoding="utf-8")
    assert files.read_corpus(spark, str(tmp_path / "book.txt")).first().text == "line\nmore"
    (tmp_path / "p_1.md").write_text("# t")
    (tmp_path / "p_2.md").write_text("x\n\ny")
    assert {(r.id, r.markdown) for r in files.read_predictions(spark, str(tmp_path)).collect()} == {("p_1", "# t"), ("p_2", "x\n\ny")}
    (tmp_path / "im").mkdir()
    for n in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / "im" / n).write_bytes(b"123")
    assert {(r.id, r.length) for r in files.list_images(spark, str(tmp_path / "im")).collect()} == {("a", 3), ("b", 3)}


def test_csv_null_and_modes(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "image_id string, edit_distance double")
    out = str(tmp_path / "t")
    sinks.write_records(df, out, "csv")
    with pytest.raises(Exception):
        sinks.write_records(df, out, "csv")
    sinks.write_records(df, out, "csv", mode="append")
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert text.count("Null") == 2
    back = files.read_analysis_csv(spark, out, df.schema)
    assert back.count() == 4 and back.where("edit_distance is null").count() == 2
    with pytest.raises(ValueError):
        sinks.write_records(df, out, "csv", mode="replace")


def test_assert_columns(spark):
    with pytest.raises(ValueError, match="b"):
        S.assert_columns(spark.range(1).toDF("a"), ["a", "b"])


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stream_score_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = [(f"i{i}", "the cat " * i, "the hat " * i) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, prediction string, ground_truth string")
    df.where("id < 'i5'").repartition(3).write.parquet(src)
    run = lambda: I.stream_score(I.file_stream(spark, src, df.schema, files_per_batch=1), out, ck).awaitTermination()
    run()
    first = spark.read.parquet(out).count()
    run()  # nothing new
    assert spark.read.parquet(out).count() == first
    df.where("id >= 'i5'").repartition(2).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(out).drop("batch_id").orderBy("id").collect()
    assert got == score_pairs(df).orderBy("id").collect()


def test_stream_forms_equal_batch(spark, tmp_path):
    rows = [(f"p_{i % 5}_{i}_0", 100 + i, (i * 37 % 100) / 100) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text_len int, edit_dist double")
    src = str(tmp_path / "src")
    df.repartition(5).write.parquet(src)
    stream = lambda: I.file_stream(spark, src, df.schema, files_per_batch=2)
    I.stream_best_shift(stream(), str(tmp_path / "b"), str(tmp_path / "bc")).awaitTermination()
    key = lambda d: sorted(map(tuple, d.select("base_id", "best_id", "edit_dist", "n_shifts").collect()))
    assert key(I.latest(spark, str(tmp_path / "b"), ["base_id"])) == key(best_per_key(df))
    pts = stream().select(F.lit(512).alias("resolution"), "text_len", F.col("edit_dist").alias("edit_distance"))
    I.stream_bin_counts(pts, str(tmp_path / "h"), str(tmp_path / "hc"), width=20).awaitTermination()
    batch = I.running_bin_counts(df.select(F.lit(512).alias("resolution"), "text_len", F.col("edit_dist").alias("edit_distance")), 20)
    got = {(r.bin, r.n): r.mean_ed for r in I.latest(spark, str(tmp_path / "h"), ["resolution", "bin"]).collect()}
    assert got == pytest.approx({(r.bin, r.n): r.mean_ed for r in batch.collect()})
    twice = stream().select(F.regexp_extract("id", "^(p_[0-9])", 1).alias("id"))
    I.stream_pending(twice, str(tmp_path / "p"), str(tmp_path / "pc")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [f"p_{i}" for i in range(5)]


def test_sql_functions(spark):
    names = register_functions(spark)
    assert "ocr_edit_dist" in names
    row = spark.sql(
        "SELECT ocr_edit_dist('abc','abd') e, md_to_text('# a\n- [b](c)') m, roman_to_int('XIV') r, tile_grid(1000, 500) t, image_tokens(600, 600) s, "
        "image_tokens(1000, 500) b, split_sentences('A. B? c') ss, strip_fences('```x\nq\n```') f, has_cjk('頁') h, strip_shift_suffix('a_1_2') p, "
        "file_stem('/x/y.tar.gz') st, information_density(2.0D, 28, 6, 0) d, vision_tokens(512) v"
    ).first()
    assert row.e == pytest.approx(1 / 3) and row.m == "a b" and row.r == 14 and (row.t.cols, row.t.rows) == (2, 1)
    assert row.s == 273 and row.b == 273 + 10 * 21 and row.ss == ["A.", "B?", "c"] and row.f == "q" and row.h and row.p == "a" and row.st == "y.tar"
    assert row.d == pytest.approx(2 * 14.0533 * 26 / (14.0533 * 32)) and row.v == 64.0


def test_tables_with_splits_enough_are_not_shuffled(spark, tmp_path):
    from pagescale.plans import fixtures as fx

    one = spark.read.parquet(f"{SF}/documents.parquet")
    assert "Exchange" in fx.documents(spark, SF)._jdf.queryExecution().executedPlan().toString()
    one.repartition(32).write.parquet(str(tmp_path / "documents.parquet"))
    many = fx.documents(spark, str(tmp_path))
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString() and many.count() == one.count()


def test_steps_are_deleted_and_other_tables_stay(spark, tmp_path):
    import os

    from pagescale.session import cut_lineage, discard, meet

    step = cut_lineage(spark.range(5).withColumnRenamed("id", "k"))
    path = step.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(path) and meet(spark.range(3).withColumnRenamed("id", "k"), step, ["k"]).count() == 3
    discard(step)
    assert not os.path.exists(path)
    spark.range(2).write.parquet(str(tmp_path / "own"))
    discard(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 2


def test_texts_are_written_by_many_tasks(spark, tmp_path):
    texts = [(str(i), f"# t{i}\n\nx") for i in range(40)] + [("40", None), (None, "no id"), ("1", "twice")]
    rows = spark.createDataFrame(texts, "id string, md string").coalesce(1)
    sinks.write_texts(rows, F.col("md"), str(tmp_path / "md"), by="id")
    names = [p.name for p in (tmp_path / "md").iterdir() if p.name.startswith("part-")]
    assert len(names) == len(texts) and len({n.split("-")[1] for n in names}) > 1
    assert not any(p.name.endswith(".txt.crc") for p in (tmp_path / "md").iterdir())
    got = sorted(r.markdown for r in files.read_predictions(spark, str(tmp_path / "md"), glob="*.txt").collect())
    assert got == sorted((t or "") + "\n" for _, t in texts)
