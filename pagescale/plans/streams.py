"""Queries on the incremental forms, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale.plans import fixtures as fx
from pagescale.plans import scoring  # noqa: F401  (registers the batch form)
from pagescale.plans.alignment import SHIFTED, _shifted_metrics
from pagescale.plans.catalog import ORACLES, query, rounded
from pagescale.session import scratch_path
from pagescale.streaming import incremental as O


def _as_stream(spark, df, parts: int = 6, files_per_batch: int = 2):
    """The rows of a table as a stream of files."""
    path = scratch_path(spark, "in")
    df.repartition(parts).write.parquet(path)
    return O.file_stream(spark, path, df.schema, files_per_batch=files_per_batch)


def _paths(spark):
    return scratch_path(spark, "out"), scratch_path(spark, "ckpt")


@query("str1_stream_score")
def score(spark, d):
    out, ckpt = _paths(spark)
    pairs = fx.ocr_blocks(spark, d).select("id", "prediction", "ground_truth")
    O.stream_score(_as_stream(spark, pairs), out, ckpt).awaitTermination()
    return rounded(spark.read.parquet(out).drop("batch_id"))


ORACLES["str1_stream_score"] = ORACLES["met7_score_pairs"]  # a stream gives the rows of the batch

@query("str2_stream_pending", "SELECT o_custkey AS id, count(*) OVER () AS n_ids FROM (SELECT DISTINCT o_custkey FROM orders)")
def pending(spark, d):
    out, ckpt = _paths(spark)
    O.stream_pending(_as_stream(spark, fx.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))), out, ckpt).awaitTermination()
    got = spark.read.parquet(out).select("id")
    return got.join(F.broadcast(got.agg(F.count("*").alias("n_ids"))))  # one row


@query(
    "str3_stream_best_shift",
    f"""SELECT regexp_replace(id, '^(.+)_\\d+_\\d+$', '\\1') AS base_id, (min({{'e': edit_dist, 'i': id, 't': text_len}})).i AS best_id, min(edit_dist) AS edit_dist, min(text_len) AS text_len, count(*) AS n_shifts FROM ({SHIFTED}) GROUP BY 1""",
)
def best(spark, d):
    out, ckpt = _paths(spark)
    O.stream_best_shift(_as_stream(spark, _shifted_metrics(spark, d)), out, ckpt).awaitTermination()
    return O.latest(spark, out, ["base_id"])


@query("str4_stream_bin_counts", "SELECT resolution, CAST(text_len//100 AS BIGINT) AS bin, count(*) AS n, round(avg(edit_distance)+1e-9, 6) AS mean_ed FROM analysis_points GROUP BY ALL")
def bins(spark, d):
    out, ckpt = _paths(spark)
    pts = fx.analysis_points(spark, d).select("resolution", "text_len", "edit_distance")
    O.stream_bin_counts(_as_stream(spark, pts), out, ckpt).awaitTermination()
    return rounded(O.latest(spark, out, ["resolution", "bin"]), "mean_ed")


@query("src8_write_metrics_checkpointed", "SELECT id, resolution, text_len, text_token_len, edit_dist FROM metric_records")
def checkpointed(spark, d):
    out, ckpt = _paths(spark)
    O.write_metrics_checkpointed(_as_stream(spark, fx.metric_records(spark, d), parts=8), out, ckpt).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query("str2_stream_pending_event_time", "SELECT DISTINCT user_id AS id FROM events")
def pending_events(spark, d):
    """Ids of the event table once each, with a bounded memory of seen ids; the input is read in time order."""
    out, ckpt = _paths(spark)
    events = fx.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "events")
    events.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(path)
    ev = O.file_stream(spark, path, events.schema, files_per_batch=2).select(F.col("user_id").alias("id"), "ts")
    O.stream_pending(ev, out, ckpt, event_time="ts", delay="3650 days").awaitTermination()
    return spark.read.parquet(out).select("id")
