"""Incremental forms: scoring in restartable batches, pending ids, running minima and running bin counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagescale.functions import text as X
from pagescale.operators.aggregates import bin_index
from pagescale.operators.metrics import score_pairs


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int = 4) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True).parquet(path)
    )


def _per_batch_writer(path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch owns its folder: a batch that is repeated after a failure replaces its own output.
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def stream_score(pairs: DataFrame, out: str, checkpoint: str, with_bleu: bool = True) -> StreamingQuery:
    """Score new pairs batch by batch; results appear after every batch and a restart goes on where it stopped."""
    return (
        pairs.writeStream.foreachBatch(_per_batch_writer(out, lambda b: score_pairs(b, with_bleu=with_bleu)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_metrics_checkpointed(scores: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished metric rows of a stream at every batch."""
    return (
        scores.writeStream.foreachBatch(_per_batch_writer(out, lambda b: b)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_pending(ids: DataFrame, out: str, checkpoint: str, event_time: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Every id once. With an arrival time the memory of seen ids ends after the delay."""
    seen = ids.dropDuplicates(["id"]) if event_time is None else ids.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id"])
    return (
        seen.writeStream.foreachBatch(_per_batch_writer(out, lambda b: b)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_best_shift(metrics: DataFrame) -> DataFrame:
    """Least edit distance per unshifted id so far."""
    return metrics.groupBy(X.strip_shift_suffix(F.col("id")).alias("base_id")).agg(
        F.min(F.struct("edit_dist", "id", "text_len")).alias("b"), F.count("*").alias("n_shifts")
    ).select("base_id", F.col("b.id").alias("best_id"), F.col("b.edit_dist").alias("edit_dist"), F.col("b.text_len").alias("text_len"), "n_shifts")


def stream_best_shift(metrics: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed minima per batch; readers keep the row of the highest ``batch_id`` per base id."""
    return (
        running_best_shift(metrics).writeStream.outputMode("update").foreachBatch(_per_batch_writer(out, lambda b: b))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def running_bin_counts(points: DataFrame, width: int = 100) -> DataFrame:
    return points.groupBy("resolution", bin_index("text_len", width).alias("bin")).agg(F.count("*").alias("n"), F.avg("edit_distance").alias("mean_ed"))


def stream_bin_counts(points: DataFrame, out: str, checkpoint: str, width: int = 100) -> StreamingQuery:
    """Changed bins per batch with their running count and mean."""
    return (
        running_bin_counts(points, width).writeStream.outputMode("update").foreachBatch(_per_batch_writer(out, lambda b: b))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last written row of every key of an update stream."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_r")).select(*keys, "_r.*")
