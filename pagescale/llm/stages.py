"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame. All but the last return the columns of `docs`."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.llm import curriculum, latent, line_templates, setsketch, toxicity
from pagescale.session import discard_path, scratch_names, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_WRITTEN: dict[tuple[str, str], set[str]] = {}


def after(previous: str | None) -> Callable[[Stage], Stage]:
    """A stage that begins by deleting the intermediate tables of the stage before it.

    That one's result is written by then, so nothing reads them; tables that `docs` still reads stay. At any time the
    shared folder therefore holds the intermediates of one stage.
    """

    def wrap(stage: Stage) -> Stage:
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            done = _WRITTEN.pop((sf_dir, previous or ""), set())
            read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()} if done else set()
            for name in done - read:
                discard_path(spark, f"{shared_dir(spark).rstrip('/')}/{name}")
            before = scratch_names()
            out = stage(spark, docs, sf_dir)
            _WRITTEN[sf_dir, stage.__name__] = scratch_names() - before
            return out

        return run

    return wrap


@after(None)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model does not find toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@after("drop_toxic")
def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur over different documents; `n_chars` follows the text."""
    out = line_templates.drop_recurring(docs)
    out = out.withColumn("n_chars", F.when(F.col("dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@after("drop_recurring_lines")
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id. Five words, similarity 0.8."""
    found = setsketch.groups(docs.select("doc_id", "text"), words=5, percent=80)
    gone = found.where(F.col("id").isNotNull() & (F.col("id") != F.col("component"))).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@after("keep_one_of_each_group")
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return latent.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@after("drop_contaminated")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row for each reading of a document, with its words and position."""
    return curriculum.mix(docs)
