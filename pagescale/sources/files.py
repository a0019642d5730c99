"""Readers: corpora, record files, metric trees, analysis tables, predictions and image listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale import schema as S
from pagescale.functions import text as X


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file, byte-order marks removed."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumn("text", X.remove_bom(F.col("text")))


def _items(value: Column) -> Column:
    """Raw items of a JSON list or of the values of a JSON object; NULL when the file does not parse."""
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(
        F.map_values(F.from_json(value, "map<string,string>"))
    )


def read_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Records of JSON files whose root is a list of objects or an object of objects.

    Items that are not objects and files that do not parse give no rows; :func:`bad_records` counts them. A file with
    one list is read as a whole; for record-per-line files use :func:`read_record_lines`, which splits.
    """
    paths = [path] if isinstance(path, str) else list(path)
    items = spark.read.text(paths, wholetext=True).select(F.explode(_items(F.col("value"))).alias("i"))
    return items.where(F.ltrim("i").startswith("{")).select(F.from_json("i", schema).alias("r")).select("r.*")


def bad_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per file: whether it failed to parse and how many items are not objects."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), _items(F.col("value")).alias("i"))
    stray = F.size(F.filter("i", lambda x: ~F.coalesce(F.ltrim(x).startswith("{"), F.lit(False))))
    return raw.select("path", F.col("i").isNull().alias("unreadable"), F.when(F.col("i").isNull(), 0).otherwise(stray).alias("n_stray"))


def read_record_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records from files with one JSON object per line, which split across tasks."""
    return spark.read.schema(schema).json(path)


def read_metric_tree(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """All ``<dataset>_square/<resolution>/*.json`` records; data set and resolution come from the path.

    Folders whose name is not a number are ignored. Folder names may be written as ``column=name``, as a partitioned
    write leaves them. ``lines`` reads files with one record per line, which split.
    """
    rows = (
        spark.read.schema(S.METRIC_RECORDS).option("multiLine", not lines).json(f"{root.rstrip('/')}/*_square/*/*.json")
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    part = lambda i: F.regexp_extract("_path", r"/(?:[^/=]+=)?([^/=]+)_square/(?:[^/=]+=)?([^/=]+)/[^/]+$", i)
    return (
        rows.withColumn("dataset", part(1)).withColumn("_res", part(2)).where(F.col("_res").rlike(r"^\d+$"))
        .withColumn("resolution", F.col("_res").cast("int")).drop("_path", "_res")
    )


def read_analysis_csv(spark: SparkSession, path: str, schema: T.StructType = S.ANALYSIS_POINTS) -> DataFrame:
    """Analysis table with header; ``Null`` marks a missing value."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "Null").csv(path)


def read_predictions(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """One Markdown file per image; the file stem is the image id."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(X.file_stem(F.col("_metadata.file_name")).alias("id"), F.col("value").alias("markdown"))


def list_images(spark: SparkSession, path: str, extensions: Sequence[str] = ("jpg", "jpeg", "png")) -> DataFrame:
    """Image files with id and size in bytes; contents are never read."""
    any_case = "|".join(e.lower() for e in extensions)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return listing.where(F.lower("path").rlike(rf"\.({any_case})$")).select(X.file_stem(F.col("path")).alias("id"), "path", "length")
