"""Writers for records and analysis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from pagescale.session import spread


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """JSON lines, CSV with header (missing values as ``Null``) or Parquet; ``mode`` decides about existing output."""
    if mode not in ("append", "overwrite", "errorifexists", "ignore"):
        raise ValueError(f"unknown mode {mode}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "json":
        writer.json(path)
    elif fmt == "csv":
        writer.option("header", True).option("nullValue", "Null").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


#: For one file a row on a local or mounted disk: without checksum files, whose modes cost three more processes a row.
#: They apply to the scheme file: only; other file systems are used as they are configured.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_texts(df: DataFrame, value: Column, path: str, by: str) -> None:
    """One text file a row, rows dealt to tasks by the hash of column `by`.

    Each task moves its own files into place (commit algorithm 2): with one file a row, moving them one by one in the
    driver takes longer than writing them. A task that runs again writes the same names.
    """
    rows = spread(df, by).select(value.cast("string").alias("value"))
    options = PLAIN_FILES | {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    rows.write.option("maxRecordsPerFile", 1).options(**options).text(path)
