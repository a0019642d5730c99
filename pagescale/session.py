"""Session helpers: local sessions for tests and the shared scratch folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: set[str] = set()


def local_session(app: str = "pagescale", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; cluster jobs bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    root = os.path.join(tempfile.gettempdir(), f"pagescale-{spark.sparkContext.applicationId}")
    os.makedirs(root, exist_ok=True)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    last = f"{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.add(last)
    return f"{shared_dir(spark).rstrip('/')}/{last}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step as a Parquet table in the shared folder and read it back: survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meet(rows: DataFrame, groups: DataFrame, keys: list[str] | tuple[str, ...], how: str = "inner") -> DataFrame:
    """Rows with the row of their group. The group table is written first, so that its size is known when the join is planned.

    Below the session's broadcast threshold no row moves, however many rows a group has. Above it the join shuffles, and
    the adaptive planner splits what a hot group makes too large.
    """
    return rows.join(cut_lineage(groups, "groups"), list(keys), how)


def discard(df: DataFrame) -> None:
    """Delete a step written by `cut_lineage`, once everything that reads it is written itself. Other tables stay."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard_path(spark, path)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a path that `scratch_path` gave; any other path stays."""
    if path.rsplit("/", 1)[-1] in _SCRATCH:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now; else they stay until the driver's heap next runs full."""
    spark._jvm.System.gc()


def scratch_names() -> set[str]:
    """The last parts of all scratch paths of this process."""
    return set(_SCRATCH)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the configured number of shuffle partitions before costly row-local work.

    The explicit number keeps the adaptive planner from merging partitions that are small in bytes but long in work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_few(df: DataFrame, *keys: str) -> DataFrame:
    """The rows as they are read, where the input has a split for every core; only a table of fewer splits is spread."""
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return spread(df, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
