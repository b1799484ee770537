"""Session settings for large runs, and checks of plans."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Partitions near 128 MB in and out; joins and skew are left to runtime statistics.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def tuned(spark: SparkSession, input_bytes: int | None = None, **more: str) -> SparkSession:
    """Applies SETTINGS; shuffle partitions follow the input, 128 MB each."""
    for k, v in {**SETTINGS, **more}.items():
        spark.conf.set(k, v)
    if input_bytes:
        spark.conf.set("spark.sql.shuffle.partitions", str(max(8, -(-input_bytes // (128 << 20)))))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's. If neither is set, a local session gets a
    temporary folder; on a cluster that is an error, since executors don't share one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{tempfile.gettempdir()}/tessera-checkpoints"
    return path.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> None:
    """Sets the context's checkpoint folder where it isn't set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df: DataFrame) -> int:
    """Shuffles of the plan, without broadcasts."""
    return len(re.findall(r"\n\(\d+\) Exchange", plan(df)))


def scanned_columns(df: DataFrame) -> set[str]:
    return {c.split(":")[0].strip() for s in re.findall(r"ReadSchema: struct<(.*?)>", plan(df)) for c in re.sub(r"<[^<>]*>", "", s).split(",") if c}


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", plan(df))


def python_nodes(df: DataFrame) -> list[str]:
    return re.findall(r"\n\(\d+\) (\w*(?:Python|Pandas|Arrow)\w*)", plan(df))
