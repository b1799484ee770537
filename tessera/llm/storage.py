"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's. If neither is set, a local session gets a
    temporary folder; on a cluster that is an error, since executors don't share one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{tempfile.gettempdir()}/tessera-checkpoints"
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


_tables: dict[str, SparkSession] = {}


def tables_now() -> set[str]:
    """Paths of the tables written so far, for remove_tables()."""
    return set(_tables)


def remove_tables(before: set[str], keep: list[DataFrame]) -> None:
    """Removes tables written since, but for those that the DataFrames in keep read."""
    needed = {f for d in keep for f in d.inputFiles()}
    for path in set(_tables) - before:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in needed):
            _remove(_tables.pop(path), path)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, found again by
    tasks that run anew, and its columns can be pruned. Removed when Python ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(lambda: [_remove(s, p) for p, s in _tables.items()])
    _tables[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
