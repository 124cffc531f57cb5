"""Session settings that the engine is tuned for, and tables written on the way."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "placewright", cpus: int | None = None, memory: str = "8g", shuffle: int | None = None) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle or cpus))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, for tables written on the way; on a local master without that setting, in a temporary folder.

    What is there is removed when the program ends.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="placewright-"))
        folder = context.getCheckpointDir()
    path = f"{folder}/placewright/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: it is computed once, its lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._placewright_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what kept() wrote."""
    path = getattr(df, "_placewright_path", None)
    if path is not None:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return
