"""Session settings that the engine expects of a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Results do not depend on these; they keep joins and partitions in good shape as data grows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streams with state of many keys, timers and maps need a store on disk.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "trackloom", **settings: str) -> SparkSession:
    """A session with the settings above, and others by name (dots written as two underscores)."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one in spark.checkpoint.dir; without it a local one, in a local session only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all its machines share")
    if "here" not in _local:
        _local["here"] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return _local["here"]


def checkpoints(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: the shared one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read from there on."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
