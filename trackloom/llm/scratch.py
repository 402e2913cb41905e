"""Tables that cut lineage, kept in the folder all machines share.

The cluster names that folder in `spark.checkpoint.dir`.  Where the setting is
absent a fresh local folder takes its place in a local session, such as a test;
on a cluster its machines could not see each other's files, so it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that may go to every executor; more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Rows a file of a table of numbers, and of texts.
FILE_ROWS, FILE_TEXTS = 100_000, 25_000

#: Rows of text that Spark reads and hands to Python at once.  Its own settings (4096 and 10000) are made for
#: rows of a few numbers; with texts of kilobytes they fill the heap with arrays of tens of megabytes.
TEXT_BATCH = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}
_local: dict[str, str] = {}


def text_batches(spark: SparkSession) -> SparkSession:
    """The session, set to take rows of text in small batches; results do not depend on it."""
    for name, value in TEXT_BATCH.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all its machines share")
    if "here" not in _local:
        _local["here"] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return _local["here"]


class Scratch:
    """Written tables of one job.  A table stays until `drop`, so a lost executor costs only the tasks that read it."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None, least: int | None = None) -> DataFrame:
        """`df`, written and read again; with `rows`, about how many it has, in no more files than `few` gives."""
        if rows is not None:
            df = few(df, rows, least)
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


def few(df: DataFrame, rows: int, least: int | None = None, each: int | None = None) -> DataFrame:
    """`df` of about `rows` rows in partitions of `each` (FILE_ROWS) or more, but in `least` (three a core) if that is more: files of a few rows cost more than they hold."""
    least = 3 * df.sparkSession.sparkContext.defaultParallelism if least is None else least
    return df.coalesce(max(least, -(-rows // (each or FILE_ROWS))))


def bounded(df: DataFrame, work: Scratch, name: str, rows: int | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df`, written, and what to do with it in a join: broadcast it if it has at most BROADCAST_ROWS rows, else nothing."""
    df = work.save(df, name, rows=rows, least=1)
    return df, F.broadcast if df.count() <= BROADCAST_ROWS else lambda x: x
