"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows that reach Python carry whole blocks of samples, so batches must stay short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}

#: Whether a join asks for a partitioning by all of its keys.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan in this package relies on.

    Sizing (shuffle partitions, memory) is left to whoever submits the job.
    """
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = 8, app: str = "spanwave") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            configured = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "checkpoint")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so a lost executor costs a re-read only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For tables that several parts of a plan read: each reads the columns it needs. The files go when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return _staged(spark, spark.read.schema(df.schema).parquet(path), path)


def stage_bucketed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), *, buckets: int | None = None, dealt: bool = False
) -> DataFrame:
    """As ``stage``, in buckets of ``keys``: later groups, windows and joins on them (and more) need no shuffle.

    One shuffle, to one file a bucket; none for rows already ``dealt`` by the keys, whose plan may then
    join on the keys and more without a shuffle. The number of buckets is that of the session's shuffle
    partitions.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    rows = df if dealt else df.repartition(buckets, *keys)
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", path)
    writer = writer.bucketBy(buckets, *keys)
    if order:
        writer = writer.sortBy(*order)
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false" if dealt else before)
    try:
        writer.saveAsTable(name)
    finally:
        spark.conf.set(CO_PARTITION, before)
    return _staged(spark, spark.table(name), path)


def _staged(spark: SparkSession, read: DataFrame, path: str) -> DataFrame:
    read.staged_at = spark._jvm.org.apache.hadoop.fs.Path(path)
    read.staged_at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(read.staged_at)
    return read


def discard(*staged: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for frame in staged:
        frame.staged_at.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(frame.staged_at, True)
