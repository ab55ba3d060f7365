"""Shared helpers: stage tables in the shared folder, plain column picking, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only for a local master without one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "checkpoint"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later plans read the files, so a lost executor costs a re-read. The files go when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_at = where
    return read


def discard(*staged: DataFrame) -> None:
    """Delete stage tables that nothing reads any more, and let Spark drop the shuffle files of finished plans."""
    spark = staged[0].sparkSession
    for frame in staged:
        frame.staged_at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(frame.staged_at, True)
    spark._jvm.System.gc()


def as_bytes(column: Column | str) -> Column:
    """Text as UTF-8 bytes; null becomes empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b"").cast("binary"))


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed(df: DataFrame, *lost: str) -> Column:
    """All columns but ``lost`` as one struct, so that none can clash with a column of an operator."""
    names = without_names(df, *lost)
    return F.struct(*([quoted(c).alias(c) for c in names] or [F.lit(0).alias("none")]))


def unpacked(df: DataFrame, given: Column, *lost: str) -> list[Column]:
    """The columns that ``packed`` put into ``given``."""
    return [given.getField(c).alias(c) for c in without_names(df, *lost)]


def with_fields(rows: DataFrame, fields: str) -> T.StructType:
    """The schema of ``rows`` less its last column, with ``fields`` after it."""
    return T.StructType(rows.schema.fields[:-1] + T.StructType.fromDDL(fields).fields)


def without_names(df: DataFrame, *names: str) -> list[str]:
    lost = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in lost]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names clash with ``names``, whatever their case."""
    return df.select(*[quoted(c) for c in without_names(df, *names)])


def list_of(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different numbers of an array, in order. ``np.unique`` alone hashes them, which takes many times longer."""
    values = np.sort(values, axis=None)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def numbers(batch: pa.RecordBatch, name: str, dtype: str = "int64") -> np.ndarray:
    """A numeric column without nulls as an array."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


Batches = Iterator[pa.RecordBatch]
