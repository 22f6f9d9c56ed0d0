"""Joins whose strategy is chosen by a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.sources.tables import materialized

#: Bytes, in an executor's memory, up to which a side may be shipped to every executor.
BROADCAST_BYTES = 64 << 20


def bytes_of(kept: DataFrame) -> int:
    """An upper estimate of the memory that a materialized table takes: its rows by the width of their columns, or its files unpacked."""
    spark = kept.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = [path(f) for f in kept.inputFiles()]
    stored = sum(f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(f).getLen() for f in files)
    width = 16 + 8 * len(kept.columns)
    return max(4 * stored, width * kept.count())


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df as a broadcast side if it takes at most max_bytes, else as it is; and which of the two it was.

    df is written to the shared folder first: its size is read from the files, it is computed once in either case, and none of its
    rows pass through the driver's Python.
    """
    kept = materialized(df)
    small = bytes_of(kept) <= max_bytes
    return (F.broadcast(kept) if small else kept), small


def fan_out(df: DataFrame, *cols: str) -> DataFrame:
    """df hash-partitioned by cols into at least as many partitions as the cluster has cores."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df over all cores before costly functions: repartitioned by cols only if it has fewer partitions than the cluster has cores.

    Small inputs in one file would otherwise run in one task; large ones have partitions enough and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return fan_out(df, *cols) if df.rdd.getNumPartitions() < cores else df
