"""Readers of the parquet tables and the shared folder of a session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` of the data set in sf_dir; timestamps become zoned (UTC) on both layouts."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder.

    On a cluster that is what spark.checkpoint.dir names; only where it is unset (tests, local runs) a local one is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="noticeforge-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, "noticeforge", spark.sparkContext.applicationId, uuid.uuid4().hex)


def drop_materialized(spark: SparkSession) -> None:
    """Deletes all tables that this application has materialized; call it once no result that reads them is needed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.dirname(shared_dir(spark)))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialized(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
