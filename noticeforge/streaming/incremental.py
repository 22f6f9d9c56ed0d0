"""Incremental crawl state as a stream: each micro-batch of observations is merged into a versioned document table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeforge.operators.crawl import classify_changes
from noticeforge.operators.store import expire, observe


class VersionedTable:
    """A parquet table as numbered versions in one folder of the shared file system; one writer, any number of readers.

    A version is readable once its _SUCCESS file is there, so a writer that dies leaves the last whole version in force.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The latest whole version, -1 if there is none."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(os.path.join(self.path, n, "_SUCCESS")))), default=-1)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, f"v{self.version()}"))

    def write(self, df: DataFrame, version: int) -> None:
        """Writes that version; a half-written one of the same number is replaced, a whole one is left as it is."""
        if version > self.version():
            df.write.mode("overwrite").parquet(os.path.join(self.path, f"v{version}"))


def maintain(observations: DataFrame, docs: VersionedTable, checkpoint: str, misses: int = 3) -> StreamingQuery:
    """Starts the stream of observations (school_id, source_url, observed_at): miss counts and expiry after each batch.

    A batch is one crawl's observations. The batch number is the version, so a batch that is replayed after a failure writes
    what it wrote before. A batch without observations changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("observed_at").alias("at")).first()["at"]
        if at is not None and number + 1 > docs.version():
            docs.write(expire(observe(docs.read(), batch.select("school_id", "source_url")), F.lit(at), misses), number + 1)

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detect(pages: DataFrame, known: VersionedTable, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream of crawled pages (school_id, url, content_hash): each batch is held against all pages before it.

    What a batch's pages are (new, changed or unchanged) goes to a folder of its number in `out`, and its pages join the known
    ones (of at least these columns). A batch that is replayed after a failure writes what it wrote before. Rows without a hash
    say nothing and are left out.
    """
    columns = ["school_id", "url", "content_hash"]

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.filter("content_hash is not null").select(*columns).distinct()
        if number + 1 > known.version():
            seen = known.read().select(*columns)
            classify_changes(rows, seen).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))
            known.write(seen.unionByName(rows).distinct(), number + 1)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
