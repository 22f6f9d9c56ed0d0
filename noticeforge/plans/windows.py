"""Running sums and ranks within groups of which one may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noticeforge.sources.tables import materialized


def running_sum(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """rows with the sum of value over their group up to them, in the order of `order`; rows that tie come in any order.

    Rows are cut into ranges by group and order, so a hot group is spread over many tasks. Each range sums up its part of a
    group, and what the ranges before it hold of the group is added: one row per group and range.
    """
    cut = rows.repartitionByRange(*group, *order).withColumns({"__p": F.spark_partition_id(), "__v": value})
    kept = materialized(cut.withColumn("__g", F.xxhash64(*group) if group else F.lit(0).cast("bigint")))
    ranges = kept.groupBy("__g", "__p").agg(F.sum("__v").alias("__s"))
    earlier = F.sum("__s").over(W.Window.partitionBy("__g").orderBy("__p").rowsBetween(W.Window.unboundedPreceding, -1))
    before = ranges.select("__g", "__p", F.coalesce(earlier, F.lit(0)).alias("__b"))
    inside = F.sum("__v").over(W.Window.partitionBy("__g", "__p").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0))
    return kept.withColumn(out, inside).join(before, ["__g", "__p"]).withColumn(out, F.col(out) + F.col("__b")).select(*rows.columns, out)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """rows with their number within their group, from 1."""
    return running_sum(rows, group, order, F.lit(1).cast("bigint"), out)
