"""Queries of snapshots.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.catalog import query
from noticeforge.operators.snapshots import document_changes
from noticeforge.sources.tables import table

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

CHANGES_SQL = rf"""
WITH parts AS (
  SELECT *, lower(regexp_extract(trim(source_url), '{_URL}', 1)) || '://' || lower(regexp_extract(trim(source_url), '{_URL}', 2))
            || regexp_replace(regexp_extract(trim(source_url), '{_URL}', 3), '/+$', '') AS u0,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(source_url), '{_URL}', 4), '&'),
           lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')
                     AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid'))), '&') AS q
  FROM doc_snapshots WHERE snapshot_no IS NOT NULL AND school_id IS NOT NULL),
r AS (
  SELECT snapshot_no, school_id, u0 || CASE WHEN q = '' THEN '' ELSE '?' || q END AS source_url, chunk_index,
         lower(trim(content_hash)) AS h, coalesce(miss_count, 0) AS m, crawled_at, delivered_at FROM parts),
one AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY snapshot_no, school_id, source_url, chunk_index
    ORDER BY crawled_at DESC NULLS LAST, delivered_at DESC NULLS LAST) = 1),
given AS (SELECT DISTINCT school_id, snapshot_no FROM r),
pairs AS (
  SELECT school_id, snapshot_no AS cur, lag(snapshot_no) OVER (PARTITION BY school_id ORDER BY snapshot_no) AS prev FROM given),
a AS (SELECT o.* FROM one o JOIN pairs p ON o.school_id = p.school_id AND o.snapshot_no = p.cur WHERE p.prev IS NOT NULL),
b AS (SELECT p.cur AS snapshot_no, o.* EXCLUDE (snapshot_no) FROM one o JOIN pairs p ON o.school_id = p.school_id AND o.snapshot_no = p.prev)
SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.school_id, b.school_id) AS school_id,
       coalesce(a.source_url, b.source_url) AS source_url, coalesce(a.chunk_index, b.chunk_index) AS chunk_index,
       CASE WHEN b.snapshot_no IS NULL THEN 'added' WHEN a.snapshot_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL OUTER JOIN b ON a.snapshot_no = b.snapshot_no AND a.school_id = b.school_id
     AND a.source_url IS NOT DISTINCT FROM b.source_url AND a.chunk_index IS NOT DISTINCT FROM b.chunk_index
WHERE a.snapshot_no IS NULL OR b.snapshot_no IS NULL OR a.h IS DISTINCT FROM b.h OR a.m <> b.m
"""


@query("p1_found", CHANGES_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = document_changes(table(spark, sf_dir, "doc_snapshots"))
    return changes.select("snapshot_no", "school_id", "source_url", "chunk_index", "change_kind")


@query("p1_change_counts", f"SELECT snapshot_no, change_kind, count(*) AS n FROM ({CHANGES_SQL}) GROUP BY 1, 2")
def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n"))
