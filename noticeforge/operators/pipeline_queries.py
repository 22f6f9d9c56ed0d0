"""Queries of the extraction and scheduling steps and of the offline model stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.catalog import query
from noticeforge.functions import models
from noticeforge.operators import extraction, scheduler
from noticeforge.sources.tables import table

_TYPES = ("장학금", "행사", "시설", "공지", "부서·기관")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity: itself and its school's office as an extraction; every third says that the office posts the entity."""
    e = table(spark, sf_dir, "entities").select("entity_id", "type", "name", "school_id").distinct()
    none = F.create_map().cast("map<string,string>").alias("attributes")
    office = F.struct(F.lit("부서·기관").alias("type"), F.concat(F.lit(" 학교 "), "school_id").alias("name"), none)
    entities = F.array(F.struct("type", "name", none), office)
    relation = F.struct(F.concat(F.lit("학교 "), "school_id").alias("source"), F.when(F.col("entity_id") % 3 == 0, "게시").otherwise("기타").alias("relation"), F.col("name").alias("target"))
    return e.select("entity_id", "type", "name", "school_id", entities.alias("entities"), F.array(relation).alias("relations"))


@query("whitelist_filter", """
SELECT DISTINCT entity_id, CASE WHEN type IN ('장학금', '행사', '시설', '공지', '부서·기관') AND trim(name) <> '' THEN 2 ELSE 1 END AS kept FROM entities""")  # fmt: skip
def whitelist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("entity_id", F.size(extraction.allowed_entities(F.col("entities"), _TYPES)).alias("kept"))


@query("relation_swap", """
SELECT DISTINCT entity_id, CASE WHEN type = '공지' THEN trim(name) ELSE '학교 ' || school_id END AS source, CASE WHEN type = '공지' THEN '학교 ' || school_id ELSE trim(name) END AS target
FROM entities WHERE entity_id % 3 = 0 AND type IN ('장학금', '행사', '시설', '공지', '부서·기관') AND trim(name) <> ''""")  # fmt: skip
def relation_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark, sf_dir).withColumn("entities", extraction.allowed_entities(F.col("entities"), _TYPES))
    return rows.select("entity_id", F.explode(extraction.allowed_relations(F.col("relations"), F.col("entities"))).alias("r")).select("entity_id", "r.source", "r.target")


@query("extraction_discarded", """
SELECT DISTINCT entity_id, CASE WHEN type IN ('대학·캠퍼스', '단과대학', '학과·전공', '부서·기관', '담당자', '외부기관', '공지', '장학금', '프로그램·사업', '채용·모집', '행사', '학사일정', '교과목·수업',
 '절차·신청방법', '규정·정책', '대상·자격', '연락처', '시설', '첨부·링크', '주제·카테고리') AND trim(name) <> '' THEN CASE WHEN entity_id % 3 = 0 THEN 0 ELSE 1 END ELSE 2 END AS discarded FROM entities""")  # fmt: skip
def extraction_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark, sf_dir)
    return rows.select("entity_id", extraction.validated(F.col("entities"), F.col("relations"))["discarded"].alias("discarded")).distinct()


@query("metadata_guarantee", """
WITH p AS (SELECT DISTINCT page_id, title_hint AS t, trim(coalesce(category_hint, '')) AS c FROM crawled_pages)
SELECT page_id, CASE WHEN c = '' THEN 0 WHEN coalesce(t, '') = '' THEN 1 ELSE 2 END AS entities, CASE WHEN c <> '' AND coalesce(t, '') <> '' THEN t || '/분류/' || c END AS relation FROM p""")  # fmt: skip
def metadata_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = [F.array().cast(f"array<{kind}>") for kind in (extraction.ENTITY, extraction.RELATION)]
    made = extraction.with_category(*empty, F.col("category_hint"), F.col("title_hint"))
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", made.alias("m"))
    first = F.get("m.relations", F.lit(0))
    relation = F.when(first.isNotNull(), F.concat_ws("/", first["source"], first["relation"], first["target"]))
    return pages.select("page_id", F.size("m.entities").alias("entities"), relation.alias("relation")).distinct()


@query("page_extraction_status", """
SELECT attachment_id, CASE WHEN count(*) FILTER (WHERE length(content) >= 400) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE length(content) >= 400) < count(*) THEN 'partial' ELSE 'complete' END AS extraction_status
FROM notice_docs WHERE attachment_id IS NOT NULL GROUP BY 1""")  # fmt: skip
def page_extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "notice_docs").filter("attachment_id is not null").withColumn("ok", F.length("content") >= 400)
    return extraction.page_status(chunks, "attachment_id", "ok")


@query("scheduler_due", """
SELECT school_id, CASE WHEN status IN ('crawling', 'indexing') THEN 'skip' ELSE 'start' END AS action FROM schools
WHERE lower(trim(crawl_schedule)) IN ('hourly', 'daily', 'weekly', 'monthly') OR regexp_full_match(lower(trim(crawl_schedule)), '[0-9]{1,12}( *[smhd])?') OR regexp_full_match(trim(crawl_schedule), '[^ ]+( +[^ ]+){4}')""")  # fmt: skip
def scheduler_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    schools, now = table(spark, sf_dir, "schools"), F.lit("2026-06-01").cast("timestamp")
    none = spark.createDataFrame([], "school_id long, schedule string, next_run timestamp, run_count int, error_count int")
    return scheduler.due_jobs(scheduler.sync_jobs(none, schools, now), schools, now)


@query("start_crawl", "SELECT school_id, CASE WHEN school_id % 2 = 0 AND status NOT IN ('crawling', 'indexing') THEN 'crawling' ELSE status END AS status FROM schools")
def start_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    schools = table(spark, sf_dir, "schools")
    return scheduler.start(schools, schools.filter("school_id % 2 = 0"), F.lit("2026-06-01").cast("timestamp")).select("school_id", "status")


@query("embed_documents")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").select("doc_id", models.embedder()(F.col("content")).alias("embedding"))
