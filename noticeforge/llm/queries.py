"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import mainbody, mixing, mojibake, sentences, sitelines, splitting, survivors, tokens
from noticeforge.plans.joins import spread
from noticeforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _ORACLES[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


@_query()
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return tokens.encode_tokens(docs, "text", "ids").select("doc_id", "ids")


@_query()
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@_query()
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@_query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.main_lines(table(spark, sf_dir, "crawled_pages"), table(spark, sf_dir, "notice_docs"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.project_texts(*[table(spark, sf_dir, t) for t in ("crawled_pages", "attachments", "notice_docs")])


@_query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_records(_texts(spark, sf_dir))


@_query()
def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired_runs(_texts(spark, sf_dir))


P4_SQL = r"""
WITH site AS (
  SELECT school_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(base_url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '') AS site
  FROM schools WHERE base_url IS NOT NULL),
docs AS (SELECT DISTINCT doc_id, site, content FROM notice_docs JOIN site USING (school_id) WHERE site <> ''),
total AS (SELECT site, count(DISTINCT doc_id) AS total FROM docs GROUP BY 1),
lines AS (
  SELECT site, doc_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM docs),
keyed AS (
  SELECT site, doc_id, line_no, lower(regexp_replace(line, '[\p{N}\s\p{Z}\x{0b}\x{85}\x{ad}\x{180e}\x{200b}-\x{200f}\x{2060}\x{feff}\x{3164}\x{2800}]', '', 'g')) AS k FROM lines),
over AS (
  SELECT site, k FROM keyed JOIN total USING (site) WHERE regexp_matches(k, '\p{L}[^\p{L}]*\p{L}')
  GROUP BY site, k, total HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.2 * total)
SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM keyed SEMI JOIN over USING (site, k)
"""


@_query(P4_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sitelines.repeated_lines(table(spark, sf_dir, "notice_docs"), table(spark, sf_dir, "schools"))
    return found.select("doc_id", "line_no")


@_query()
def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "notice_docs").select("doc_id", "school_id", "content")
    return sitelines.without_lines(docs, table(spark, sf_dir, "schools")).select("doc_id", "clean_content")


P5_SQL = """
WITH over AS (
  SELECT doc_id, attachment_id, d.source_type FROM notice_docs d JOIN split_limits s ON d.source_type = s.source_type
  WHERE CASE WHEN lower(trim(size_unit)) = 'bytes' THEN octet_length(encode(content)) ELSE length(content) END > max_size)
SELECT 'notice_docs' AS src, doc_id AS rec_id FROM over
UNION SELECT 'attachments', a.attachment_id FROM attachments a SEMI JOIN (SELECT * FROM over WHERE source_type = 'attachment') o ON a.attachment_id = o.attachment_id
"""


@_query(P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "notice_docs"), table(spark, sf_dir, "attachments"), table(spark, sf_dir, "split_limits"))


@_query()
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "notice_docs"), table(spark, sf_dir, "split_limits"))


@_query()
def p5_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = p5_pieces(spark, sf_dir).filter("attachment_id is not null").groupBy("attachment_id").agg(F.count("*").cast("int").alias("chunk_count"))
    files = table(spark, sf_dir, "attachments").select("attachment_id").distinct()
    return files.join(pieces, "attachment_id", "left").select("attachment_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


@_query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found_fields(table(spark, sf_dir, "entities"))


@_query()
def p6_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.fused_entities(table(spark, sf_dir, "entities"))


@_query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sentences.candidate_table(table(spark, sf_dir, "documents"))
    return sentences.split_sentences(places, sentences.train(places))
