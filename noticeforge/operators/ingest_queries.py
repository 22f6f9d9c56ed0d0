"""Queries of changes to the store, of ingest, of retrieval from end to end, and of checks and specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from noticeforge.catalog import query
from noticeforge.functions import html, models, text
from noticeforge.functions.urls import host
from noticeforge.operators import extraction, graph, ingest, quality, rag, scheduler, specs, store, vector
from noticeforge.operators.page_queries import _listing, _pages, _rows
from noticeforge.operators.read_queries import _TOP_SQL, _boards, _vectors, edges_of
from noticeforge.operators.state_queries import _bare_sql, _squash_sql
from noticeforge.sources.tables import materialized, table


def _now() -> Column:
    return F.lit("2026-06-01").cast("timestamp")


# ---------------------------------------------------------------- lookups


@query("school_by_id", "SELECT school_id, name, base_url, status FROM schools WHERE school_id = 1")
def school_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "schools").filter("school_id = 1").select("school_id", "name", "base_url", "status")


@query("attachment_in_school", """SELECT DISTINCT d.doc_id, a.attachment_id, a.status FROM notice_docs d JOIN attachments a ON d.school_id = a.school_id AND d.attachment_id = a.attachment_id""")
def attachment_in_school(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "attachments").select("school_id", "attachment_id", "status").distinct()
    return table(spark, sf_dir, "notice_docs").select("doc_id", "school_id", "attachment_id").join(files, ["school_id", "attachment_id"]).select("doc_id", "attachment_id", "status")


@query("entities_by_norm_keys", """SELECT DISTINCT e.school_id, e.entity_id FROM entities e WHERE EXISTS (SELECT 1 FROM entities k WHERE k.school_id = e.school_id AND k.norm_key = e.norm_key AND k.type = '행사')""")
def entities_by_norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities")
    return e.join(e.filter("type = '행사'").select("school_id", "norm_key").distinct(), ["school_id", "norm_key"], "left_semi").select("school_id", "entity_id").distinct()


_HOST_SQL = r"regexp_replace(regexp_replace(lower(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"
_GOOD = '{"listing": {"row": "tr", "detail_link": "a"}}'


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification per host: of every third school a broken one."""
    s = table(spark, sf_dir, "schools").select(F.upper(host(F.col("base_url"))).alias("host"), "school_id").filter("host <> ''").groupBy("host").agg(F.max("school_id").alias("school_id"))
    return s.select("host", F.when(F.col("school_id") % 3 == 0, '{"listing": {"row": "tr"').otherwise(_GOOD).alias("spec"), F.when(F.col("school_id") % 2 == 0, "human").otherwise("generated").alias("source"), "school_id")


_SPECS_SQL = f"specs AS (SELECT {_HOST_SQL.format(u='base_url')} AS host, max(school_id) AS id FROM schools WHERE {_HOST_SQL.format(u='base_url')} <> '' GROUP BY 1)"


@query("spec_lookup", f"""WITH {_SPECS_SQL}, p AS (SELECT DISTINCT page_id, {_HOST_SQL.format(u='source_url')} AS host FROM crawled_pages)
SELECT page_id, CASE WHEN id % 5 = 0 THEN 'dedicated' WHEN id % 3 <> 0 THEN 'spec' ELSE 'common' END AS parser FROM p LEFT JOIN specs USING (host)""")  # fmt: skip
def spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _specs(spark, sf_dir)
    dedicated = told.filter("school_id % 5 = 0").select("host", F.lit("box").alias("layout"))
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", F.col("source_url").alias("url")).distinct()
    return specs.lookup(pages, told.select("host", "spec"), dedicated).select("page_id", "parser").distinct()


@query("spec_decode", f"WITH {_SPECS_SQL} SELECT upper(host) AS host, id % 3 <> 0 AS valid, row_number() OVER (ORDER BY upper(host)) AS place FROM specs")
def spec_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = specs.decoded(_specs(spark, sf_dir)).select("host", "valid")
    return store.number_rows(told, ["host"], "place").select("host", "valid", "place").orderBy("host")


@query("spec_refresh", f"WITH {_SPECS_SQL} SELECT upper(host) AS host FROM specs WHERE id % 2 = 1 AND id % 3 = 0")
def spec_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _specs(spark, sf_dir)
    findings = told.select("host", F.when(F.col("school_id") % 3 == 0, "MISSING_TITLES").otherwise("MISSING_DATES").alias("code"))
    return specs.to_refresh(told, findings).select("host")


@query("not_expired_documents", "SELECT source_type, count(*) AS n FROM notice_docs WHERE expired_at IS NULL GROUP BY 1")
def not_expired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").filter("expired_at is null").groupBy("source_type").agg(F.count("*").alias("n"))


@query("pages_for_extractor", "SELECT DISTINCT page_id, crawl_status FROM crawled_pages WHERE crawl_status IN ('new', 'changed')")
def pages_for_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawled_pages").filter(F.col("crawl_status").isin("new", "changed")).select("page_id", "crawl_status").distinct()


@query("record_defaults", "SELECT doc_id, coalesce(miss_count, 0) AS miss_count, coalesce(source_type, 'web') AS source_type, coalesce(chunk_index, 0) AS chunk_index, true AS no_vector FROM notice_docs")
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.with_schema(table(spark, sf_dir, "notice_docs"), store.SCHEMAS["documents"], store.DEFAULTS["documents"])
    return docs.select("doc_id", "miss_count", "source_type", "chunk_index", F.col("embedding").isNull().alias("no_vector"))


@query("provenance_size", "SELECT DISTINCT entity_id, coalesce(len(source_doc_ids), 0) AS doc_count, len(list_distinct(source_doc_ids)) AS distinct_docs FROM entities WHERE source_doc_ids IS NOT NULL")
def provenance_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").filter("source_doc_ids is not null")
    known = F.array_distinct(F.filter("source_doc_ids", lambda d: d.isNotNull()))
    return e.select("entity_id", F.size("source_doc_ids").alias("doc_count"), F.size(known).alias("distinct_docs")).distinct()


# ---------------------------------------------------------------- changes to the store


@query("school_append", """WITH n AS (SELECT max(school_id) AS top FROM schools) SELECT school_id, name, status FROM schools
UNION ALL SELECT top + row_number() OVER (ORDER BY school_id), name || ' 분교', 'idle' FROM schools, n WHERE name IS NOT NULL""")  # fmt: skip
def school_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "schools")
    new = s.filter("name is not null").select(F.col("school_id").alias("ord"), F.concat("name", F.lit(" 분교")).alias("name"), F.lit("idle").alias("status"))
    return store.append(s, new, "school_id", ["ord"]).select("school_id", "name", "status")


@query("school_partial_update", """SELECT school_id, CASE WHEN school_id % 2 = 0 THEN 'N' || school_id ELSE name END AS name, CASE WHEN school_id % 3 <> 0 THEN image_url END AS image_url, status, school_id % 6 IN (0, 2, 3, 4) AS stamped FROM schools""")
def school_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "schools")
    i = F.col("school_id")
    entry = lambda k, v, on: F.when(on, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    values = F.map_concat(entry("name", F.concat(F.lit(" N"), i.cast("string")), i % 2 == 0), entry("image_url", F.lit(" "), i % 3 == 0), entry("status", F.lit("x"), F.lit(True)))
    out = store.partial_update(s, s.select("school_id", values.alias("values")), "school_id", ["name", "base_url", "image_url", "crawl_schedule"], "updated_at", F.lit("2031-01-01").cast("timestamp"))
    return out.select("school_id", "name", "image_url", "status", F.coalesce(F.year("updated_at") == 2031, F.lit(False)).alias("stamped"))


@query("school_registration_update", "SELECT school_id, 'R' || school_id AS name, crawl_schedule FROM schools")
def school_registration_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "schools")
    values = F.create_map(F.lit("name"), F.concat(F.lit("R"), F.col("school_id").cast("string")), F.lit("crawl_schedule"), F.lit("daily"))
    return store.partial_update(s, s.select("school_id", values.alias("values")), "school_id", ["name", "base_url"]).select("school_id", "name", "crawl_schedule")


@query("school_status_update", "SELECT school_id, CASE WHEN school_id % 2 = 0 THEN 'indexing' ELSE status END AS status FROM schools")
def school_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "schools")
    return store.set_status(s, s.filter("school_id % 2 = 0").select("school_id", F.lit("indexing").alias("status")), "school_id", [], ["status"]).select("school_id", "status")


@query("school_status_reset", "SELECT school_id, CASE WHEN status IN ('crawling', 'indexing') THEN 'idle' ELSE status END AS status FROM schools")
def school_status_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "schools")
    return scheduler.reset_status(s, s, "idle").select("school_id", "status")


@query("attachment_status_update", """WITH a AS (SELECT DISTINCT * FROM attachments) SELECT attachment_id, CASE WHEN attachment_id % 2 = 0 THEN 'failed' ELSE status END AS status,
CASE WHEN attachment_id % 4 = 0 THEN 'EMPTY_CONTENT' WHEN attachment_id % 2 = 0 THEN NULL ELSE error_code END AS error_code, CASE WHEN attachment_id % 4 = 0 THEN 7 ELSE chunk_count END AS chunk_count FROM a""")  # fmt: skip
def attachment_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "attachments").distinct()
    four = F.col("attachment_id") % 4 == 0
    changes = a.select("attachment_id").distinct().filter("attachment_id % 2 = 0").select("attachment_id", F.lit("failed").alias("status"), F.when(four, "EMPTY_CONTENT").alias("error_code"), F.when(four, 7).alias("chunk_count"))
    return store.set_status(a, changes, "attachment_id", ["chunk_count"], ["status", "error_code"]).select("attachment_id", "status", "error_code", "chunk_count")


@query("attachment_reupload", """WITH f AS (SELECT school_id, file_hash, any_value(chunk_count) AS n FROM (SELECT DISTINCT * FROM attachments) WHERE file_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT school_id, file_hash, 'pending' AS status, CAST(NULL AS VARCHAR) AS error_code, n AS chunk_count FROM f""")  # fmt: skip
def attachment_reupload(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["school_id", "file_hash"]
    a = table(spark, sf_dir, "attachments").distinct().filter("file_hash is not null")
    once = a.join(a.groupBy(*key).count().filter("count = 1").select(*key), key, "left_semi")
    again = once.select(*key, F.concat(F.lit("new "), "filename").alias("filename"), "content_type", "byte_size")
    reset = {"status": F.lit("pending"), "error_code": F.lit(None).cast("string"), "uploaded_at": _now()}
    return store.upsert(once, again, key, ["filename", "content_type", "byte_size"], reset).select(*key, "status", "error_code", "chunk_count")


@query("document_reactivation", """SELECT d.doc_id, CASE WHEN source_type = 'web' THEN 0 ELSE miss_count END AS miss_count, CASE WHEN source_type = 'web' THEN false ELSE expired_at IS NOT NULL END AS expired FROM notice_docs d
JOIN (SELECT school_id, source_url, content_hash, chunk_index FROM notice_docs WHERE school_id IS NOT NULL AND source_url IS NOT NULL AND content_hash IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL HAVING count(*) = 1) USING (school_id, source_url, content_hash, chunk_index)""")  # fmt: skip
def document_reactivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ingest.CHUNK_KEY
    docs = table(spark, sf_dir, "notice_docs").dropna(subset=key)
    once = docs.join(docs.groupBy(*key).count().filter("count = 1").select(*key), key, "left_semi")
    seen = once.filter("source_type = 'web'").select(*key, "title", "content", "crawled_at", "source_type", "page", "attachment_id")
    reset = {"miss_count": F.lit(0), "expired_at": F.lit(None).cast("timestamp")}
    out = store.upsert(once, seen, key, ["title", "content", "crawled_at", "source_type", "page", "attachment_id"], reset, "doc_id")
    return out.select("doc_id", "miss_count", F.col("expired_at").isNotNull().alias("expired"))


@query("school_cascade_delete", """SELECT 'entities' AS name, count(*) AS n FROM entities WHERE school_id IS NULL OR school_id NOT IN (SELECT school_id FROM schools WHERE status = 'failed')
UNION ALL SELECT 'notice_docs', count(*) FROM notice_docs WHERE school_id IS NULL OR school_id NOT IN (SELECT school_id FROM schools WHERE status = 'failed')
UNION ALL SELECT 'schools', count(*) FROM schools WHERE status IS NULL OR status <> 'failed' UNION ALL SELECT 'split_limits', count(*) FROM split_limits""")  # fmt: skip
def school_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("entities", "notice_docs", "schools", "split_limits")}
    left = store.delete_schools(tables, tables["schools"].filter("status = 'failed'"))
    out = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("attachment_delete", """SELECT 'attachments' AS name, count(*) AS n FROM attachments WHERE status <> 'failed' OR status IS NULL
UNION ALL SELECT 'documents', count(*) FROM notice_docs WHERE attachment_id IS NULL OR attachment_id NOT IN (SELECT attachment_id FROM attachments WHERE status = 'failed' AND attachment_id IS NOT NULL)""")  # fmt: skip
def attachment_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, d = table(spark, sf_dir, "attachments"), table(spark, sf_dir, "notice_docs")
    files, docs = store.delete_attachments(a, d, a.filter("status = 'failed'"))
    count = lambda t, n: t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count(files, "attachments").unionByName(count(docs, "documents"))


@query("quality_append", "SELECT school_id, count(DISTINCT page_id // 100) AS boards, count(DISTINCT page_id // 100) AS ids FROM crawled_pages GROUP BY 1")
def quality_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of quality rows, the second one empty; ids go on from the greatest."""
    rows = _boards(spark, sf_dir).select("school_id", F.col("run").cast("string").alias("crawl_id"), "listing_rows", "title_ratio", "date_ratio", "findings")
    empty = spark.createDataFrame([], store.SCHEMAS["crawl_quality"])
    first = store.append(empty, rows.withColumn("listing_rows", F.col("listing_rows").cast("int")), "quality_id", ["school_id", "crawl_id"])
    both = store.append(first, rows.filter("false").withColumn("listing_rows", F.col("listing_rows").cast("int")), "quality_id", ["school_id", "crawl_id"])
    return both.groupBy("school_id").agg(F.count("*").alias("boards"), F.count_distinct("quality_id").alias("ids"))


@query("maintenance_turn", r"""WITH w AS (SELECT school_id, status FROM schools WHERE lower(trim(crawl_schedule)) NOT IN ('', 'disabled', 'none', 'null') AND (lower(trim(crawl_schedule)) IN ('hourly', 'daily', 'weekly', 'monthly')
 OR regexp_full_match(lower(trim(crawl_schedule)), '[0-9]{1,12}(\s*[smhd])?') OR regexp_full_match(trim(crawl_schedule), '\S+(\s+\S+){4}')))
SELECT 'skip' AS what, count(*) FILTER (WHERE status IN ('crawling', 'indexing') AND school_id % 4 <> 0) AS n FROM w UNION ALL SELECT 'start', count(*) FILTER (WHERE (status IS NULL OR status NOT IN ('crawling', 'indexing')) AND school_id % 4 <> 0) FROM w
UNION ALL SELECT 'jobs', count(*) FROM w UNION ALL SELECT 'expired', count(*) FILTER (WHERE expired_at IS NOT NULL OR miss_count >= 3) FROM notice_docs""")  # fmt: skip
def maintenance_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    schools, docs = table(spark, sf_dir, "schools"), table(spark, sf_dir, "notice_docs")
    none = spark.createDataFrame([], "school_id long, schedule string, next_run timestamp, run_count int, error_count int")
    jobs, actions, after = scheduler.maintain(none, schools, docs, schools.filter("school_id % 4 = 0"), _now())
    kinds = spark.createDataFrame([("skip",), ("start",)], "what string")
    acted = kinds.join(actions.select(F.col("action").alias("what")), "what", "left").join(actions.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n")), "what", "left")
    acted = acted.select("what", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")).distinct()
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
    return acted.unionByName(count(jobs, "jobs")).unionByName(count(after.filter("expired_at is not null"), "expired"))


# ---------------------------------------------------------------- crawling and files


@query("fetch_failures", """WITH p AS (SELECT DISTINCT page_id, CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 301 END AS s FROM crawled_pages)
SELECT page_id, CASE WHEN s IS NULL THEN 'TIMEOUT' ELSE 'HTTP_' || s END AS error_code, s IS NULL OR s IN (429, 500, 502, 503, 504) AS retryable FROM p WHERE s IS NULL OR s <> 200""")  # fmt: skip
def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 6
    status = F.when(n == 0, 200).when(n == 1, 404).when(n == 2, 429).when(n == 3, 503).when(n == 4, 301)
    told = table(spark, sf_dir, "crawled_pages").select("page_id").distinct().select("page_id", ingest.fetch_failure(status, F.lit("Timeout")).alias("f"))
    return told.filter("f is not null").select("page_id", "f.error_code", "f.retryable")


@query("robots_status_policy", """WITH p AS (SELECT DISTINCT page_id, CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 401 WHEN 3 THEN 503 WHEN 4 THEN 403 END AS s FROM crawled_pages),
v AS (SELECT page_id, CASE WHEN s IS NULL OR s >= 500 THEN 'ROBOTS_UNREACHABLE' WHEN s IN (401, 403) THEN 'ROBOTS_DISALLOWED' WHEN s = 200 THEN 'rules' ELSE 'open' END AS verdict FROM p)
SELECT page_id, verdict, CASE WHEN verdict = 'ROBOTS_UNREACHABLE' THEN verdict ELSE 'ROBOTS_DISALLOWED' END AS error_code, verdict = 'ROBOTS_UNREACHABLE' AS retryable FROM v""")  # fmt: skip
def robots_status_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 6
    status = F.when(n == 0, 200).when(n == 1, 404).when(n == 2, 401).when(n == 3, 503).when(n == 4, 403)
    told = table(spark, sf_dir, "crawled_pages").select("page_id").distinct().withColumn("verdict", ingest.robots_verdict(status)).withColumn("f", ingest.policy_failure(F.col("verdict")))
    return told.select("page_id", "verdict", "f.error_code", "f.retryable")


@query("file_ingest", """WITH d AS (SELECT doc_id, filename, length(replace(regexp_replace(content, '\\s', '', 'g'), ' ', '')) AS n FROM (SELECT doc_id, 'f.' || CASE doc_id % 3 WHEN 0 THEN 'TXT' WHEN 1 THEN 'md' ELSE 'exe' END AS filename, content FROM notice_docs WHERE content IS NOT NULL))
SELECT doc_id AS attachment_id, CASE WHEN doc_id % 3 = 2 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 3 = 2 THEN 'UNSUPPORTED_FILE_TYPE' END AS error_code FROM d WHERE n > 0""")  # fmt: skip
def file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noticeforge.sources.attachments import read_files

    d = table(spark, sf_dir, "notice_docs").filter("content is not null").filter(F.regexp_replace("content", r"[\s\x0b]", "") != "")
    n = F.col("doc_id") % 3
    name = F.concat(F.lit("f."), F.when(n == 0, "TXT").when(n == 1, "md").otherwise("exe"))
    files = d.select(F.col("doc_id").alias("attachment_id"), "school_id", name.alias("path"), name.alias("filename"), F.encode("content", "UTF-8").alias("content"))
    return ingest.ingest_files(read_files(files).drop("content"))[0].select("attachment_id", "status", "error_code")


@query("file_chunks")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noticeforge.sources.attachments import read_files

    d = table(spark, sf_dir, "notice_docs").filter("content is not null").select(F.col("doc_id").alias("attachment_id"), "school_id", F.lit("f.txt").alias("path"), F.lit("f.txt").alias("filename"), F.encode("content", "UTF-8").alias("content"))
    docs = ingest.ingest_files(read_files(d).drop("content"))[1]
    return docs.select("attachment_id", "source_url", "chunk_index", "page", "content_hash")


# ---------------------------------------------------------------- graph and retrieval


@query("neighbor_records", f"""{_TOP_SQL}, seeds AS (SELECT node FROM top ORDER BY degree DESC, node LIMIT 10), names AS (SELECT p_partkey AS node, p_name AS name FROM part UNION ALL SELECT -1 - o_orderkey, o_orderstatus FROM orders)
SELECT DISTINCT e.edge_id, a.name AS source_name, relation, b.name AS target_name FROM (SELECT edge_id, -1 - src AS src, tgt, relation FROM edges) e JOIN names a ON e.src = a.node JOIN names b ON e.tgt = b.node
WHERE e.tgt IN (SELECT tgt FROM (SELECT tgt, count(*) AS n FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10))""")  # fmt: skip
def neighbor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested records around the ten parts of most order lines."""
    edges = edges_of(spark, sf_dir).withColumn("src", -1 - F.col("src"))
    seeds = edges.groupBy("tgt").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tgt").limit(10).select(F.lit(1).alias("question_id"), F.col("tgt").alias("node"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")).unionByName(table(spark, sf_dir, "orders").select((-1 - F.col("o_orderkey")).alias("node"), F.col("o_orderstatus").alias("name")))
    near = rag.expand(seeds, edges, names.withColumn("type", F.lit("x")))
    return near.select("edge_id", F.col("source.name").alias("source_name"), F.col("edge.relation").alias("relation"), F.col("target.name").alias("target_name"))


@query("entity_detail_records", f"""{_TOP_SQL} SELECT DISTINCT node, edge_id, other, relation FROM touch WHERE node IN (SELECT node FROM top)""")
def entity_detail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    return graph.touching(edges).join(materialized(graph.degree_top(edges, 100)).select("node"), "node", "left_semi").select("node", "edge_id", "other", "relation").distinct()


@query("core_subgraph", f"""{_TOP_SQL}, inner_edges AS (SELECT src, tgt FROM edges WHERE src IN (SELECT node FROM top) AND tgt IN (SELECT node FROM top)),
ends AS (SELECT src AS node FROM inner_edges UNION ALL SELECT tgt FROM inner_edges), docs AS (SELECT node, count(DISTINCT doc_ids[1]) AS doc_count FROM touch GROUP BY 1)
SELECT 'e_' || top.node AS id, count(ends.node) AS degree, any_value(doc_count) AS doc_count FROM top LEFT JOIN ends ON top.node = ends.node JOIN docs ON docs.node = top.node GROUP BY top.node""")  # fmt: skip
def core_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    top = materialized(graph.degree_top(edges, 100)).select("node")
    docs = graph.touching(edges).join(top, "node", "left_semi").select("node", F.explode("doc_ids").alias("d")).groupBy("node").agg(F.count_distinct("d").alias("doc_count"))
    return graph.subgraph_degree(top, edges).join(docs, "node").select(text.node_label(F.col("node")).alias("id"), "degree", "doc_count")


@query("edge_documents_missing", """WITH hits AS (SELECT school_id, doc_id FROM notice_docs WHERE source_type = 'web'), cited AS (SELECT DISTINCT school_id, unnest(source_doc_ids) AS doc_id FROM entities)
SELECT c.school_id, c.doc_id, d.title FROM cited c JOIN notice_docs d ON c.doc_id = d.doc_id AND c.school_id = d.school_id WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.school_id = c.school_id AND h.doc_id = c.doc_id)""")  # fmt: skip
def edge_documents_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "notice_docs").select("school_id", "doc_id", "title", "source_type")
    cited = table(spark, sf_dir, "entities").select("school_id", F.explode("source_doc_ids").alias("doc_id")).distinct()
    missing = cited.join(docs.filter("source_type = 'web'").select("school_id", "doc_id"), ["school_id", "doc_id"], "left_anti")
    return missing.join(docs.drop("source_type"), ["school_id", "doc_id"])


@query("vector_dimension", "SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) = 64 GROUP BY 1")
def vector_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.with_dimension(table(spark, sf_dir, "embeddings"), "embedding", 64).filter("embedding is not null").groupBy("label").agg(F.count("*").alias("n"))


@query("vector_approximate")
def vector_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by 20 ask; tests hold the recall against the exact search."""
    asked, items = _vectors(spark, sf_dir)
    return vector.approximate_top_k(asked.drop("label"), items.drop("label"), 5)


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(questions, what was retrieved): titles of the documents whose id is divisible by 20 ask, against all documents."""
    embed = models.embedder()
    docs = materialized(table(spark, sf_dir, "notice_docs").withColumn("embedding", embed(F.concat_ws(" ", "title", "content"))))
    none = F.create_map().cast("map<string,string>")
    e = table(spark, sf_dir, "entities").filter("school_id is not null and name is not null and type is not null").withColumn("norm_key", text.norm_key(F.col("type"), F.col("name")))
    merged = materialized(store.merge_entities(e.withColumn("ord", F.col("entity_id"))))
    ids = e.groupBy("school_id", "norm_key").agg(F.min("entity_id").alias("entity_id"))
    entities = materialized(merged.join(ids, ["school_id", "norm_key"]))
    after = entities.select("school_id", (F.col("entity_id") - 1).alias("entity_id"), F.col("entity_id").alias("tgt"))
    edges = entities.join(after, ["school_id", "entity_id"]).select(F.col("entity_id").alias("edge_id"), F.col("entity_id").alias("src"), "tgt", F.lit("관련").alias("relation"), F.col("source_doc_ids").alias("doc_ids"))
    asked = docs.filter("doc_id % 20 = 0 and title is not null and school_id is not null").select(F.col("doc_id").alias("question_id"), "school_id", F.col("title").alias("question"), embed(F.col("title")).alias("q_vec"))
    about = entities.select(F.explode("source_doc_ids").alias("question_id"), F.struct("type", "name", none.alias("attributes")).alias("e")).groupBy("question_id").agg(F.collect_list("e").alias("found"))
    questions = materialized(asked.join(about, "question_id", "left").withColumn("found", F.coalesce("found", F.array().cast(f"array<{extraction.ENTITY}>"))))
    return questions, rag.retrieve(questions, docs, entities, edges)


@query("retrieve_all")
def retrieve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir)[1]


@query("answer_all")
def answer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, found = _retrieved(spark, sf_dir)
    made = models.generator(models.provider("generate", "offline"))
    return rag.answers(found, questions, made, "확인할 수 없습니다.").select("question_id", "source_type", "answer")


def _patterns() -> Column:
    rules = models.pattern_rules({"장학금": r"(\w+장학금)", "부서·기관": r"(\w+(?:팀|처|센터))", "행사": r"(\w+(?:대회|특강|설명회))"})
    return models.extractor(lambda: rules)


@query("page_extraction")
def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").dropDuplicates(["page_id"])
    chunks, failures = extraction.extract_pages(pages, _patterns())
    good = chunks.select("page_id", "chunk_index", "extraction_status", F.size("entities").alias("entities"), F.size("relations").alias("relations"), F.lit(None).cast("string").alias("error_code"))
    return good.unionByName(failures.select("page_id", F.lit(-1).alias("chunk_index"), F.lit("failed").alias("extraction_status"), F.lit(0).alias("entities"), F.lit(0).alias("relations"), "error_code"))


@query("page_extraction_failures", "SELECT DISTINCT page_id, 'UNSUPPORTED_CRAWL_STATUS' AS error_code, false AS retryable FROM crawled_pages WHERE crawl_status IS NULL OR crawl_status NOT IN ('new', 'changed')")
def page_extraction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", "source_url", "title_hint", "category_hint", "raw_html", "crawl_status").dropDuplicates(["page_id"])
    return extraction.extract_pages(pages, _patterns())[1].filter("error_code = 'UNSUPPORTED_CRAWL_STATUS'").select("page_id", "error_code", "retryable")


def _built(spark: SparkSession, sf_dir: str) -> ingest.Built:
    """Every entity and the next one of its school as a chunk, built into empty tables."""
    e = table(spark, sf_dir, "entities").filter("school_id is not null").select("entity_id", "school_id", "type", "name").dropDuplicates(["entity_id"])
    none = F.create_map().cast("map<string,string>").alias("attributes")
    item = F.struct(F.coalesce("type", F.lit("")).alias("type"), F.coalesce("name", F.lit("")).alias("name"), none)
    relation = F.struct(F.coalesce("name", F.lit("")).alias("source"), F.lit("관련").alias("relation"), F.lit("본부").alias("target"))
    office = F.struct(F.lit("부서·기관").alias("type"), F.lit("본부").alias("name"), none)
    own = F.col("entity_id").cast("string")
    chunks = e.select(
        "school_id", F.when(F.col("entity_id") % 11 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("school_id")).alias("target_school_id"), F.concat(F.lit("u"), own).alias("source_url"), "name", F.lit("t").alias("title"), F.concat(F.lit("c"), own).alias("content"),
        F.lit(0).alias("chunk_index"), F.md5(own).alias("content_hash"), _now().alias("crawled_at"), F.when(F.col("entity_id") % 7 != 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"),
        F.array(item, office).alias("entities"), F.array(relation).alias("relations"), F.lit("complete").alias("extraction_status"),
    )
    empty = {n: spark.createDataFrame([], store.SCHEMAS[n]) for n in ("documents", "entities", "edges")}
    return ingest.build_graph(chunks, **{"documents": empty["documents"], "entities": empty["entities"], "edges": empty["edges"]})


@query("graph_build_results", r"""WITH e AS (SELECT DISTINCT entity_id, school_id, coalesce(type, '') AS type, coalesce(name, '') AS name FROM entities WHERE school_id IS NOT NULL)
SELECT 'u' || entity_id AS source_url, CASE WHEN entity_id % 11 = 0 OR entity_id % 7 = 0 THEN 'failed' WHEN NOT regexp_matches(type, '[^\s\p{Z}]') OR NOT regexp_matches(name, '[^\s\p{Z}]') THEN 'partial' WHEN name = '본부' AND type <> '부서·기관' THEN 'partial' ELSE 'complete' END AS status,
CASE WHEN entity_id % 11 = 0 THEN 'SCHOOL_ID_MISMATCH' WHEN entity_id % 7 = 0 THEN 'EMBEDDING_FAILED' END AS error_code, entity_id % 11 <> 0 AND entity_id % 7 = 0 AS retryable FROM e""")  # fmt: skip
def graph_build_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).results.select("source_url", "status", "error_code", "retryable")


@query("graph_build_tables")
def graph_build_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(spark, sf_dir)
    count = lambda t, n: t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count(built.documents, "documents").unionByName(count(built.entities, "entities")).unionByName(count(built.edges, "edges"))


# ---------------------------------------------------------------- checks


_BOARD_SQL = """board AS (SELECT school_id, page_id // 100 AS run, count(*) AS listing_rows,
 coalesce(avg(CASE WHEN trim(title_hint) <> '' THEN 1.0 ELSE 0.0 END), 0.0) AS title_ratio, coalesce(avg(CASE WHEN published_at_hint IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) AS date_ratio FROM crawled_pages GROUP BY 1, 2)"""


@query("listing_findings", f"""WITH {_BOARD_SQL} SELECT school_id, run, code FROM (SELECT school_id, run, unnest([CASE WHEN title_ratio < 0.9 THEN 'MISSING_TITLES' END, CASE WHEN date_ratio < 0.7 THEN 'MISSING_DATES' END]) AS code FROM board) WHERE code IS NOT NULL""")
def listing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boards(spark, sf_dir).select("school_id", "run", F.explode("findings").alias("code"))


@query("previous_listing_rows", f"WITH {_BOARD_SQL}, l AS (SELECT max(run) AS run FROM board) SELECT school_id, arg_max(listing_rows, run) AS previous FROM board WHERE run <> (SELECT run FROM l) GROUP BY 1")
def previous_listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = materialized(_boards(spark, sf_dir))
    last = boards.agg(F.max("run").alias("__last"))
    return quality.previous_rows(boards.crossJoin(F.broadcast(last)), ["school_id"], "run", "run", "listing_rows", F.col("__last"))


def _details(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three documents of each school as sampled pages, and all its page titles as the listing."""
    docs = table(spark, sf_dir, "notice_docs").filter("source_type = 'web' and school_id is not null").select("school_id", "doc_id", "title", "content", "source_url")
    picked = quality.sample(docs, ["school_id"], ["doc_id"]).withColumns({"hint": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("다른 글 "), "title")).otherwise(F.col("title")), "fallback": F.col("doc_id") % 5 == 0})
    return picked, table(spark, sf_dir, "crawled_pages").select("school_id", F.col("title_hint").alias("title")).distinct()


_PICKED_SQL = """p AS (SELECT school_id, doc_id, title, content, source_url, CASE WHEN doc_id % 2 = 0 THEN '다른 글 ' || title ELSE title END AS hint FROM notice_docs WHERE source_type = 'web' AND school_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY doc_id) <= 3)"""
@query("detail_findings", f"""WITH {_PICKED_SQL}, n AS (SELECT *, {_bare_sql("coalesce(hint, '')")} AS x, {_bare_sql("coalesce(title, '')")} AS y, {_squash_sql("coalesce(title, '') || ' ' || coalesce(content, '')")} AS page, {_squash_sql("content")} AS body FROM p),
t AS (SELECT DISTINCT school_id, title_hint, {_squash_sql("title_hint")} AS k FROM crawled_pages WHERE {_squash_sql("title_hint")} <> ''),
leak AS (SELECT DISTINCT doc_id FROM n JOIN t ON n.school_id = t.school_id AND contains(n.body, t.k) AND t.title_hint IS DISTINCT FROM n.hint)
SELECT doc_id, 'EMPTY_CONTENT' AS code FROM p WHERE length(trim(coalesce(content, ''), ' ' || chr(10) || chr(9) || chr(13) || chr(12288))) < 50
UNION ALL SELECT doc_id, 'TITLE_MISMATCH' FROM n WHERE hint <> '' AND NOT (x = '' OR contains(page, x) OR length(y) >= 8 AND contains(x, y) OR length(x) >= 8 AND starts_with(y, x))
UNION ALL SELECT doc_id, 'NEIGHBOUR_LEAK' FROM leak UNION ALL SELECT doc_id, 'BODY_FALLBACK' FROM p WHERE doc_id % 5 = 0""")  # fmt: skip
def detail_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked, titles = _details(spark, sf_dir)
    return quality.detail_findings(picked, titles, ["school_id"], "doc_id").select("doc_id", F.explode("findings").alias("code"))


@query("board_grouping", """WITH b AS (SELECT source_url, min(category_hint) AS board FROM crawled_pages WHERE category_hint IS NOT NULL AND source_url IS NOT NULL GROUP BY 1)
SELECT coalesce(board, '기본') AS board, count(*) AS n FROM (SELECT DISTINCT page_id, source_url FROM crawled_pages) d LEFT JOIN b USING (source_url) GROUP BY 1""")  # fmt: skip
def board_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = table(spark, sf_dir, "crawled_pages").filter("category_hint is not null and source_url is not null").select(F.col("source_url").alias("url"), F.col("category_hint").alias("board"))
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", F.col("source_url").alias("url")).distinct()
    return quality.board_of(pages, boards).groupBy("board").agg(F.count("*").alias("n"))


@query("detail_not_in_listing", """SELECT school_id, source_url, CASE WHEN NOT EXISTS (SELECT 1 FROM crawled_pages p WHERE p.school_id = d.school_id AND p.source_url = d.source_url) THEN 'DETAIL_NOT_IN_LISTING' ELSE 'BODY_SELECTOR_NOT_FOUND' END AS code
FROM (SELECT DISTINCT school_id, source_url FROM notice_docs WHERE source_type = 'web' AND school_id IS NOT NULL AND source_url IS NOT NULL) d""")  # fmt: skip
def detail_not_in_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "notice_docs").filter("source_type = 'web' and school_id is not null and source_url is not null").select("school_id", F.col("source_url").alias("url")).distinct()
    listed = table(spark, sf_dir, "crawled_pages").select("school_id", F.col("source_url").alias("url"))
    told = quality.spec_findings(docs.withColumns({"found": F.lit(False), "has": F.lit(True)}), listed, "school_id", "has")
    return told.withColumnRenamed("url", "source_url")


@query("batch_usability", f"WITH {_BOARD_SQL}, c AS (SELECT school_id, sum(length(content)) // count(content) AS chars FROM notice_docs GROUP BY 1) SELECT count(*) FILTER (WHERE listing_rows > 0 AND title_ratio >= 0.9 AND chars >= 50) AS usable, count(*) AS total FROM board LEFT JOIN c USING (school_id)")
def batch_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "notice_docs").groupBy("school_id").agg(F.floor(F.sum(F.length("content")) / F.count("content")).alias("body_chars"))
    return quality.batch_summary(_boards(spark, sf_dir).join(chars, "school_id", "left"))


# ---------------------------------------------------------------- specifications on pages made of the entities


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sites, samples): a school's first listing page in the form of the first template (even schools) or of none, and two notices of it."""
    rows = _rows(spark, sf_dir).filter("school_id is not null")
    low = rows.groupBy("school_id").agg(F.min("page").alias("page"))
    rows = materialized(rows.join(low, ["school_id", "page"]))
    name = F.regexp_replace(F.regexp_replace("name", "&", "&amp;"), "<", "&lt;")
    link = F.concat(F.lit("?mode=view&articleNo="), F.col("entity_id").cast("string"))
    boxed = F.concat(F.lit("<tr><td><div class='b-title-box'><a class='b-title' href='"), link, F.lit("'>"), name, F.lit("</a></div></td><td class='b-date'>2026-01-02</td></tr>"))
    other = F.concat(F.lit("<p>"), name, F.lit("</p>"))
    pages = _listing(rows, F.when(F.col("school_id") % 2 == 0, boxed).otherwise(other), "<table><tbody>", "</tbody></table>")
    sites = pages.select(F.col("school_id").alias("site"), "url", "html")
    two = quality.sample(rows, ["school_id"], ["entity_id"], 2).join(pages.select("school_id", "url"), "school_id")
    page = F.concat(F.lit("<div class='b-title'>"), name, F.lit("</div><div class='b-content-box'><p>"), name, F.lit(" " + "본문이 이어집니다. " * 8 + "</p></div>"))
    return sites, two.select(F.col("school_id").alias("site"), F.concat(F.regexp_extract("url", r"^[^?]*", 0), link).alias("url"), page.alias("html"))


@query("template_match", """WITH s AS (SELECT DISTINCT school_id AS site FROM entities WHERE school_id IS NOT NULL) SELECT site, 'box' AS name FROM s WHERE site % 2 = 0""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.match_templates(*_sites(spark, sf_dir)).select("site", "name")


@query("spec_provision", """WITH s AS (SELECT DISTINCT school_id AS site FROM entities WHERE school_id IS NOT NULL)
SELECT site, CASE WHEN site % 5 = 0 THEN 'dedicated' WHEN site % 7 = 0 THEN 'stored' WHEN site % 9 = 0 THEN 'host' WHEN site % 2 = 0 THEN 'template:box' ELSE 'none' END AS origin FROM s""")  # fmt: skip
def spec_provision(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, samples = _sites(spark, sf_dir)
    hosts = sites.select("site", host(F.col("url")).alias("host"))
    stored = hosts.select("host", F.when(F.col("site") % 7 == 0, _GOOD).otherwise("{").alias("spec"))
    return specs.provision(sites, samples, hosts.filter("site % 5 = 0"), stored, hosts.filter("site % 9 = 0").withColumn("spec", F.lit(_GOOD))).select("site", "origin")


@query("guessed_details", """WITH e AS (SELECT DISTINCT school_id, entity_id FROM entities WHERE school_id IS NOT NULL AND entity_id IS NOT NULL) SELECT school_id, count(*) AS n FROM (SELECT school_id, entity_id FROM e QUALIFY row_number() OVER (PARTITION BY school_id, entity_id // 20 ORDER BY entity_id) <= 3 AND count(*) OVER (PARTITION BY school_id, entity_id // 20) >= 3) GROUP BY 1""")
def guessed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").filter("school_id is not null and entity_id is not null").select("school_id", "entity_id", F.floor(F.col("entity_id") / 20).alias("page")).distinct()
    row = F.concat(F.lit("<a href='/v?n="), F.col("entity_id").cast("string"), F.lit("'>긴 공지 제목</a><a href='/m'>메뉴로 가는 길</a>"))
    pages = _listing(e, row, "<div>", "</div>")
    return specs.guess_details(pages).join(pages.select("url", "school_id"), "url").groupBy("school_id").agg(F.count("*").alias("n"))
