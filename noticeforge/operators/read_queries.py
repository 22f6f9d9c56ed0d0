"""Relational reads: lookups, lists with counts, statistics, quality, retrieval and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noticeforge.catalog import query
from noticeforge.operators import graph, ingest, quality, rag, vector
from noticeforge.plans.joins import small_side
from noticeforge.plans.windows import ranked
from noticeforge.sources.tables import table

# ---------------------------------------------------------------- schools and attachments


@query("school_list_with_counts", """
SELECT s.school_id, s.name, count(e.entity_id) AS entity_count FROM schools s LEFT JOIN entities e ON s.school_id = e.school_id
WHERE s.name ILIKE '%대학%' GROUP BY s.school_id, s.name""")  # fmt: skip
def school_list_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "entities").groupBy("school_id").agg(F.count("entity_id").alias("entity_count"))
    schools = table(spark, sf_dir, "schools").filter(F.col("name").ilike("%대학%")).select("school_id", "name")
    return schools.join(counts, "school_id", "left").withColumn("entity_count", F.coalesce("entity_count", F.lit(0).cast("bigint"))).orderBy("name", "school_id")


@query("school_stats", """
SELECT s.school_id, coalesce(d.n, 0) AS documents, coalesce(e.n, 0) AS entities, coalesce(a.n, 0) AS attachments, d.last AS last_crawled
FROM schools s LEFT JOIN (SELECT school_id, count(*) AS n, CAST(epoch(max(crawled_at)) AS BIGINT) AS last FROM notice_docs GROUP BY 1) d USING (school_id)
LEFT JOIN (SELECT school_id, count(DISTINCT entity_id) AS n FROM entities GROUP BY 1) e USING (school_id)
LEFT JOIN (SELECT school_id, count(DISTINCT attachment_id) AS n FROM attachments GROUP BY 1) a USING (school_id)""")  # fmt: skip
def school_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "notice_docs").groupBy("school_id").agg(F.count("*").alias("documents"), F.unix_timestamp(F.max("crawled_at")).alias("last_crawled"))
    out = table(spark, sf_dir, "schools").select("school_id").join(docs, "school_id", "left")
    for name, key in (("entities", "entity_id"), ("attachments", "attachment_id")):
        out = out.join(table(spark, sf_dir, name).groupBy("school_id").agg(F.count_distinct(key).alias(name)), "school_id", "left")
    return out.fillna(0, ["documents", "entities", "attachments"]).select("school_id", "documents", "entities", "attachments", "last_crawled")


@query("ready_attachment_count", "SELECT school_id, count(DISTINCT CASE WHEN status = 'ready' THEN attachment_id END) AS ready FROM attachments GROUP BY 1")
def ready_attachment_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "attachments").groupBy("school_id").agg(F.count_distinct(F.when(F.col("status") == "ready", F.col("attachment_id"))).alias("ready"))


@query("query_readiness", """
SELECT s.school_id, s.status IN ('ready', 'partial_failed') OR coalesce(a.ready, 0) > 0 AS is_ready FROM schools s
LEFT JOIN (SELECT school_id, count(*) FILTER (WHERE status = 'ready') AS ready FROM attachments GROUP BY 1) a USING (school_id)""")  # fmt: skip
def query_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    schools = table(spark, sf_dir, "schools").select("school_id", "status").join(ready_attachment_count(spark, sf_dir), "school_id", "left")
    return schools.select("school_id", (F.col("status").isin("ready", "partial_failed") | (F.coalesce("ready", F.lit(0)) > 0)).alias("is_ready"))


@query("attachment_list", """
SELECT DISTINCT school_id, attachment_id, filename, status, row_number() OVER (PARTITION BY school_id ORDER BY uploaded_at DESC NULLS LAST, attachment_id DESC) AS place
FROM (SELECT DISTINCT * FROM attachments)""")  # fmt: skip
def attachment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc_nulls_last("uploaded_at"), F.desc("attachment_id")]
    return ranked(table(spark, sf_dir, "attachments").distinct(), ["school_id"], order, "place").select("school_id", "attachment_id", "filename", "status", "place")


@query("status_case", """
SELECT school_id, CASE WHEN status = 'ready' THEN 'done' WHEN status IN ('crawling', 'indexing', 'partial_failed', 'failed') THEN status ELSE 'idle' END AS stage,
CAST(CASE status WHEN 'crawling' THEN 0.3 WHEN 'indexing' THEN 0.7 WHEN 'ready' THEN 1.0 WHEN 'partial_failed' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS progress FROM schools""")  # fmt: skip
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    stage = F.when(s == "ready", "done").when(s.isin("crawling", "indexing", "partial_failed", "failed"), s).otherwise("idle")
    progress = F.when(s == "crawling", 0.3).when(s == "indexing", 0.7).when(s.isin("ready", "partial_failed"), 1.0).otherwise(0.0)
    return table(spark, sf_dir, "schools").select("school_id", stage.alias("stage"), progress.alias("progress"))


@query("upload_admission", """
SELECT DISTINCT attachment_id, CASE WHEN filename IS NULL OR trim(filename) = '' THEN 'INVALID_FILENAME'
 WHEN lower(regexp_extract(trim(filename), '[^/.][^/]*(\\.[^./]+)$', 1)) NOT IN ('.pdf', '.hwp', '.hwpx', '.txt', '.md') THEN 'UNSUPPORTED_FILE_TYPE'
 WHEN coalesce(byte_size, 0) = 0 THEN 'EMPTY_FILE' WHEN byte_size > 104857600 THEN 'FILE_TOO_LARGE' ELSE 'OK' END AS code FROM attachments""")  # fmt: skip
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "attachments").select("attachment_id", ingest.admission_code(F.col("filename"), F.col("byte_size")).alias("code")).distinct()


@query("documents_by_ids", """
SELECT DISTINCT d.school_id, d.doc_id, d.title FROM notice_docs d JOIN (SELECT DISTINCT school_id, unnest(source_doc_ids) AS doc_id FROM entities WHERE type = '장학금') i
ON d.school_id = i.school_id AND d.doc_id = i.doc_id""")  # fmt: skip
def documents_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "entities").filter("type = '장학금'").select("school_id", F.explode("source_doc_ids").alias("doc_id")).distinct()
    return table(spark, sf_dir, "notice_docs").select("school_id", "doc_id", "title").join(ids, ["school_id", "doc_id"], "left_semi")


@query("entity_sources", """
SELECT e.entity_id, d.doc_id, d.source_url FROM (SELECT DISTINCT entity_id, school_id, unnest(source_doc_ids) AS doc_id FROM entities) e
JOIN notice_docs d ON e.doc_id = d.doc_id AND e.school_id = d.school_id""")  # fmt: skip
def entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "entities").select("entity_id", "school_id", F.explode("source_doc_ids").alias("doc_id")).distinct()
    return ids.join(table(spark, sf_dir, "notice_docs").select("school_id", "doc_id", "source_url"), ["school_id", "doc_id"]).select("entity_id", "doc_id", "source_url")


@query("graph_type_counts", "SELECT type, count(DISTINCT entity_id) AS n FROM entities GROUP BY 1")
def graph_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").groupBy("type").agg(F.count_distinct("entity_id").alias("n")).orderBy(F.desc("n"), "type")


@query("props_json_extract", """
SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1""")  # fmt: skip
def props_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total"))


# ---------------------------------------------------------------- vectors and retrieval: odd vec_id ask, even vec_id are the items


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"), "label")
    return asked, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("i_vec"), "label")


_SCORED = """WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS item_id, e.label, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) + 0.0 AS score FROM embeddings e JOIN q ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) """


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("vector_topk_cosine", _SCORED.format(on="true") + "SELECT query_id, item_id, score, rank FROM r WHERE rank <= 5")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, items = _vectors(spark, sf_dir)
    return _rounded(vector.top_k(asked.drop("label"), items.drop("label"), 5)).select("query_id", "item_id", "score", "rank")


@query("vector_topk_pool_filter", _SCORED.format(on="e.label = q.label") + "SELECT query_id, item_id, score, rank FROM r WHERE rank <= 5")
def vector_topk_pool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, items = _vectors(spark, sf_dir)
    return _rounded(vector.top_k(asked, items, 5, ("label",))).select("query_id", "item_id", "score", "rank")


@query("vector_topk_threshold", _SCORED.format(on="e.label = q.label") + "SELECT query_id, item_id, score, rank FROM r WHERE rank <= 5 AND score >= 0.3")
def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.above(vector_topk_pool_filter(spark, sf_dir), 0.3)


@query("hybrid_fallback_stage", _SCORED.format(on="e.label = q.label AND e.vec_id <> q.query_id") + """,
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS k FROM s WHERE item_id % 2 = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS k FROM s WHERE item_id % 2 = 0),
a AS (SELECT query_id, item_id, score, k, 'graph' AS stage FROM g WHERE k <= 5 AND score >= 0.6),
b AS (SELECT query_id, item_id, score, k, 'document' AS stage FROM d WHERE k <= 5 AND score >= 0.3 AND query_id NOT IN (SELECT query_id FROM a))
SELECT query_id AS question_id, item_id, stage, score, k AS rank FROM a UNION ALL SELECT query_id, item_id, stage, score, k FROM b""")  # fmt: skip
def hybrid_fallback_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, items = _vectors(spark, sf_dir)
    pools = []
    for odd in (1, 0):
        best = vector.top_k(asked, items.filter(F.col("item_id") % 2 == odd), 6, ("label",)).filter("item_id <> query_id")
        pools.append(_rounded(best).withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")).cast("bigint")).filter("rank <= 5"))
    return rag.hybrid(pools[0], pools[1])


_HITS_SQL = """hits AS (SELECT school_id AS question_id, doc_id, source_url AS url, title, page, content,
 row_number() OVER (PARTITION BY school_id ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM notice_docs QUALIFY rank <= 5)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.Window.partitionBy("question_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")).cast("bigint")
    docs = table(spark, sf_dir, "notice_docs").select(F.col("school_id").alias("question_id"), "doc_id", F.col("source_url").alias("url"), "title", "page", "content")
    return docs.withColumn("rank", rank).filter("rank <= 5")


@query("source_dedupe_first", f"WITH {_HITS_SQL} SELECT question_id, url, arg_min(struct_pack(t := title), rank).t AS title, min(rank) AS place FROM hits WHERE url <> '' GROUP BY 1, 2")
def source_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.first_titles(_hits(spark, sf_dir)).select("question_id", "url", "title", "place")


@query("source_page_merge", f"""WITH {_HITS_SQL}, m AS (SELECT question_id, url, arg_min(struct_pack(t := title), rank).t AS title, list_sort(list(DISTINCT page) FILTER (WHERE page IS NOT NULL)) AS pages FROM hits GROUP BY 1, 2)
SELECT question_id, url, CASE WHEN len(pages) > 0 THEN coalesce(nullif(title, ''), '(제목 없음)') || ' - ' || array_to_string(pages, ', ') || '페이지' ELSE coalesce(nullif(title, ''), '(제목 없음)') END AS label FROM m""")  # fmt: skip
def source_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.merge_sources(_hits(spark, sf_dir)).select("question_id", "url", "label")


@query("context_assembly", f"""WITH {_HITS_SQL} SELECT question_id, string_agg('[근거 ' || rank || '] ' || CASE WHEN page IS NULL THEN coalesce(nullif(title, ''), '(제목 없음)')
 ELSE coalesce(nullif(title, ''), '(제목 없음)') || ' - ' || page || '페이지' END || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1""")  # fmt: skip
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.contexts(_hits(spark, sf_dir))


# ---------------------------------------------------------------- graph: order lines as edges from orders to parts

_EDGES_SQL = """edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey AS src, l_partkey AS tgt, l_returnflag AS relation, [l_suppkey] AS doc_ids FROM lineitem)"""


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("tgt"), F.col("l_returnflag").alias("relation"),
        F.array("l_suppkey").alias("doc_ids"),
    )


_TOUCH_SQL = f"{_EDGES_SQL}, touch AS (SELECT src AS node, tgt AS other, * FROM edges UNION ALL SELECT tgt, src, * FROM edges WHERE src <> tgt)"
_TOP_SQL = f"WITH {_TOUCH_SQL}, top AS (SELECT node, count(*) AS degree FROM touch GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)"


@query("degree_topk", f"{_TOP_SQL} SELECT node, degree FROM top")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_top(edges_of(spark, sf_dir), 100)


@query("neighbors_1hop", f"{_TOP_SQL} SELECT DISTINCT edge_id, src, tgt, relation FROM touch WHERE node IN (SELECT node FROM top ORDER BY degree DESC, node LIMIT 10)")
def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    return graph.neighbours(edges, graph.degree_top(edges, 10)).select("edge_id", "src", "tgt", "relation").distinct()


@query("induced_subgraph", f"{_TOP_SQL} SELECT edge_id, src, tgt FROM edges WHERE src IN (SELECT node FROM top) AND tgt IN (SELECT node FROM top)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    top, _ = small_side(graph.degree_top(edges, 100))
    return graph.induced(edges, top).select("edge_id", "src", "tgt")


@query("subgraph_degree", f"""{_TOP_SQL}, inner_edges AS (SELECT src, tgt FROM edges WHERE src IN (SELECT node FROM top) AND tgt IN (SELECT node FROM top)),
ends AS (SELECT src AS node FROM inner_edges UNION ALL SELECT tgt FROM inner_edges)
SELECT top.node, count(ends.node) AS degree FROM top LEFT JOIN ends ON top.node = ends.node GROUP BY 1""")  # fmt: skip
def subgraph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    top, _ = small_side(graph.degree_top(edges, 100).select("node"))
    return graph.subgraph_degree(top, edges)


@query("entity_detail_neighbors", f"{_TOP_SQL} SELECT node, relation, count(DISTINCT other) AS others FROM touch WHERE node IN (SELECT node FROM top) GROUP BY 1, 2")
def entity_detail_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    top, _ = small_side(graph.degree_top(edges, 100).select("node"))
    return graph.touching(edges).join(top, "node", "left_semi").groupBy("node", "relation").agg(F.count_distinct("other").alias("others"))


@query("name_resolution", """
WITH names AS (SELECT DISTINCT school_id AS chunk, name, entity_id FROM entities WHERE name IS NOT NULL),
rel AS (SELECT DISTINCT a.school_id AS chunk, a.name AS source, b.name AS target FROM entities a JOIN entities b ON a.school_id = b.school_id AND b.entity_id = a.entity_id + 1 WHERE a.name IS NOT NULL AND b.name IS NOT NULL),
n AS (SELECT chunk, name, count(*) AS k, min(entity_id) AS id FROM names GROUP BY 1, 2)
SELECT r.chunk, r.source, r.target, CASE WHEN s.k = 1 AND t.k = 1 THEN 'resolved' WHEN s.k > 1 OR t.k > 1 THEN 'ambiguous' ELSE 'unknown' END AS state,
CASE WHEN s.k = 1 THEN s.id END AS source_id, CASE WHEN t.k = 1 THEN t.id END AS target_id
FROM rel r LEFT JOIN n s ON r.chunk = s.chunk AND r.source = s.name LEFT JOIN n t ON r.chunk = t.chunk AND r.target = t.name""")  # fmt: skip
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").filter("name is not null").select(F.col("school_id").alias("chunk"), "name", "entity_id")
    after = e.select("chunk", F.col("name").alias("target"), (F.col("entity_id") - 1).alias("entity_id"))
    relations = e.withColumnRenamed("name", "source").join(after, ["chunk", "entity_id"]).select("chunk", "source", "target").distinct()
    return graph.resolve_names(relations, e)


@query("fact_sentences", """
WITH edges AS (SELECT o_orderkey AS edge_id, c_custkey AS src, c_nationkey AS tgt, o_orderstatus AS relation FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT edge_id, '- ' || c_name || ' —' || relation || '→ ' || n_name || ' (출처: ' || 'order/' || edge_id || ')' AS fact
FROM edges JOIN customer ON src = c_custkey JOIN nation ON tgt = n_nationkey""")  # fmt: skip
def fact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    nation = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("node"), F.col("n_name").alias("name"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    edges = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("edge_id"), F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey")).cast("bigint").alias("tgt"), F.col("o_orderstatus").alias("relation"), F.array("o_orderkey").alias("doc_ids"),
    )
    names = customer.select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name")).unionByName(nation)
    return rag.fact_lines(edges, names, orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order/"), "o_orderkey").alias("url")))


# ---------------------------------------------------------------- quality: schools' pages as listing items, crawls by page number

_BOARD_SQL = """board AS (SELECT school_id, page_id // 100 AS run, count(*) AS listing_rows,
 coalesce(avg(CASE WHEN trim(title_hint) <> '' THEN 1.0 ELSE 0.0 END), 0.0) AS title_ratio, coalesce(avg(CASE WHEN published_at_hint IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) AS date_ratio
 FROM crawled_pages GROUP BY 1, 2)"""


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").select("school_id", F.floor(F.col("page_id") / 100).alias("run"), F.col("title_hint").alias("title"), F.col("published_at_hint").alias("published_at"))
    return quality.board_quality(pages, ["school_id", "run"])


@query("quality_ratios", f"WITH {_BOARD_SQL} SELECT school_id, run, listing_rows, round(title_ratio, 9) AS title_ratio, round(date_ratio, 9) AS date_ratio FROM board")
def quality_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boards(spark, sf_dir).select("school_id", "run", "listing_rows", F.round("title_ratio", 9).alias("title_ratio"), F.round("date_ratio", 9).alias("date_ratio"))


@query("quality_rollup", f"WITH {_BOARD_SQL} SELECT s.school_id, count(b.run) AS boards, CASE WHEN count(b.run) = 0 THEN 'unknown' WHEN bool_and(listing_rows >= 1 AND title_ratio >= 0.9 AND date_ratio >= 0.7) THEN 'ok' ELSE 'warning' END AS state FROM schools s LEFT JOIN board b USING (school_id) GROUP BY 1")
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rollup(_boards(spark, sf_dir).withColumn("checked_at", F.col("run")), table(spark, sf_dir, "schools"), "school_id").drop("checked_at")


@query("latest_crawl_quality", f"WITH {_BOARD_SQL} SELECT b.school_id, b.run, b.listing_rows FROM board b JOIN (SELECT school_id, max(run) AS run FROM board GROUP BY 1) l ON b.school_id = l.school_id AND b.run = l.run")
def latest_crawl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest_run(_boards(spark, sf_dir).withColumn("at", F.col("run")), "school_id", "run", "at").select("school_id", "run", "listing_rows")


@query("listing_drop", f"WITH {_BOARD_SQL}, l AS (SELECT *, lag(listing_rows) OVER (PARTITION BY school_id ORDER BY run) AS previous FROM board) SELECT school_id, run, previous, coalesce(previous > 0 AND listing_rows < previous * 0.5, false) AS dropped FROM l")
def listing_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drops(_boards(spark, sf_dir), ["school_id"], "run", "listing_rows").select("school_id", "run", "previous", "dropped")


@query("spec_acceptance", f"""WITH {_BOARD_SQL}, f AS (
 SELECT school_id, CASE WHEN title_ratio < 0.9 THEN 'MISSING_TITLES' END AS code FROM board UNION ALL SELECT school_id, CASE WHEN date_ratio < 0.7 THEN 'MISSING_DATES' END FROM board
 UNION ALL SELECT school_id, CASE WHEN length(trim(content, chr(10) || ' ')) < 50 THEN 'EMPTY_CONTENT' END FROM notice_docs)
SELECT school_id, count(*) FILTER (WHERE code = 'MISSING_TITLES') = 0 AND (count(*) FILTER (WHERE code = 'EMPTY_CONTENT') = 0 OR count(*) FILTER (WHERE code = 'EMPTY_CONTENT') <= any_value(n) // 2) AS accepted
FROM f JOIN (SELECT school_id, count(*) AS n FROM notice_docs GROUP BY 1) USING (school_id) GROUP BY 1""")  # fmt: skip
def spec_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = _boards(spark, sf_dir).select("school_id", F.explode_outer("findings").alias("code"))
    docs = table(spark, sf_dir, "notice_docs")
    short = docs.select("school_id", F.when(F.length(F.expr("trim(BOTH '\\n ' FROM content)")) < quality.MIN_CONTENT, "EMPTY_CONTENT").alias("code"))
    samples = docs.groupBy("school_id").agg(F.count("*").alias("samples"))
    return quality.acceptable(boards.unionByName(short).join(samples, "school_id"), ["school_id"], "samples")
