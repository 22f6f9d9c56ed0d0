"""Merges, incremental state, crawl rules, text, URL, date and HTML queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noticeforge.catalog import query
from noticeforge.functions import html, text, times, urls
from noticeforge.operators import crawl, store
from noticeforge.operators.read_queries import _EDGES_SQL, edges_of
from noticeforge.plans.joins import small_side
from noticeforge.sources.tables import table

# ---------------------------------------------------------------- merges


@query("entity_merge", """
WITH e AS (SELECT DISTINCT entity_id AS ord, school_id, norm_key, type, name, source_doc_ids FROM entities WHERE len(source_doc_ids) > 0 AND norm_key IS NOT NULL),
d AS (SELECT school_id, norm_key, list_sort(list(DISTINCT x)) AS source_doc_ids FROM (SELECT school_id, norm_key, unnest(source_doc_ids) AS x FROM e) WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT school_id, norm_key, arg_min(struct_pack(t := type), ord).t AS type, arg_min(struct_pack(t := name), ord).t AS name, any_value(d.source_doc_ids) AS source_doc_ids FROM e JOIN d USING (school_id, norm_key) GROUP BY 1, 2""")  # fmt: skip
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entities").filter("norm_key is not null").withColumn("ord", F.col("entity_id"))
    return store.merge_entities(rows).drop("attributes")


@query("entity_attributes_merge", """
WITH a AS (SELECT DISTINCT entity_id AS ord, school_id, norm_key, unnest(map_keys(attributes)) AS k, unnest(map_values(attributes)) AS v FROM entities WHERE len(source_doc_ids) > 0 AND norm_key IS NOT NULL)
SELECT school_id, norm_key, k, arg_max(struct_pack(v := v), ord).v AS v FROM a GROUP BY 1, 2, 3""")  # fmt: skip
def entity_attributes_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entities").filter("norm_key is not null").withColumn("ord", F.col("entity_id"))
    return store.merge_entities(rows).select("school_id", "norm_key", F.explode("attributes").alias("k", "v"))


@query("edge_merge", """
SELECT l_orderkey AS src, l_partkey AS tgt, l_returnflag AS relation, list_sort(list(DISTINCT l_suppkey)) AS doc_ids FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2, 3""")  # fmt: skip
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"))
    return store.merge_edges(edges_of(spark, sf_dir), nodes)


@query("edge_endpoint_guard", f"WITH {_EDGES_SQL} SELECT relation, count(*) AS n, count(*) FILTER (WHERE tgt NOT IN (SELECT o_orderkey FROM orders)) AS rejected FROM edges GROUP BY 1")
def edge_endpoint_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tgt")).distinct().withColumn("known", F.lit(True))
    return edges_of(spark, sf_dir).join(nodes, "tgt", "left").groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("rejected"))


_DOC_KEY = ["school_id", "source_url", "content_hash", "chunk_index"]
_DOCS_SQL = """t AS (SELECT doc_id, school_id, source_url, content_hash, chunk_index, title, miss_count FROM notice_docs WHERE doc_id % 3 <> 0),
s AS (SELECT school_id, source_url, content_hash, chunk_index, arg_max(struct_pack(x := title), doc_id).x AS title FROM notice_docs WHERE doc_id % 2 = 0 GROUP BY 1, 2, 3, 4)"""


def _docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored part of the documents, and an arriving part that overlaps it."""
    d = table(spark, sf_dir, "notice_docs").select("doc_id", *_DOC_KEY, "title", "miss_count")
    arriving = store.latest(d.filter("doc_id % 2 = 0"), _DOC_KEY, [F.col("doc_id")]).drop("doc_id")
    return d.filter("doc_id % 3 <> 0"), arriving.drop("miss_count")


@query("document_upsert", f"""WITH {_DOCS_SQL}, m AS (
 SELECT t.doc_id, coalesce(t.school_id, s.school_id) AS school_id, coalesce(t.source_url, s.source_url) AS source_url, coalesce(t.content_hash, s.content_hash) AS content_hash,
 coalesce(t.chunk_index, s.chunk_index) AS chunk_index, CASE WHEN s.school_id IS NOT NULL THEN s.title ELSE t.title END AS title, CASE WHEN s.school_id IS NOT NULL THEN 0 ELSE t.miss_count END AS miss_count
 FROM t FULL OUTER JOIN s ON t.school_id = s.school_id AND t.source_url = s.source_url AND t.content_hash = s.content_hash AND t.chunk_index = s.chunk_index)
SELECT coalesce(doc_id, (SELECT max(doc_id) FROM t) + row_number() OVER (PARTITION BY doc_id IS NULL ORDER BY school_id, source_url, content_hash, chunk_index)) AS doc_id, school_id, source_url, content_hash, chunk_index, title, miss_count FROM m""")  # fmt: skip
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, arriving = _docs(spark, sf_dir)
    return store.upsert(stored, arriving, _DOC_KEY, ["title"], {"miss_count": F.lit(0)}, "doc_id")


@query("attachment_upsert", """
WITH f AS (SELECT school_id, file_hash, arg_max(filename, attachment_id) AS filename, max(attachment_id) AS last FROM (SELECT DISTINCT * FROM attachments) WHERE file_hash IS NOT NULL GROUP BY 1, 2)
SELECT school_id, file_hash, filename, last % 2 = 0 AS again FROM f""")  # fmt: skip
def attachment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "attachments").filter("file_hash is not null").select("attachment_id", "school_id", "file_hash", "filename")
    key = ["school_id", "file_hash"]
    last = store.latest(a, key, [F.col("attachment_id")])
    # Rows of odd ids are stored, all rows arrive: the newest name holds, whether it is new or known.
    stored = store.latest(a.filter("attachment_id % 2 = 1"), key, [F.col("attachment_id")]).select(*key, "filename")
    merged = store.upsert(stored, last.select(*key, "filename"), key, ["filename"])
    return merged.join(last.select(*key, "attachment_id"), key).select(*key, "filename", (F.col("attachment_id") % 2 == 0).alias("again"))


@query("spec_upsert", """
SELECT host, max(school_id) AS version FROM (SELECT school_id, regexp_extract(lower(base_url), '^[a-z]+://([^/?#]*)', 1) AS host FROM schools WHERE base_url IS NOT NULL) GROUP BY 1""")  # fmt: skip
def spec_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "schools").filter("base_url is not null").select(F.regexp_extract(F.lower("base_url"), "^[a-z]+://([^/?#]*)", 1).alias("host"), F.col("school_id").alias("version"))
    stored = store.latest(specs.filter("version % 2 = 0"), ["host"], [F.col("version")])
    arriving = store.latest(specs, ["host"], [F.col("version")])
    return store.upsert(stored, arriving, ["host"], ["version"])


@query("miss_count_update", """
WITH o AS (SELECT DISTINCT school_id, source_url FROM notice_docs WHERE doc_id % 4 = 0)
SELECT d.doc_id, CAST(CASE WHEN d.source_type <> 'web' OR d.expired_at IS NOT NULL OR d.school_id NOT IN (SELECT school_id FROM o) THEN d.miss_count WHEN o.source_url IS NOT NULL THEN 0 ELSE coalesce(d.miss_count, 0) + 1 END AS INTEGER) AS miss_count
FROM notice_docs d LEFT JOIN o ON d.school_id = o.school_id AND d.source_url = o.source_url""")  # fmt: skip
def miss_count_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "notice_docs")
    return store.observe(docs, docs.filter("doc_id % 4 = 0").select("school_id", "source_url")).select("doc_id", "miss_count")


@query("expire_by_miss", "SELECT doc_id, expired_at IS NOT NULL OR coalesce(miss_count >= 3, false) AS expired FROM notice_docs")
def expire_by_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.expire(table(spark, sf_dir, "notice_docs"), F.lit("2026-01-01").cast("timestamp")).select("doc_id", F.col("expired_at").isNotNull().alias("expired"))


@query("miss_streak", """
WITH r AS (SELECT DISTINCT school_id, snapshot_no FROM doc_snapshots), u AS (SELECT DISTINCT school_id, source_url FROM doc_snapshots),
l AS (SELECT school_id, source_url, max(snapshot_no) AS last FROM doc_snapshots GROUP BY 1, 2)
SELECT u.school_id, u.source_url, count(*) FILTER (WHERE r.snapshot_no > l.last) AS streak FROM u JOIN r ON u.school_id = r.school_id JOIN l ON u.school_id = l.school_id AND u.source_url = l.source_url GROUP BY 1, 2""")  # fmt: skip
def miss_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "doc_snapshots").select("school_id", "source_url", "snapshot_no").distinct().withColumn("seen", F.lit(True))
    runs, _ = small_side(rows.select("school_id", "snapshot_no").distinct())
    grid = rows.select("school_id", "source_url").distinct().join(runs, "school_id").join(rows, ["school_id", "source_url", "snapshot_no"], "left")
    return crawl.miss_streaks(grid.withColumn("seen", F.coalesce("seen", F.lit(False))), ["school_id", "source_url"], "snapshot_no")


@query("seed_reconcile", """
WITH t AS (SELECT school_id AS id, trim(name) AS name FROM schools WHERE school_id % 3 <> 0), s AS (SELECT school_id AS id, CASE WHEN school_id % 5 = 0 THEN upper(trim(name)) || '!' ELSE trim(name) END AS name FROM schools WHERE school_id % 4 <> 0)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN t.id IS NULL THEN 'created' WHEN s.id IS NULL THEN 'kept' WHEN t.name IS NOT DISTINCT FROM s.name THEN 'unchanged' ELSE 'updated' END AS action FROM t FULL OUTER JOIN s ON t.id = s.id) GROUP BY 1""")  # fmt: skip
def seed_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "schools").select(F.col("school_id").alias("id"), F.trim("name").alias("name"))
    seed = s.filter("id % 4 <> 0").withColumn("name", F.when(F.col("id") % 5 == 0, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")))
    return store.reconcile(s.filter("id % 3 <> 0"), seed, "id", ["name"]).groupBy("action").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- crawl


@query("change_detection", """
WITH k AS (SELECT DISTINCT school_id, source_url, content_hash FROM doc_snapshots WHERE snapshot_no <= 3), p AS (SELECT DISTINCT school_id, source_url, content_hash FROM doc_snapshots WHERE snapshot_no = 4)
SELECT crawl_status, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.school_id = p.school_id AND k.source_url = p.source_url AND k.content_hash = p.content_hash) THEN 'unchanged'
 WHEN EXISTS (SELECT 1 FROM k WHERE k.school_id = p.school_id AND k.source_url = p.source_url) THEN 'changed' ELSE 'new' END AS crawl_status FROM p) GROUP BY 1""")  # fmt: skip
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "doc_snapshots").select("snapshot_no", "school_id", F.col("source_url").alias("url"), "content_hash")
    pages = rows.filter("snapshot_no = 4").drop("snapshot_no").distinct()
    return crawl.classify_changes(pages, rows.filter("snapshot_no <= 3").drop("snapshot_no")).groupBy("crawl_status").agg(F.count("*").alias("n"))


_PAGES_SQL = "p AS (SELECT DISTINCT page_id, school_id, coalesce(category_hint, '') AS board FROM crawled_pages)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawled_pages").select("page_id", "school_id", F.coalesce("category_hint", F.lit("")).alias("board")).distinct()


@query("round_robin_frontier", f"""WITH {_PAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY school_id, board ORDER BY page_id) AS turn FROM p)
SELECT page_id, turn, row_number() OVER (PARTITION BY school_id ORDER BY turn, board) AS place FROM r WHERE turn <= 300""")  # fmt: skip
def round_robin_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.round_robin(_pages(spark, sf_dir), "school_id", "board", "page_id").select("page_id", "turn", "place")


@query("budget_cutoff", f"WITH {_PAGES_SQL}, c AS (SELECT school_id, page_id, sum(1 + page_id % 3) OVER (PARTITION BY school_id ORDER BY page_id) AS spent FROM p) SELECT school_id, page_id, CAST(spent AS BIGINT) AS spent FROM c WHERE spent <= 50")
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).withColumn("cost", 1 + F.col("page_id") % 3)
    return crawl.within_budget(pages, "school_id", ["page_id"], "cost", 50).select("school_id", "page_id", "spent")


@query("early_stop", """
WITH l AS (SELECT school_id, page_id // 10 AS listing, bool_and(crawl_status = 'unchanged') AS same FROM crawled_pages GROUP BY 1, 2),
m AS (SELECT *, coalesce(bool_or(same) OVER (PARTITION BY school_id ORDER BY listing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stop FROM l)
SELECT school_id, listing, same FROM m WHERE NOT stop""")  # fmt: skip
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "crawled_pages").groupBy("school_id", F.floor(F.col("page_id") / 10).alias("listing")).agg(F.bool_and(F.col("crawl_status") == "unchanged").alias("same"))
    return crawl.early_stop(listing, ["school_id"], "listing", "same")


@query("url_first_seen", "SELECT source_url, min(page_id) AS page_id FROM crawled_pages GROUP BY 1")
def url_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.first_seen(table(spark, sf_dir, "crawled_pages").select("source_url", "page_id"), ["source_url"], ["page_id"])


@query("node_cap_cutoff", """
WITH f AS (SELECT DISTINCT school_id, entity_id // 10 AS ord, norm_key FROM entities WHERE norm_key IS NOT NULL), n AS (SELECT school_id, norm_key, min(ord) AS ord FROM f GROUP BY 1, 2),
s AS (SELECT school_id, ord, count(n.norm_key) AS new FROM (SELECT DISTINCT school_id, ord FROM f) f LEFT JOIN n USING (school_id, ord) GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY school_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT school_id, ord FROM b WHERE before < 20""")  # fmt: skip
def node_cap_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "entities").filter("norm_key is not null").select("school_id", F.floor(F.col("entity_id") / 10).alias("ord"), "norm_key")
    return crawl.node_cap(chunks, "school_id", "ord", "norm_key", 20)


@query("scope_filter", r"""
SELECT page_id, regexp_extract(lower(source_url), '^[a-z][a-z0-9+.\-]*://([^/:?#]*)', 1) IN ('www.tolso.ac.example', 'vagar.ac.example')
 AND regexp_matches(source_url, '^[A-Za-z]+://[^/?#]*/(?:kr|bbs)/') AS allowed FROM (SELECT DISTINCT page_id, source_url FROM crawled_pages WHERE source_url IS NOT NULL)""")  # fmt: skip
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = crawl.in_scope(F.col("source_url"), ["www.tolso.ac.example", "vagar.ac.example"], ["/kr/", "/bbs/"])
    return table(spark, sf_dir, "crawled_pages").filter("source_url is not null").select("page_id", "source_url").distinct().select("page_id", allowed.alias("allowed"))


@query("robots_longest_match", r"""
WITH u AS (SELECT DISTINCT source_url AS url, regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS path FROM crawled_pages WHERE source_url IS NOT NULL),
m AS (SELECT url, unnest([CASE WHEN starts_with(path, '/bbs/') THEN struct_pack(n := 5, a := false) END, CASE WHEN regexp_matches(path, '^/bbs/.*/artclView') THEN struct_pack(n := 16, a := true) END,
 CASE WHEN regexp_matches(path, '^/kr/.*mode=view$') THEN struct_pack(n := 15, a := false) END]) AS r FROM u)
SELECT url, coalesce(max(r).a, true) AS allowed FROM m GROUP BY 1""")  # fmt: skip
def robots_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "crawled_pages").filter("source_url is not null").select(F.col("source_url").alias("url")).distinct()
    hosts = seen.select(urls.origin(F.col("url")).alias("origin")).distinct()
    patterns = spark.createDataFrame([(False, "/bbs/"), (True, "/bbs/*/artclView"), (False, "/kr/*mode=view$")], "allow boolean, pattern string")
    return crawl.robots_allowed(seen, hosts.join(F.broadcast(patterns)))


# ---------------------------------------------------------------- text

_NORM = r"array_to_string(list_filter(list_transform(regexp_split_to_array({t}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[\s\p{{Z}}\x0b]+|[\s\p{{Z}}\x0b]+$', '', 'g')), lambda x: x <> ''), chr(10))"


@query("normalize_text", f"SELECT doc_id, md5({_NORM.format(t='content')}) AS h FROM notice_docs WHERE content IS NOT NULL")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").filter("content is not null").select("doc_id", F.md5(text.normalize_text(F.col("content"))).alias("h"))


def _squash_sql(t: str) -> str:
    return rf"lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def _bare_sql(c: str) -> str:
    return _squash_sql(f"regexp_replace({c}, '(새글|NEW|N|공지|첨부파일|분류|작성자|조회수|등록일)', ' ', 'gi')")


#: Full-width letters and digits and what NFKC makes of them: the only ones of the test tables that it changes.
_WIDE, _NARROW = ("".join(chr(c + d) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))) for d in (0xFEE0, 0))


def _key_sql(c: str) -> str:
    return _squash_sql(f"translate(nfc_normalize({c}), '{_WIDE}', '{_NARROW}')")


@query("norm_key", f"SELECT DISTINCT entity_id, {_key_sql('type')} || ':' || {_key_sql('name')} AS k FROM entities")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select("entity_id", text.norm_key(F.col("type"), F.col("name")).alias("k")).distinct()


@query("squash_text", r"SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS h FROM documents WHERE text IS NOT NULL")
def squash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(text.squash(F.col("text"))).alias("h"))


@query("content_hash", "SELECT doc_id, sha256(content) AS h FROM notice_docs WHERE content IS NOT NULL")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").filter("content is not null").select("doc_id", F.sha2("content", 256).alias("h"))


_CHUNK_SQL = rf"""
WITH t AS (SELECT doc_id, {_NORM.format(t="content")} AS n FROM notice_docs WHERE content IS NOT NULL),
w AS (SELECT doc_id, n, list_transform(string_split(n, chr(10)), lambda p: struct_pack(o := CAST([] AS VARCHAR[]), c := p)) AS ps FROM t),
f AS (SELECT doc_id, n, list_reduce(ps, lambda a, b: CASE
  WHEN length(b.c) > 2000 THEN struct_pack(o := list_concat(CASE WHEN a.c = '' THEN a.o ELSE list_append(a.o, a.c) END, list_transform(range(0, (length(b.c) - 1) // 1800 + 1), lambda i: substring(b.c, CAST(i * 1800 + 1 AS BIGINT), 2000))), c := '')
  WHEN a.c = '' THEN struct_pack(o := a.o, c := b.c)
  WHEN length(a.c) + 2 + length(b.c) <= 2000 THEN struct_pack(o := a.o, c := a.c || chr(10) || chr(10) || b.c)
  ELSE struct_pack(o := list_append(a.o, a.c), c := regexp_replace(right(a.c, 200) || chr(10) || chr(10) || b.c, '^\s+|\s+$', '', 'g')) END, struct_pack(o := CAST([] AS VARCHAR[]), c := '')) AS s FROM w)
SELECT doc_id, CASE WHEN n = '' THEN 0 WHEN length(n) <= 2000 THEN 1 ELSE len(s.o) + CASE WHEN s.c = '' THEN 0 ELSE 1 END END AS chunks,
 md5(CASE WHEN n = '' THEN '' WHEN length(n) <= 2000 THEN n ELSE array_to_string(CASE WHEN s.c = '' THEN s.o ELSE list_append(s.o, s.c) END, '|') END) AS h FROM f"""


@query("chunk_documents", _CHUNK_SQL)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "notice_docs").filter("content is not null").select("doc_id", text.chunks(F.col("content")).alias("c"))
    return docs.select("doc_id", F.size("c").cast("bigint").alias("chunks"), F.md5(F.array_join("c", "|")).alias("h"))


@query("split_long_paragraph", "SELECT doc_id, CASE WHEN length(content) > 0 THEN (length(content) - 1) // 1800 + 1 ELSE 0 END AS n, CASE WHEN length(content) > 0 THEN substring(content, 1, 2000) ELSE NULL END AS first FROM notice_docs WHERE content IS NOT NULL")
def split_long_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "notice_docs").filter("content is not null").select("doc_id", text.windows(F.col("content")).alias("w"))
    return parts.select("doc_id", F.size("w").cast("bigint").alias("n"), F.get("w", F.lit(0)).alias("first"))


@query("title_match", f"""
WITH p AS (SELECT DISTINCT p.page_id, d.doc_id, p.title_hint, d.title, d.content FROM crawled_pages p JOIN notice_docs d ON p.school_id = d.school_id AND p.source_url = d.source_url),
q AS (SELECT page_id, doc_id, {_bare_sql("coalesce(title_hint, '')")} AS x, {_bare_sql("coalesce(title, '')")} AS y, {_squash_sql("coalesce(title, '') || ' ' || coalesce(content, '')")} AS page FROM p)
SELECT page_id, doc_id, x = '' OR contains(page, x) OR length(y) >= 8 AND contains(x, y) OR length(x) >= 8 AND starts_with(y, x) AS same FROM q""")  # fmt: skip
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "notice_docs").select("doc_id", "school_id", "source_url", "title", "content")
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", "school_id", "source_url", "title_hint").distinct().join(docs, ["school_id", "source_url"])
    return pages.select("page_id", "doc_id", text.titles_match(F.col("title_hint"), F.col("title"), F.col("content")).alias("same"))


@query("adjacent_dedupe", r"""
WITH l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS no FROM notice_docs WHERE content IS NOT NULL),
k AS (SELECT doc_id, no, trim(regexp_replace(line, '[\s\x0b]+', ' ', 'g')) AS k FROM l) SELECT doc_id, count(*) AS kept FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY no) AS b FROM k) WHERE k IS DISTINCT FROM b GROUP BY 1""")  # fmt: skip
def adjacent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "notice_docs").filter("content is not null").select("doc_id", F.posexplode(F.split("content", "\n")).alias("no", "line"))
    return crawl.adjacent_dedupe(lines, ["doc_id"], "no", "line").groupBy("doc_id").agg(F.count("*").alias("kept"))


# ---------------------------------------------------------------- URLs, dates and schedules

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


@query("url_normalize", rf"""
SELECT DISTINCT source_url, lower(regexp_extract(source_url, '{_URL}', 1)) || '://' || lower(regexp_extract(source_url, '{_URL}', 2)) || CASE WHEN regexp_replace(regexp_extract(source_url, '{_URL}', 3), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(source_url, '{_URL}', 3), '/+$', '') END
 || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM (SELECT source_url, array_to_string(list_sort(list_filter(string_split(regexp_extract(source_url, '{_URL}', 4), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid'))), '&') AS q FROM crawled_pages WHERE source_url IS NOT NULL)""")  # fmt: skip
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").filter("source_url is not null").select("source_url").distinct()
    return pages.select("source_url", urls.normalize_url(F.col("source_url"), root="/").alias("url"))


@query("url_pattern_groups", r"SELECT school_id, regexp_replace(source_url, '[0-9]+', '#', 'g') AS pattern, count(*) AS n FROM crawled_pages GROUP BY 1, 2 HAVING count(*) >= 3")
def url_pattern_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawled_pages").groupBy("school_id", urls.url_pattern(F.col("source_url")).alias("pattern")).agg(F.count("*").alias("n")).filter("n >= 3")


@query("url_origin", r"SELECT DISTINCT source_url, lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || lower(regexp_extract(source_url, '://([^/?#]*)', 1)) AS origin FROM crawled_pages WHERE source_url IS NOT NULL")
def url_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawled_pages").filter("source_url is not null").select("source_url", urls.origin(F.col("source_url")).alias("origin")).distinct()


@query("parse_date", r"""
WITH d AS (SELECT DISTINCT entity_id, v FROM (SELECT entity_id, unnest(map_values(attributes)) AS v FROM entities) WHERE v IS NOT NULL),
p AS (SELECT *, regexp_extract(v, '(\d{4})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})', ['y', 'm', 'd']) AS l, regexp_extract(v, '\b(\d{2})[./-](\d{1,2})[./-](\d{1,2})\b', ['y', 'm', 'd']) AS s FROM d)
SELECT entity_id, v, CASE WHEN l.y <> '' THEN CAST(try_cast(l.y || '-' || lpad(l.m, 2, '0') || '-' || lpad(l.d, 2, '0') AS DATE) AS VARCHAR) WHEN s.y <> '' THEN CAST(try_cast('20' || s.y || '-' || lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') AS DATE) AS VARCHAR) END AS day FROM p""")  # fmt: skip
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "entities").select("entity_id", F.explode("attributes").alias("k", "v")).filter("v is not null").select("entity_id", "v").distinct()
    return values.select("entity_id", "v", times.parse_date(F.col("v")).cast("date").cast("string").alias("day"))


@query("parse_schedule", r"""
WITH s AS (SELECT school_id, lower(trim(coalesce(crawl_schedule, ''))) AS s FROM schools), n AS (SELECT *, CASE s WHEN 'hourly' THEN 3600 WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 604800 WHEN 'monthly' THEN 2592000
 ELSE CASE WHEN regexp_full_match(s, '[0-9]{1,12}(\s*[smhd])?') THEN CAST(regexp_extract(s, '^([0-9]+)', 1) AS BIGINT) * CASE right(s, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END END END AS seconds FROM s)
SELECT school_id, CASE WHEN s IN ('', 'disabled', 'none', 'null') THEN 'disabled' WHEN seconds IS NOT NULL THEN 'interval' WHEN regexp_full_match(s, '\S+(\s+\S+){4}') THEN 'cron' ELSE 'invalid' END AS kind, CAST(seconds AS BIGINT) AS seconds FROM n""")  # fmt: skip
def parse_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("crawl_schedule")
    return table(spark, sf_dir, "schools").select("school_id", times.schedule_kind(s).alias("kind"), times.schedule_seconds(s).alias("seconds"))


@query("cron_match", """
SELECT event_id, minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND month(ts) IN (1, 3, 5) AND (dayofmonth(ts) = 1 OR dayofweek(ts) IN (0, 1)) AS due FROM events""")  # fmt: skip
def cron_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", times.cron_matches(F.lit("*/15 8-17 1 1,3,5 1,7"), F.col("ts")).alias("due"))


@query("next_interval_run", "SELECT school_id, CAST(epoch(updated_at) AS BIGINT) + CASE crawl_schedule WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 604800 WHEN 'hourly' THEN 3600 WHEN '12h' THEN 43200 WHEN '3600' THEN 3600 END AS next FROM schools WHERE crawl_schedule IN ('daily', 'weekly', 'hourly', '12h', '3600')")
def next_interval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = table(spark, sf_dir, "schools").filter(F.col("crawl_schedule").isin("daily", "weekly", "hourly", "12h", "3600"))
    return due.select("school_id", F.unix_timestamp(times.next_run(F.col("updated_at"), F.col("crawl_schedule"))).alias("next"))


@query("backoff_seconds", "SELECT DISTINCT doc_id, CAST(least(86400, 60 * power(2, least(greatest(coalesce(miss_count, 0), 1), 10) - 1)) AS BIGINT) AS wait FROM notice_docs")
def backoff_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").select("doc_id", times.backoff_seconds(F.coalesce("miss_count", F.lit(0))).alias("wait"))


# ---------------------------------------------------------------- files and pages


@query("attachment_chunk_index", "SELECT doc_id, attachment_id, row_number() OVER (PARTITION BY attachment_id ORDER BY page NULLS FIRST, chunk_index, doc_id) - 1 AS file_index FROM notice_docs WHERE attachment_id IS NOT NULL")
def attachment_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.Window.partitionBy("attachment_id").orderBy(F.asc_nulls_first("page"), "chunk_index", "doc_id")) - 1
    return table(spark, sf_dir, "notice_docs").filter("attachment_id is not null").select("doc_id", "attachment_id", place.cast("bigint").alias("file_index"))


@query("attachment_truncation", "SELECT attachment_id, count(*) > 4 AS truncated, least(count(*), 4) AS chunk_count FROM notice_docs WHERE attachment_id IS NOT NULL GROUP BY 1")
def attachment_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf_dir, "notice_docs").filter("attachment_id is not null").groupBy("attachment_id").agg((n > 4).alias("truncated"), F.least(n, F.lit(4)).cast("bigint").alias("chunk_count"))


@query("resolution_priority", """
SELECT p.page_id, coalesce(CASE WHEN s.school_id % 5 = 0 THEN 'dedicated' END, CASE WHEN s.school_id % 3 = 0 THEN 'spec' END, 'common') AS parser FROM (SELECT DISTINCT page_id, school_id FROM crawled_pages) p LEFT JOIN schools s USING (school_id)""")  # fmt: skip
def resolution_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    schools = table(spark, sf_dir, "schools").select("school_id")
    dedicated = schools.filter("school_id % 5 = 0").withColumn("a", F.lit("dedicated"))
    spec = schools.filter("school_id % 3 = 0").withColumn("b", F.lit("spec"))
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", "school_id").distinct()
    return pages.join(dedicated, "school_id", "left").join(spec, "school_id", "left").select("page_id", F.coalesce("a", "b", F.lit("common")).alias("parser"))


@query("html_pages")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", html.read_page("raw_html", "source_url").alias("p"))
    return pages.select("page_id", "p.title", "p.content", "p.text_hash", F.size("p.links").cast("bigint").alias("links"), F.size("p.attachments").cast("bigint").alias("attachments"))


@query("html_links", r"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(raw_html, '<a\s+href=')) FROM crawled_pages WHERE raw_html IS NOT NULL) GROUP BY 1")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").filter("raw_html is not null").select("page_id", html.read_page("raw_html", "source_url")["links"].alias("l"))
    return pages.select("page_id", F.explode("l")).groupBy("page_id").agg(F.count("*").alias("n"))
