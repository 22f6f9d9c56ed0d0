"""Chunks into the store: the graph of extracted chunks, uploaded files, and the typed failures of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.text import attachment_uri, chunks, norm_key, strip
from noticeforge.operators import graph, store
from noticeforge.sources.tables import materialized

#: The most chunks of a file, and HTTP answers that are worth another try.
MAX_CHUNKS = 2000
RETRYABLE = (429, 500, 502, 503, 504)
CHUNK_KEY = ["school_id", "source_url", "content_hash", "chunk_index"]


@dataclass
class Built:
    """documents, entities, edges: the tables after the build. results: one row per chunk."""

    documents: DataFrame
    entities: DataFrame
    edges: DataFrame
    results: DataFrame


def build_graph(extracted: DataFrame, documents: DataFrame, entities: DataFrame, edges: DataFrame) -> Built:
    """The tables (as in store.SCHEMAS) with extracted chunks merged in, and what became of each chunk.

    extracted  school_id, target_school_id (for whom it is built), source_url, title, content, chunk_index, content_hash, crawled_at,
               embedding, entities, relations, extraction_status
    results    the chunk's key, doc_id, entity_ids, edge_ids, status, error_code, retryable, skipped

    A chunk of another school fails (SCHOOL_ID_MISMATCH), one without a vector too (EMBEDDING_FAILED, retryable). Of the others
    the document is upserted, then its entities with a type and a name, then the relations whose two names each belong to one
    entity of the chunk. What is skipped makes the chunk partial, as does a partial extraction. Several chunks with one key
    are one: the latest crawled holds.
    """
    one = store.latest(extracted, CHUNK_KEY, [F.col("crawled_at"), F.xxhash64("content")])
    wrong, bare = ~F.col("school_id").eqNullSafe(F.col("target_school_id")), F.col("embedding").isNull()
    fault = F.when(wrong, "SCHOOL_ID_MISMATCH").when(bare, "EMBEDDING_FAILED")
    told = materialized(one.withColumn("error_code", fault))
    good = told.filter("error_code is null")
    rows = good.select(*CHUNK_KEY, "title", "content", "embedding", "crawled_at", F.lit("web").alias("source_type"))
    reset = {"miss_count": F.lit(0), "expired_at": F.lit(None).cast("timestamp")}
    docs = materialized(store.upsert(documents, rows, CHUNK_KEY, ["title", "content", "embedding", "crawled_at", "source_type"], reset, "doc_id"))
    chunk = materialized(good.join(docs.select(*CHUNK_KEY, "doc_id"), CHUNK_KEY))
    named = chunk.select("school_id", "doc_id", F.posexplode("entities").alias("pos", "e")).select("school_id", "doc_id", "pos", "e.type", "e.name", "e.attributes")
    whole = (strip("type") != "") & (strip("name") != "")
    given = named.filter(whole).withColumn("norm_key", norm_key(F.col("type"), F.col("name")))
    ord_ = F.struct(F.lit(1).alias("new"), F.col("doc_id").alias("a"), F.col("pos").cast("long").alias("b"))
    mine = given.select("school_id", "norm_key", ord_.alias("ord"), "type", "name", "attributes", F.array("doc_id").alias("source_doc_ids"))
    before = F.struct(F.lit(0).alias("new"), F.col("entity_id").alias("a"), F.lit(0).cast("long").alias("b"))
    old = entities.select("school_id", "norm_key", before.alias("ord"), "type", "name", "attributes", "source_doc_ids")
    merged = store.merge_entities(old.unionByName(mine)).join(entities.select("school_id", "norm_key", "entity_id"), ["school_id", "norm_key"], "left")
    known = materialized(_numbered(merged, entities, "entity_id", ["school_id", "norm_key"]))
    ids = materialized(given.select("school_id", "doc_id", "norm_key", "name").distinct().join(known.select("school_id", "norm_key", "entity_id"), ["school_id", "norm_key"]))
    relations = chunk.select(F.col("doc_id").alias("chunk"), F.explode("relations").alias("r")).select("chunk", "r.source", "r.relation", "r.target").distinct()
    resolved = materialized(graph.resolve_names(relations, ids.select(F.col("doc_id").alias("chunk"), "name", "entity_id")))
    school = chunk.select(F.col("doc_id").alias("chunk"), "school_id")
    linked = resolved.filter("state = 'resolved'").join(school, "chunk").select("school_id", "chunk", F.col("source_id").alias("source_entity_id"), F.col("target_id").alias("target_entity_id"), "relation")
    edge_key = ["school_id", "source_entity_id", "target_entity_id", "relation"]
    both = linked.select(*edge_key, F.array(F.col("chunk")).alias("ids")).unionByName(edges.select(*edge_key, F.col("source_doc_ids").alias("ids")))
    sets = both.select(*edge_key, F.explode("ids").alias("d")).groupBy(*edge_key).agg(F.array_sort(F.collect_set("d")).alias("source_doc_ids"))
    ties = materialized(_numbered(sets.join(edges.select(*edge_key, "edge_id"), edge_key, "left"), edges, "edge_id", edge_key))
    skipped = named.filter(~F.coalesce(whole, F.lit(False))).select("doc_id").unionByName(resolved.filter("state <> 'resolved'").select(F.col("chunk").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("skipped"))
    of_chunk = ids.groupBy("doc_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    links = linked.join(ties.select(*edge_key, "edge_id"), edge_key).groupBy(F.col("chunk").alias("doc_id")).agg(F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))
    none = F.array().cast("array<bigint>")
    done = chunk.select(*CHUNK_KEY, "doc_id", "extraction_status").join(of_chunk, "doc_id", "left").join(links, "doc_id", "left").join(skipped, "doc_id", "left")
    partial = (F.col("extraction_status") == "partial") | (F.coalesce("skipped", F.lit(0)) > 0)
    ok = done.select(
        *CHUNK_KEY, "doc_id", F.coalesce("entity_ids", none).alias("entity_ids"), F.coalesce("edge_ids", none).alias("edge_ids"), F.when(partial, "partial").otherwise("complete").alias("status"),
        F.lit(None).cast("string").alias("error_code"), F.lit(False).alias("retryable"), F.coalesce("skipped", F.lit(0).cast("bigint")).alias("skipped"),
    )
    failed = told.filter("error_code is not null").select(
        *CHUNK_KEY, F.lit(None).cast("bigint").alias("doc_id"), none.alias("entity_ids"), none.alias("edge_ids"), F.lit("failed").alias("status"),
        "error_code", (F.col("error_code") == "EMBEDDING_FAILED").alias("retryable"), F.lit(0).cast("bigint").alias("skipped"),
    )
    return Built(docs, known.select(*entities.columns), ties.select(*edges.columns), ok.unionByName(failed))


def _numbered(rows: DataFrame, table: DataFrame, ident: str, key: list[str]) -> DataFrame:
    """rows with ids for those that have none: the table's greatest plus their number by key."""
    kept = materialized(rows)
    top = table.agg(F.coalesce(F.max(ident), F.lit(0)).alias("__top"))
    fresh = store.number_rows(kept.filter(F.col(ident).isNull()), key, "__n").join(F.broadcast(top)).withColumn(ident, F.col("__top") + F.col("__n"))
    return kept.filter(F.col(ident).isNotNull()).unionByName(fresh.select(*kept.columns))


def ingest_files(files: DataFrame, most: int = MAX_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """(attachments, documents) of read files (attachment_id, school_id, filename, units, paged, error_code).

    Units (pages, sections or the whole text) are cut into chunks, which are numbered through the file; `page` is the unit's
    number in paged formats. A file with an error, or without any chunk (EMPTY_CONTENT), has failed and no document. Of more
    than `most` chunks the first ones are kept and the file is marked as truncated, which is the rule's meaning.

    attachments  attachment_id, status, error_code, page_count, chunk_count, truncated
    documents    school_id, attachment_id, source_url, title, content, content_hash, chunk_index, page, source_type
    """
    cut = F.flatten(F.transform("units", lambda u, i: F.transform(chunks(u), lambda c: F.struct((i + 1).alias("page"), c.alias("content")))))
    told = materialized(files.withColumn("__c", F.when(F.col("error_code").isNull(), cut)))
    n = F.coalesce(F.size("__c"), F.lit(-1))
    code = F.coalesce("error_code", F.when(n <= 0, "EMPTY_CONTENT"))
    kept = F.when(code.isNull(), F.least(n, F.lit(most))).otherwise(0)
    state = told.select(
        "attachment_id", F.when(code.isNull(), "ready").otherwise("failed").alias("status"), code.alias("error_code"), F.when(F.col("paged"), F.greatest(F.size("units"), F.lit(0))).otherwise(0).alias("page_count"),
        kept.cast("int").alias("chunk_count"), (code.isNull() & (n > most)).alias("truncated"),
    )
    rows = told.filter(code.isNull()).select("school_id", "attachment_id", "filename", "paged", F.posexplode(F.slice("__c", 1, most)).alias("chunk_index", "c"))
    docs = rows.select(
        "school_id", "attachment_id", attachment_uri(F.col("attachment_id")).alias("source_url"), F.col("filename").alias("title"), "c.content", F.sha2("c.content", 256).alias("content_hash"),
        "chunk_index", F.when(F.col("paged"), F.col("c.page")).alias("page"), F.lit("attachment").alias("source_type"),
    )
    return state, docs


def admission_code(filename: Column, size: Column, most: int = 100 * 1024 * 1024) -> Column:
    """Why an uploaded file is refused, or OK: no name, a suffix that is not read, no content, or more than `most` bytes."""
    name = strip(F.coalesce(filename, F.lit("")))
    # A dot at the beginning makes no suffix.
    suffix = F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))
    return (
        F.when(name == "", "INVALID_FILENAME").when(~suffix.isin(".pdf", ".hwp", ".hwpx", ".txt", ".md"), "UNSUPPORTED_FILE_TYPE")
        .when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE").when(size > most, "FILE_TOO_LARGE").otherwise("OK")
    )


def fetch_failure(status: Column, network: Column) -> Column:
    """struct(stage, error_code, retryable) of a request: null on 200; `network` is the error's name if there was no answer."""
    code = F.when(status.isNull(), F.upper(F.coalesce(network, F.lit("CONNECTION_ERROR")))).otherwise(F.concat(F.lit("HTTP_"), status.cast("string")))
    retry = status.isNull() | status.isin(*RETRYABLE)
    return F.when(~F.coalesce(status == 200, F.lit(False)), F.struct(F.lit("fetch").alias("stage"), code.alias("error_code"), retry.alias("retryable")))


def robots_verdict(status: Column) -> Column:
    """What the answer to a request for robots.txt means: rules (200), DENIED (401, 403), open (other 4xx, 3xx), UNREACHABLE (5xx, none)."""
    return F.when(status.isNull() | (status >= 500), "ROBOTS_UNREACHABLE").when(status.isin(401, 403), "ROBOTS_DISALLOWED").when(status == 200, "rules").otherwise("open")


def policy_failure(verdict: Column) -> Column:
    """struct(stage, error_code, retryable) of a page that may not be fetched: only a site that could not be asked is worth another try."""
    code = F.when(verdict == "ROBOTS_UNREACHABLE", verdict).otherwise("ROBOTS_DISALLOWED")
    return F.struct(F.lit("policy").alias("stage"), code.alias("error_code"), (code != "ROBOTS_DISALLOWED").alias("retryable"))
