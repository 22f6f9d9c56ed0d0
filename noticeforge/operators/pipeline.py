"""A crawl from its pages to the graph: what changed, what was read and extracted, what was stored, and how it ended for each school."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.operators import crawl, extraction, ingest, store
from noticeforge.sources.tables import materialized

LOG = logging.getLogger(__name__)
#: Fixed value: entities of a school from which no further chunk is indexed.
MAX_NODES = 1200


@dataclass
class Outcome:
    """The tables after a crawl, what failed, and the schools' status: ready, partial_failed or failed."""

    documents: DataFrame
    entities: DataFrame
    edges: DataFrame
    failures: DataFrame
    status: DataFrame
    quality: DataFrame | None


def isolated(task: Callable[[], DataFrame | None], name: str) -> DataFrame | None:
    """A side task's result, or null if it fails: that is logged and never ends the crawl."""
    try:
        return task()
    except Exception:  # whatever a side task raises
        LOG.exception("%s failed", name)
        return None


def run(
    pages: DataFrame, documents: DataFrame, entities: DataFrame, edges: DataFrame, extract: Callable[[Column], Column], embed: Callable[[Column], Column],
    specs: DataFrame | None = None, check: Callable[[DataFrame], DataFrame] | None = None, now: Column | None = None, misses: int = 3, most: int = MAX_NODES,
) -> Outcome:
    """One crawl of pages (page_id, school_id, source_url, title_hint, category_hint, raw_html, content_hash, fetched_at) into the tables of the store.

    Pages are new, changed or unchanged against the stored documents; the first two are read, cut, extracted and built into the
    graph, chunk by chunk until the school has `most` entities. All pages count as observed: documents that were missed
    `misses` times expire. `check` is a side task on the pages (a quality report), whose failure changes nothing.

    A school is ready if its pages were indexed or were all unchanged, partial_failed if some failed, failed if all did. A crawl
    without pages leaves the school out.
    """
    known = documents.select("school_id", F.col("source_url").alias("url"), "content_hash")
    told = crawl.classify_changes(pages.withColumn("url", F.col("source_url")), known)
    told = materialized(told.drop("url"))
    fresh = told.filter(F.col("crawl_status") != "unchanged")
    chunks, failures = extraction.extract_pages(fresh, extract, specs)
    of_page = told.select("page_id", "school_id", "content_hash", "fetched_at")
    failures = materialized(failures.join(of_page.select("page_id", "school_id"), "page_id"))
    named = materialized(chunks.join(of_page, "page_id"))
    order = F.struct("page_id", "chunk_index").alias("o")
    keys = named.select("school_id", order, F.explode_outer(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["name"]))).alias("k"))
    kept = crawl.node_cap(keys, "school_id", "o", "k", most).select("school_id", "o").distinct()
    named = named.withColumn("o", order).join(kept, ["school_id", "o"], "left_semi").drop("o")
    rows = named.select("school_id", F.col("school_id").alias("target_school_id"), "source_url", "title", "content", "chunk_index", "content_hash", F.col("fetched_at").alias("crawled_at"), embed(F.col("content")).alias("embedding"), "entities", "relations", "extraction_status")
    built = ingest.build_graph(rows, documents, entities, edges)
    docs = store.observe(built.documents, told.select("school_id", "source_url"))
    docs = store.expire(docs, now if now is not None else F.current_timestamp(), misses)
    results = materialized(built.results)
    good = results.groupBy("school_id").agg(F.count_if(F.col("status") != "failed").alias("good"), F.count_if(F.col("status") == "failed").alias("bad"))
    lost = failures.groupBy("school_id").agg(F.count("*").alias("lost"))
    state = told.groupBy("school_id").agg(F.count_if(F.col("crawl_status") == "unchanged").alias("same")).join(good, "school_id", "left").join(lost, "school_id", "left").fillna(0, ["good", "bad", "lost"])
    wrong, right = F.col("bad") + F.col("lost") > 0, F.col("good") + F.col("same") > 0
    status = F.when(wrong & right, "partial_failed").when(right, "ready").otherwise("failed")
    report = isolated(lambda: materialized(check(told)), "quality report") if check else None
    return Outcome(docs, built.entities, built.edges, failures, state.select("school_id", status.alias("status")), report)
