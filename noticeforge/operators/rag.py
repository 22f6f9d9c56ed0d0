"""Retrieval for questions: ranked documents, graph facts, the document fallback, and the assembled context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.text import citation, named, node_label, norm_key, strip
from noticeforge.operators import graph, vector
from noticeforge.sources.tables import materialized

#: How many documents are looked at, the scores they need, and the heading of the facts.
TOP, LEAST_GRAPH, LEAST_DOCUMENT = 5, 0.6, 0.3
FACTS = "[관계]"


def hybrid(first: DataFrame, documents: DataFrame, least_graph: float = LEAST_GRAPH, least_document: float = LEAST_DOCUMENT) -> DataFrame:
    """question_id, stage, item_id, score, rank: graph hits above their threshold, else document hits above theirs, else none.

    Both inputs are ranked hits (query_id, item_id, score, rank); thresholds come after the ranking. A question without
    evidence in either has no row, so nothing is generated for it.
    """
    best = first.filter(F.col("score") >= least_graph).withColumn("stage", F.lit("graph"))
    second = documents.filter(F.col("score") >= least_document).withColumn("stage", F.lit("document"))
    rest = second.join(best.select("query_id").distinct(), "query_id", "left_anti")
    return best.unionByName(rest).select(F.col("query_id").alias("question_id"), "stage", "item_id", "score", "rank")


def merge_sources(hits: DataFrame) -> DataFrame:
    """question_id, url, title, label, place: hits (question_id, url, title, page, rank) by source, pages joined, best rank first."""
    by = hits.groupBy("question_id", "url").agg(
        F.min(F.struct("rank", "title"))["title"].alias("title"), F.array_sort(F.collect_set("page")).alias("pages"), F.min("rank").alias("place")
    )
    pages = F.concat(named(F.col("title")), F.lit(" - "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("페이지"))
    return by.withColumn("label", F.when(F.size("pages") > 0, pages).otherwise(named(F.col("title"))))


def first_titles(hits: DataFrame) -> DataFrame:
    """question_id, url, title, place: each source once with the title of its best hit; hits without a url have none."""
    best = F.min(F.struct("rank", "title"))
    return hits.filter("url <> ''").groupBy("question_id", "url").agg(best["title"].alias("title"), best["rank"].alias("place"))


def fact_lines(edges: DataFrame, names: DataFrame, urls: DataFrame) -> DataFrame:
    """edge_id, fact: `- A —relation→ B (출처: url)` of edges (edge_id, src, tgt, relation, doc_ids) with their first document that is there."""
    label = names.select("node", "name")
    cited = edges.select("edge_id", F.posexplode("doc_ids").alias("pos", "doc_id")).join(urls.select("doc_id", "url"), "doc_id")
    cited = cited.groupBy("edge_id").agg(F.min(F.struct("pos", "url"))["url"].alias("url"))
    out = edges.join(label.withColumnsRenamed({"node": "src", "name": "a"}), "src").join(label.withColumnsRenamed({"node": "tgt", "name": "b"}), "tgt").join(cited, "edge_id", "left")
    source = F.when(F.col("url") != "", F.concat(F.lit(" (출처: "), F.col("url"), F.lit(")"))).otherwise("")
    return out.select("edge_id", F.concat(F.lit("- "), "a", F.lit(" —"), "relation", F.lit("→ "), "b", source).alias("fact"))


def contexts(hits: DataFrame, stage: str = "document") -> DataFrame:
    """question_id, context: a block of each hit (question_id, rank, title, page, url, content), best first.

    The head of a block is `[근거 rank] ` and the title with its page or, at the graph stage, the title and its source on a line.
    """
    head = F.concat(named(F.col("title")), F.lit("\n출처: "), F.coalesce("url", F.lit(""))) if stage == "graph" else citation(F.col("title"), F.col("page"))
    block = F.concat(F.lit("[근거 "), F.col("rank").cast("string"), F.lit("] "), head, F.lit("\n"), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))  # a question has k hits at most
    return hits.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def question_seeds(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """question_id, node: entities (entity_id, school_id, norm_key) of the keys of what was extracted from questions (question_id, school_id, found)."""
    keys = questions.select("question_id", "school_id", F.explode("found").alias("e")).filter((strip("e.type") != "") & (strip("e.name") != ""))
    keys = keys.select("question_id", "school_id", norm_key(F.col("e.type"), F.col("e.name")).alias("norm_key")).distinct()
    return keys.join(entities.select("school_id", "norm_key", F.col("entity_id").alias("node")), ["school_id", "norm_key"]).select("question_id", "node").distinct()


def expand(seeds: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """question_id, edge_id, source, edge, target: the edges that touch a question's seeds, each once, as nested records.

    edges (edge_id, src, tgt, relation, doc_ids), names (node, name, type). Nodes of another tenant never meet, as their ids differ.
    """
    touched = graph.touching(edges).join(seeds, "node").select("question_id", "edge_id", "src", "tgt", "relation", "doc_ids").distinct()
    node = lambda side, out: names.select(F.col("node").alias(side), F.struct(F.col("node").alias("entity_id"), "type", "name").alias(out))
    edge = F.struct("edge_id", "relation", "doc_ids").alias("edge")
    return touched.join(node("src", "source"), "src").join(node("tgt", "target"), "tgt").select("question_id", "edge_id", "source", edge, "target")


def retrieve(questions: DataFrame, docs: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """question_id, source_type, context, sources, entity_ids of every question: graph evidence, else that of files, else none.

    questions  question_id, school_id, q_vec, found (entities extracted from the question; used only where documents are found)
    docs       doc_id, school_id, source_type, source_url, title, page, content, embedding, expired_at; web documents make the
               graph stage, attachments the other; expired ones and those without a vector are left out of the ranking only
    entities   entity_id, school_id, type, name, norm_key; edges: edge_id, src, tgt, relation, doc_ids

    Ranking takes TOP documents of the tenant, thresholds come after. Graph evidence is the documents' blocks and the facts of
    the seeds' edges; its sources are the documents' addresses in order of rank, then those of the edges' documents. Sources of
    files join their pages. A question without evidence has an empty context, no sources and a null source_type.
    """
    asked = questions.select(F.col("question_id").alias("query_id"), "school_id", "q_vec")
    active = docs.filter("embedding is not null and expired_at is null").select(F.col("doc_id").alias("item_id"), "school_id", "source_type", F.col("embedding").alias("i_vec"))
    pool = lambda kind: vector.top_k(asked, active.filter(F.col("source_type") == kind).drop("source_type"), TOP, ("school_id",))
    text = docs.select(F.col("doc_id").alias("item_id"), F.col("source_url").alias("url"), "title", "page", "content")
    hits = materialized(hybrid(pool("web"), pool("attachment")).join(text, "item_id"))
    of_graph, of_files = hits.filter("stage = 'graph'"), hits.filter("stage = 'document'")
    found = questions.join(of_graph.select("question_id").distinct(), "question_id", "left_semi")
    names = entities.select(F.col("entity_id").alias("node"), "type", "name")
    near = materialized(expand(question_seeds(found, entities), edges, names))
    cited = edges.join(near.select("edge_id").distinct(), "edge_id", "left_semi")
    facts = fact_lines(cited, names, docs.select("doc_id", F.col("source_url").alias("url")))
    facts = near.select("question_id", "edge_id").join(facts, "edge_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("edge_id", "fact"))).alias("f"))
    facts = facts.select("question_id", F.concat(F.lit(FACTS + "\n"), F.array_join(F.transform("f", lambda x: x["fact"]), "\n")).alias("facts"))
    from_edges = near.select("question_id", "edge_id", F.posexplode("edge.doc_ids").alias("pos", "item_id")).join(text.select("item_id", "url", "title"), "item_id")
    later = from_edges.select("question_id", "url", "title", (F.lit(TOP) + F.col("edge_id")).cast("bigint").alias("rank"), "pos")
    both = of_graph.select("question_id", "url", "title", F.col("rank").cast("bigint").alias("rank"), F.lit(0).alias("pos")).unionByName(later).filter("url <> ''")
    once = both.groupBy("question_id", "url").agg(F.min(F.struct("rank", "pos", "title")).alias("m")).select("question_id", "url", F.col("m.title").alias("title"), F.col("m.rank").alias("rank"), "m.pos")
    listed = once.unionByName(merge_sources(of_files).select("question_id", "url", F.col("label").alias("title"), F.col("place").cast("bigint").alias("rank"), F.lit(0).alias("pos")))
    sources = listed.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "url", "title"))).alias("s"))
    sources = sources.select("question_id", F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("sources"))
    ids = near.select("question_id", F.explode(F.array(node_label(F.col("source.entity_id")), node_label(F.col("target.entity_id")))).alias("e")).groupBy("question_id").agg(F.array_sort(F.collect_set("e")).alias("entity_ids"))
    blocks = contexts(of_graph, "graph").withColumn("source_type", F.lit("graph")).unionByName(contexts(of_files).withColumn("source_type", F.lit("document")))
    out = questions.select("question_id").join(blocks, "question_id", "left").join(facts, "question_id", "left").join(sources, "question_id", "left").join(ids, "question_id", "left")
    return out.select(
        "question_id", "source_type", F.concat_ws("\n\n", F.coalesce("context", F.lit("")), "facts").alias("context"),
        F.coalesce("sources", F.array().cast("array<struct<title:string,url:string>>")).alias("sources"), F.coalesce("entity_ids", F.array().cast("array<string>")).alias("entity_ids"),
    )


def answers(retrieved: DataFrame, questions: DataFrame, generate: Callable[[Column, Column], Column], no_evidence: str) -> DataFrame:
    """retrieved with answer: what generate (question, context) gives, without white space around it; it only sees rows with evidence."""
    asked = questions.select("question_id", "question")
    known = retrieved.filter("source_type is not null").join(asked, "question_id").withColumn("answer", strip(generate(F.col("question"), F.col("context")))).drop("question")
    return known.unionByName(retrieved.filter("source_type is null").withColumn("answer", F.lit(no_evidence)))
