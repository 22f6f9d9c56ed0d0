"""From pages to checked chunks: content, pieces, what a model extracted, and the rules it must keep, as set-wise steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.html import read_content
from noticeforge.functions.text import chunks, strip
from noticeforge.plans.joins import spread
from noticeforge.sources.tables import materialized

#: Types of entities and relations that may be extracted, and the ones that have rules of their own.
ENTITY_TYPES = (
    "대학·캠퍼스", "단과대학", "학과·전공", "부서·기관", "담당자", "외부기관", "공지", "장학금", "프로그램·사업", "채용·모집", "행사", "학사일정", "교과목·수업",
    "절차·신청방법", "규정·정책", "대상·자격", "연락처", "시설", "첨부·링크", "주제·카테고리",
)
RELATION_TYPES = ("소속", "담당", "주최", "게시", "안내", "포함", "분류", "관련", "대상", "연락처", "위치", "선행조건", "신청방법", "제공", "첨부")
NOTICE, CATEGORY, POSTED, CLASSED = "공지", "주제·카테고리", "게시", "분류"
POSTERS = ("부서·기관", "담당자")
ENTITY = "struct<type:string,name:string,attributes:map<string,string>>"
RELATION = "struct<source:string,relation:string,target:string>"


def allowed_entities(entities: Column, types: Sequence[str] = ENTITY_TYPES) -> Column:
    """The entities (array<struct<type,name,...>>) of a known type with a name, names trimmed; null stays null."""
    return F.filter(F.transform(entities, lambda e: e.withField("name", strip(e["name"]))), lambda e: e["type"].isin(*types) & (e["name"] != ""))


def allowed_relations(relations: Column, entities: Column, kinds: Sequence[str] = RELATION_TYPES) -> Column:
    """The relations (array<struct<source,relation,target>>) of a known kind between surviving entities.

    A notice is posted by an office or a person: where one of these is the source and a notice the target, they change places.
    """
    names = F.transform(entities, lambda e: e["name"])
    of_type = lambda n, types: F.exists(entities, lambda e: (e["name"] == n) & e["type"].isin(*types))
    trimmed = F.transform(relations, lambda r: F.struct(strip(r["source"]).alias("source"), r["relation"].alias("relation"), strip(r["target"]).alias("target")))
    turned = lambda r: (r["relation"] == POSTED) & of_type(r["source"], POSTERS) & of_type(r["target"], (NOTICE,))
    swap = lambda r: F.struct(r["target"].alias("source"), r["relation"].alias("relation"), r["source"].alias("target"))
    right = F.transform(trimmed, lambda r: F.when(turned(r), swap(r)).otherwise(r))
    ends = lambda r: (r["source"] != "") & (r["target"] != "") & F.array_contains(names, r["source"]) & F.array_contains(names, r["target"])
    return F.filter(right, lambda r: F.coalesce(r["relation"].isin(*kinds) & ends(r), F.lit(False)))


def validated(entities: Column, relations: Column) -> Column:
    """struct(entities, relations, discarded): what may stay and how much may not; anything discarded makes a chunk partial."""
    given, linked = F.coalesce(entities, F.array().cast(f"array<{ENTITY}>")), F.coalesce(relations, F.array().cast(f"array<{RELATION}>"))
    kept = allowed_entities(given)
    ok = allowed_relations(linked, kept)
    lost = F.size(given) - F.size(kept) + F.size(linked) - F.size(ok)
    return F.struct(kept.alias("entities"), ok.alias("relations"), lost.alias("discarded"))


def with_category(entities: Column, relations: Column, category: Column, title: Column) -> Column:
    """struct(entities, relations) with the page's category, which every notice is then classed under; no category changes nothing.

    Where no notice was extracted, one is made from the title. Neither an entity nor a relation is added twice.
    """
    name = strip(F.coalesce(category, F.lit("")))
    none = F.array().cast(f"array<{ENTITY}>")
    item = lambda kind, n: F.struct(F.lit(kind).alias("type"), n.alias("name"), F.create_map().cast("map<string,string>").alias("attributes"))
    notices = F.filter(entities, lambda e: e["type"] == NOTICE)
    made = F.when((F.size(notices) == 0) & (title != ""), F.array(item(NOTICE, title))).otherwise(none)
    there = F.exists(entities, lambda e: (e["type"] == CATEGORY) & (e["name"] == name))
    classed = F.transform(F.concat(notices, made), lambda e: F.struct(e["name"].alias("source"), F.lit(CLASSED).alias("relation"), name.alias("target")))
    new = F.filter(F.array_distinct(classed), lambda r: ~F.array_contains(relations, r))
    out = F.struct(F.concat(entities, made, F.when(there, none).otherwise(F.array(item(CATEGORY, name)))).alias("entities"), F.concat(relations, new).alias("relations"))
    return F.when(name == "", F.struct(entities.alias("entities"), relations.alias("relations"))).otherwise(out)


def page_status(chunks_: DataFrame, page: str, ok: str) -> DataFrame:
    """page, extraction_status: complete, partial (some chunks failed) or failed (all did)."""
    good = F.count_if(F.col(ok))
    status = F.when(good == 0, "failed").when(good < F.count("*"), "partial").otherwise("complete")
    return chunks_.groupBy(page).agg(status.alias("extraction_status"))


def page_contents(pages: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """pages with parsed (title, content, fallback, parser): by the layout or specification of their host (host, spec, layout), else in common."""
    host = F.lower(F.regexp_extract("source_url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    if specs is None:
        told = pages.withColumns({"__spec": F.lit(None).cast("string"), "__layout": F.lit(None).cast("string")})
    else:
        known = specs.select(F.lower("host").alias("__host"), F.col("spec").alias("__spec"), F.col("layout").alias("__layout"))
        told = pages.withColumn("__host", host).join(known, "__host", "left").drop("__host")
    return spread(told).withColumn("parsed", read_content("raw_html", "__spec", "__layout")).drop("__spec", "__layout")


def extract_pages(pages: DataFrame, extract: Callable[[Column], Column], specs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, failures) of crawled pages (page_id, source_url, title_hint, category_hint, raw_html, crawl_status).

    extract   a function of a text column: struct(entities, relations, error_code, retryable), with a null error_code on success
    chunks    page_id, source_url, title, chunk_index, content, entities, relations, extraction_status. The entities and relations
              are checked and carry the page's category. Any failed chunk makes the page's other ones partial.
    failures  page_id, source_url, error_code, retryable: pages that are neither new nor changed (UNSUPPORTED_CRAWL_STATUS),
              without content (EMPTY_CONTENT), or whose chunks all failed (LLM_EXTRACTION_FAILED)
    """
    wanted = F.col("crawl_status").isin("new", "changed")
    fail = lambda df, code, retry: df.select("page_id", "source_url", F.lit(code).alias("error_code"), retry.alias("retryable"))
    odd = fail(pages.filter(~F.coalesce(wanted, F.lit(False))), "UNSUPPORTED_CRAWL_STATUS", F.lit(False))
    parsed = materialized(page_contents(pages.filter(wanted), specs).select("page_id", "source_url", F.coalesce(F.nullif("title_hint", F.lit("")), "parsed.title").alias("title"), "category_hint", chunks(F.col("parsed.content")).alias("pieces")))
    bare = F.coalesce(F.size("pieces"), F.lit(0)) <= 0
    pieces = parsed.filter(~bare).select("page_id", "source_url", "title", "category_hint", F.posexplode("pieces").alias("chunk_index", "content"))
    done = pieces.withColumn("x", extract(F.col("content")))
    checked = done.withColumn("v", validated(F.col("x.entities"), F.col("x.relations")))
    done = materialized(checked.withColumn("m", with_category(F.col("v.entities"), F.col("v.relations"), F.col("category_hint"), F.col("title"))))
    failed = F.col("x.error_code").isNotNull()
    state = done.groupBy("page_id").agg(F.count_if(failed).alias("bad"), F.count("*").alias("all"), F.bool_or(failed & F.coalesce(F.col("x.retryable"), F.lit(False))).alias("retry"))
    lost = done.select("page_id", "source_url").distinct().join(state.filter("bad = `all`"), "page_id")
    some = state.filter("bad > 0").select("page_id", F.lit(True).alias("some"))
    good = done.filter(~failed).join(some, "page_id", "left")
    status = F.when(F.coalesce("some", F.lit(False)) | (F.col("v.discarded") > 0), "partial").otherwise("complete")
    out = good.select("page_id", "source_url", "title", "chunk_index", "content", "m.entities", "m.relations", status.alias("extraction_status"))
    return out, odd.unionByName(fail(parsed.filter(bare), "EMPTY_CONTENT", F.lit(False))).unionByName(fail(lost, "LLM_EXTRACTION_FAILED", F.col("retry")))
