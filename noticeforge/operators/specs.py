"""Specifications of sites: which one holds, whether one fits its samples, where others come from, and other boards of a site."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import html
from noticeforge.functions.text import squash
from noticeforge.functions.times import parse_date
from noticeforge.functions.urls import host, normalize_url
from noticeforge.operators import quality
from noticeforge.plans.joins import spread
from noticeforge.sources.tables import materialized

#: Specifications of board products, in the order in which they are tried.
TEMPLATES: tuple[tuple[str, dict], ...] = (
    ("box", {
        "listing": {
            "row": "table tbody tr", "detail_link": ".b-title-box a[href*='mode=view'][href*='articleNo']", "title": [".b-title"], "author": [".b-writer", "td:nth-last-of-type(2)"],
            "date": [".b-date", "td:last-of-type"], "category": [".b-mini-cate", ".b-cate"], "pagination": {"type": "link", "selector": "li.next a[href], a[title='다음 페이지로 이동하기']"},
        },
        "detail": {"body": [".b-content-box .fr-view", ".b-content-box"], "title": [".b-title"], "attachment": html.FILES},
    }),
    ("article", {
        "listing": {
            "row": [".boardWrap > ul > li", "table tbody tr"], "detail_link": "a[href*='artclView.do']", "title": [".title", ".td-subject a", "td.td-subject"], "author": [".etc-area", ".td-write"],
            "date": [".date-area", ".td-date"], "category": [".notice-title", ".td-num"], "category_ignore": r"\d+|공지",
            "pagination": {"type": "form", "form_selector": "form[name='pageForm'][action]", "next_selector": "._paging ._listNext[href]", "page_pattern": r"page_link\('(\d+)'\)"},
        },
        "detail": {"body": [".artclView", ".view-con", ".board-view .txt", "#board-view"], "title": [".artclViewTitle", ".view-title", ".title"], "attachment": html.FILES},
    }),
)
MIN_BOARD_ROWS = 3


def templates(spark) -> DataFrame:  # noqa: ANN001
    """place, name, spec (JSON) of the templates."""
    return spark.createDataFrame([(i, n, json.dumps(s, ensure_ascii=False)) for i, (n, s) in enumerate(TEMPLATES)], "place int, name string, spec string")


def decoded(specs: DataFrame) -> DataFrame:
    """specs (host, spec, ...) with valid: whether the JSON is a specification with rows and links. A malformed one is no error."""
    shape = "struct<listing:struct<row:string,detail_link:string>>"
    told = F.from_json("spec", shape)
    return specs.withColumn("valid", F.coalesce((F.col("spec").isNotNull()) & (told["listing"]["row"] != "") & (told["listing"]["detail_link"] != ""), F.lit(False)))


def lookup(urls: DataFrame, specs: DataFrame, dedicated: DataFrame) -> DataFrame:
    """urls (url, ...) with parser and spec of their host: a dedicated layout (host, layout), else a valid specification, else the common one."""
    told = decoded(specs).filter("valid").select(F.lower("host").alias("__host"), F.col("spec").alias("__spec"))
    own = dedicated.select(F.lower("host").alias("__host"), F.col("layout").alias("__layout"))
    out = urls.withColumn("__host", host(F.col("url"))).join(own, "__host", "left").join(told, "__host", "left")
    kind = F.when(F.col("__layout").isNotNull(), "dedicated").when(F.col("__spec").isNotNull(), "spec").otherwise("common")
    return out.select(*urls.columns, kind.alias("parser"), F.when(kind == "dedicated", F.col("__layout")).alias("layout"), F.when(kind == "spec", F.col("__spec")).alias("spec"))


def listings(pages: DataFrame) -> DataFrame:
    """pages (url, html, spec, layout, ...) with their items exploded: position, item_url, title, category, author, published_at; and next_url.

    A page without items keeps one row with a null item.
    """
    read = spread(pages).withColumn("__l", html.read_listing("html", "url", "spec", "layout"))
    cols = [c for c in pages.columns if c not in ("html", "spec", "layout")]
    rows = read.select(*cols, F.col("__l.next_url").alias("next_url"), F.posexplode_outer("__l.items").alias("position", "i"))
    return rows.select(*cols, "next_url", "position", F.col("i.url").alias("item_url"), F.col("i.title").alias("title"), F.col("i.category").alias("category"), F.col("i.author").alias("author"), parse_date(F.col("i.published")).alias("published_at"))


def verify(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """site, place, accepted, codes of candidate specifications (site, place, spec, url, html of the site's listing) on sampled pages (site, url, html).

    As for finished crawls: the listing is checked first, and only where nothing is found there the sampled pages are, each against
    the items of the listing.
    """
    key = ["site", "place"]
    items = materialized(listings(candidates.withColumn("layout", F.lit(None).cast("string"))))
    board = quality.board_quality(items.withColumn("loop", normalize_url(F.col("next_url")) == normalize_url(F.col("url"))).withColumnsRenamed({"url": "__page", "item_url": "url"}), key, "loop")
    told = candidates.select(*key, "spec").join(board.filter(F.size("findings") == 0).select(*key), key)
    pages = told.join(samples, "site").withColumn("p", html.read_content("html", "spec", F.lit(None).cast("string")))
    pages = pages.select(*key, "url", (F.col("p.parser") == "spec").alias("found"), F.get_json_object("spec", "$.detail.body").isNotNull().alias("has_body"), "p.title", "p.content", "p.fallback").withColumn("id", F.concat_ws("#", "site", "place"))
    named = items.select(F.concat_ws("#", *key).alias("id"), F.col("item_url").alias("url"), "title")
    odd = quality.spec_findings(pages.select("id", "url", "found", "has_body"), named, "id", "has_body")
    fine = pages.join(odd.select("id", "url"), ["id", "url"], "left_anti").join(named.groupBy("id", "url").agg(F.first("title").alias("hint")), ["id", "url"])
    detail = quality.detail_findings(fine.withColumn("page", F.concat_ws("#", "id", "url")), named, ["id"], "page").select("page", F.explode("findings").alias("code"))
    detail = fine.select("id", F.concat_ws("#", "id", "url").alias("page")).join(detail, "page").select("id", "code")
    every = odd.select("id", "code").unionByName(detail).unionByName(board.select(F.concat_ws("#", *key).alias("id"), F.explode("findings").alias("code")))
    counts = samples.groupBy("site").agg(F.count("*").alias("samples"))
    all_ = candidates.select(*key).join(counts, "site", "left").withColumn("samples", F.coalesce("samples", F.lit(0))).withColumn("id", F.concat_ws("#", *key)).join(every, "id", "left")
    judged = quality.acceptable(all_, key, "samples")
    return judged.join(all_.groupBy(*key).agg(F.array_sort(F.collect_list("code")).alias("codes")), key)


def match_templates(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """site, name, spec of the first template that is accepted for each site (site, url, html of its listing)."""
    known = templates(sites.sparkSession)
    tried = sites.crossJoin(F.broadcast(known))  # a handful of fixed templates
    ok = verify(tried, samples).filter("accepted").groupBy("site").agg(F.min("place").alias("place"))
    return ok.join(F.broadcast(known), "place").select("site", "name", "spec")


def provision(sites: DataFrame, samples: DataFrame, dedicated: DataFrame, stored: DataFrame, own: DataFrame) -> DataFrame:
    """site, origin, spec: of each site (site, url, html) the dedicated layout, the stored specification, its own one (host, spec), a template, or none."""
    by_host = sites.select("site", host(F.col("url")).alias("host"))
    told = decoded(stored).filter("valid").select(F.lower("host").alias("host"), F.col("spec").alias("stored"))
    out = by_host.join(dedicated.select(F.lower("host").alias("host"), F.lit(True).alias("layout")), "host", "left").join(told, "host", "left").join(own.select(F.lower("host").alias("host"), F.col("spec").alias("own")), "host", "left")
    out = materialized(out)
    open_ = sites.join(out.filter("layout is null and stored is null and own is null").select("site"), "site", "left_semi")
    matched = match_templates(open_, samples).select("site", "name", F.col("spec").alias("template"))
    origin = F.when(F.col("layout"), "dedicated").when(F.col("stored").isNotNull(), "stored").when(F.col("own").isNotNull(), "host").when(F.col("template").isNotNull(), F.concat(F.lit("template:"), "name")).otherwise("none")
    return out.join(matched, "site", "left").select("site", origin.alias("origin"), F.when(~F.coalesce("layout", F.lit(False)), F.coalesce("stored", "own", "template")).alias("spec"))


def to_refresh(stored: DataFrame, findings: DataFrame) -> DataFrame:
    """stored (host, spec, source) of hosts with a blocking finding (host, code), but for those that people wrote."""
    broken = findings.filter(F.col("code").isin(*quality.BLOCKING)).select("host").distinct()
    return stored.filter("source <> 'human'").join(broken, "host", "left_semi")


def draft(prompt: Callable[[list[str]], str], model: Callable[[str], str], check: Callable[[dict], list[str]], attempts: int = 3, retries: int = 4, wait: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, list[str]]:
    """(specification or null, findings): drafts by a model until `check` finds nothing, each prompt with what was found before.

    A provider that fails is asked again after twice the wait, which uses up no attempt; a draft that is no specification does.
    """
    found: list[str] = []
    for _ in range(attempts):
        pause, answer = wait, None
        for turn in range(retries + 1):
            try:
                answer = model(prompt(found))
                break
            except Exception as error:  # whatever a provider raises
                found = [f"PROVIDER_ERROR: {str(error)[:200]}"]
                if turn < retries:
                    sleep(pause)
                    pause *= 2
        if answer is None:
            return None, found
        spec = html.read_spec(answer)
        if spec is None:
            found = ["INVALID_SPEC"]
            continue
        found = check(spec)
        if not found:
            return spec, []
    return None, found


def guess_details(pages: DataFrame, n: int = 3) -> DataFrame:
    """url, detail_url, title of the likeliest links to notices on listings (url, html): the first n of the largest group of alike addresses."""
    links = spread(pages).select("url", html.detail_candidates("html", "url", F.lit(None).cast("string")).alias("l"))
    return links.select("url", F.explode(F.slice("l", 1, n)).alias("d")).select("url", F.col("d.url").alias("detail_url"), F.col("d.name").alias("title"))


def other_boards(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """site, board_url, label of other boards that listings (site, url, html, spec) link to, among fetched pages (url, html).

    A candidate is a board if its listing has MIN_BOARD_ROWS items with titles for the most part; one that shows the same first
    three items as the site's own listing, or as a candidate before it, is the same board under another address.
    """
    links = spread(pages).select("site", "url", "spec", F.posexplode(html.board_candidates("html", "url", "spec")).alias("place", "c"))
    tried = links.select("site", "spec", "place", F.col("c.url").alias("board_url"), F.col("c.name").alias("label"), normalize_url(F.col("url")).alias("own")).filter(normalize_url(F.col("board_url")) != F.col("own"))
    got = tried.join(fetched.select(F.col("url").alias("board_url"), "html"), "board_url").withColumnRenamed("board_url", "url").withColumn("layout", F.lit(None).cast("string"))
    base = pages.select("site", "spec", F.lit(-1).alias("place"), "url", F.lit(None).cast("string").alias("label"), "html", F.lit(None).cast("string").alias("layout"))
    items = materialized(listings(got.select("site", "place", "url", "label", "html", "spec", "layout").unionByName(base.select("site", "place", "url", "label", "html", "spec", "layout"))))
    key = ["site", "place", "url", "label"]
    print_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("position") < 3, F.struct("position", normalize_url(F.col("item_url")).alias("u"))))), lambda x: x["u"]), "|")
    seen = items.groupBy(*key).agg(print_.alias("print"), F.count("item_url").alias("rows"), quality.ratio(squash("title") != "").alias("titles"))
    good = seen.filter((F.col("place") < 0) | (F.col("rows") >= MIN_BOARD_ROWS) & (F.col("titles") >= quality.MIN_TITLES))
    first = good.groupBy("site", "print").agg(F.min("place").alias("place"))
    return good.join(first, ["site", "print", "place"], "left_semi").filter("place >= 0").select("site", F.col("url").alias("board_url"), "label")
