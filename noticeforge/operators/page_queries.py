"""Queries of pages, listings, addresses, dates and texts. Listings and pages are made of rows of the tables, so that SQL knows what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.catalog import query
from noticeforge.functions import html, text, times, urls
from noticeforge.operators import quality, specs
from noticeforge.sources.tables import table

# ---------------------------------------------------------------- listings: the entities of a school, twenty a page


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


_ROWS_SQL = r"""rows AS (SELECT DISTINCT school_id, entity_id, entity_id // 20 AS page, type, trim(regexp_replace(name, '[\s\x{a0}\x{3000}]+', ' ', 'g')) AS name, seen_at FROM entities
 WHERE trim(regexp_replace(name, '[\s\x{a0}\x{3000}]+', ' ', 'g')) <> '')"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.trim(F.regexp_replace("name", r"[\s\x{a0}\x{3000}]+", " "))
    e = table(spark, sf_dir, "entities").select("school_id", "entity_id", F.floor(F.col("entity_id") / 20).alias("page"), "type", name.alias("name"), "seen_at").distinct()
    return e.filter("name <> ''")


def _listing(rows: DataFrame, row: Column, before: str, after: str) -> DataFrame:
    """url, html of each page of rows: twenty at most, in order of their ids."""
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", row.alias("r")))), lambda x: x["r"]), "\n")
    url = F.concat(F.lit("http://s"), F.col("school_id").cast("string"), F.lit(".ac.kr/board/list.do?page="), F.col("page").cast("string"))
    return rows.groupBy("school_id", "page").agg(inner.alias("i")).select("school_id", "page", url.alias("url"), F.concat(F.lit(before), "i", F.lit(after)).alias("html"))


def _with(df: DataFrame, spec: str | None = None, layout: str | None = None) -> DataFrame:
    return df.withColumns({"spec": F.lit(spec).cast("string"), "layout": F.lit(layout).cast("string")})


def _day() -> Column:
    return F.date_format("seen_at", "yyyy. M. d.")


@query("html_listing", f"""WITH {_ROWS_SQL} SELECT entity_id, 'http://s' || school_id || '.ac.kr/board/view.do?id=' || entity_id AS item_url, name AS title, type AS category, 'S' || school_id AS author, CAST(CAST(seen_at AS DATE) AS VARCHAR) AS published FROM rows""")
def html_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.concat(F.lit("<tr><td>1</td><td>"), F.coalesce(_escaped(F.col("type")), F.lit("")), F.lit("</td><td><b><a href='view.do?id="), "entity_id", F.lit("'>"), _escaped(F.col("name")), F.lit("</a></b></td><td>S"), "school_id", F.lit("</td><td>"), F.coalesce(_day(), F.lit("")), F.lit("</td></tr>"))
    pages = _with(_listing(_rows(spark, sf_dir), cells, "<table><thead><tr><th>no</th></tr></thead><tbody>", "<tr><td colspan=5>-</td></tr></tbody></table>"))
    items = specs.listings(pages).filter("item_url is not null")
    return items.select(F.regexp_extract("item_url", r"id=(\d+)", 1).cast("bigint").alias("entity_id"), "item_url", "title", F.nullif("category", F.lit("")).alias("category"), "author", F.col("published_at").cast("date").cast("string").alias("published"))


_SPEC = r"""{"host": "s", "listing": {"row": ["dl.none", "ul.list > li"], "detail_link": "a.t", "detail_link_attr": "onclick", "detail_link_pattern": "view\\('(\\d+)','(\\w+)'\\)", "detail_link_template": "/v/{1}/{0}",
 "title": [".empty", "a.t"], "category": ["span.c"], "category_ignore": "No\\.\\d+|공지", "date": "em:last-of-type", "pagination": {"type": "offset", "param": "page", "step": 1, "start": 1}}, "detail": {"body": [".none", ".board-text"], "title": "h3"}}"""


@query("html_spec_listing", f"""WITH {_ROWS_SQL} SELECT entity_id, 'http://s' || school_id || '.ac.kr/v/ko/' || entity_id AS item_url, name AS title, CASE WHEN type <> '공지' THEN type END AS category, CAST(CAST(seen_at AS DATE) AS VARCHAR) AS published,
 'http://s' || school_id || '.ac.kr/board/list.do?page=' || (page + 1) AS next_url FROM rows""")  # fmt: skip
def html_spec_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<li><span class=empty> </span><span class='x c'>"), F.coalesce(_escaped(F.col("type")), F.lit("")), F.lit("</span><a class='t' href='#1' onclick=\"view('"), "entity_id", F.lit("','ko')\">"), _escaped(F.col("name")), F.lit("</a><em>x</em><em>"), F.coalesce(_day(), F.lit("")), F.lit("</em></li>"))
    items = specs.listings(_with(_listing(_rows(spark, sf_dir), row, "<ul class=list>", "<li>-</li></ul>"), _SPEC)).filter("item_url is not null")
    return items.select(F.regexp_extract("item_url", r"(\d+)$", 1).cast("bigint").alias("entity_id"), "item_url", "title", F.nullif("category", F.lit("")).alias("category"), F.col("published_at").cast("date").cast("string").alias("published"), "next_url")


@query("html_layouts", f"""WITH {_ROWS_SQL} SELECT layout, count(*) AS items, sum(length(name))::BIGINT AS letters, count(*) FILTER (WHERE layout <> 'article_list') AS from_cells FROM rows, (VALUES ('box'), ('article_list'), ('definition_list')) v(layout) GROUP BY 1""")
def html_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = lambda page: F.concat(F.lit(f"<a href='{page}"), "entity_id", F.lit("'>"), _escaped(F.col("name")), F.lit("</a>"))
    rows = {
        "box": (F.concat(F.lit("<tr><td><div class='b-title-box'>"), link("?mode=view&articleNo="), F.lit("</div></td><td class=b-writer>w</td></tr>")), "<table><tbody>", "</tbody></table>"),
        "article_list": (F.concat(F.lit("<li>"), link("artclView.do?x="), F.lit("</li>")), "<div class=boardWrap><ul>", "</ul></div>"),
        "definition_list": (F.concat(F.lit("<dl class='board-list-content-wrap'><dt class='board-list-content-title'>"), link("?articleNo="), F.lit("</dt><dd class='board-list-content-info'><ul><li>No. 3</li><li>w</li></ul></dd></dl>")), "<div>", "</div>"),
    }
    out = None
    for name, (row, before, after) in rows.items():
        part = specs.listings(_with(_listing(_rows(spark, sf_dir), row, before, after), layout=name)).withColumn("layout", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("layout").agg(F.count("item_url").alias("items"), F.sum(F.length("title")).alias("letters"), F.count_if((F.col("author") == "w") & F.col("category").isNull()).alias("from_cells"))


@query("html_next_page", """WITH p AS (SELECT DISTINCT school_id, page_id FROM crawled_pages)
SELECT page_id, 'http://s' || school_id || '.kr/b/list.do?p=' || page_id AS by_link, 'http://s' || school_id || '.kr/go?q=a+b&page=' || page_id AS by_form, 'http://s' || school_id || '.kr/b/?x=1&page=7' AS by_offset FROM p""")  # fmt: skip
def html_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").select("school_id", "page_id").distinct()
    link = F.concat(F.lit("<div class='paging'><a href='?p=0'>0</a><span class='next'><a href='list.do?p="), "page_id", F.lit("'>n</a></span></div>"))
    form = F.concat(F.lit("<form name='pageForm' action='/go'><input name=q value='a b'><input name='page' value='1'><input value=z></form><div class='_paging'><a class='_listNext' href=\"javascript:page_link('"), "page_id", F.lit("')\">n</a></div>"))
    url = F.concat(F.lit("http://s"), "school_id", F.lit(".kr/b/?x=1&page=6"))
    offset = '{"listing": {"row": "tr", "detail_link": "a", "pagination": {"type": "offset", "param": "page", "step": 1, "start": 1}}}'
    none = F.lit(None).cast("string")
    at = lambda page, spec, layout: html.read_listing(page, url, spec, layout)["next_url"]
    return pages.select("page_id", at(link, none, none).alias("by_link"), at(form, none, F.lit("article_list")).alias("by_form"), at(F.lit("<p>"), F.lit(offset), none).alias("by_offset"))


# ---------------------------------------------------------------- pages: the documents' lines as blocks

_LINES_SQL = r"""lines AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS no FROM notice_docs WHERE content IS NOT NULL),
clean AS (SELECT doc_id, no, trim(regexp_replace(line, '[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS k FROM lines),
kept AS (SELECT * FROM clean WHERE k <> '' AND NOT regexp_matches(k, '^(이전글|다음글)( |이 없습니다|$)|^(수정|삭제|목록|공유|프린트|SNS 공유)$')),
once AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM kept)"""
_BLANK = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _pages(spark: SparkSession, sf_dir: str, before: str, after: str) -> DataFrame:
    """doc_id, html: the lines of each document as paragraphs."""
    lines = F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("<p><span>"), _escaped(F.regexp_replace(x, _BLANK, " ")), F.lit("</span></p>")))
    return table(spark, sf_dir, "notice_docs").filter("content is not null").select("doc_id", F.concat(F.lit(before), F.array_join(lines, "\n"), F.lit(after)).alias("html"))


def _content(pages: DataFrame, spec: str | None = None, layout: str | None = None) -> DataFrame:
    told = html.read_content("html", F.lit(spec).cast("string"), F.lit(layout).cast("string"))
    return pages.select("doc_id", told.alias("p")).select("doc_id", F.md5("p.content").alias("content"), "p.title", "p.fallback", "p.parser")


def _body_sql(title: str, fallback: str, parser: str) -> str:
    return f"""WITH {_LINES_SQL}, body AS (SELECT doc_id, md5(string_agg(k, chr(10) ORDER BY no)) AS content FROM once WHERE k IS DISTINCT FROM before GROUP BY 1)
SELECT doc_id, content, '{title}' AS title, {fallback} AS fallback, '{parser}' AS parser FROM body"""


_NAV = "<nav><ul><li>메뉴</li></ul></nav><header><h1>밖</h1></header>"


@query("html_common_content", _body_sql("제목", "false", "common"))
def html_common_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _pages(spark, sf_dir, f"<html><body><form>{_NAV}<div class='view-title'>제목</div><div id='content'>", "<ul><li class='prev'>옆 글</li></ul><button>목록</button></div></form><footer><p>끝</p></footer></body></html>")
    return _content(whole).filter(F.col("content") != F.md5(F.lit("")))


@query("html_body_fallback", _body_sql("제목", "true", "common"))
def html_body_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_pages(spark, sf_dir, f"<html><body>{_NAV}<div class=title>제목</div><div>", "</div></body></html>")).filter(F.col("content") != F.md5(F.lit("")))


@query("html_spec_content", _body_sql("제목 3", "false", "spec"))
def html_spec_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _pages(spark, sf_dir, "<body><header><h3>제목 3</h3></header><div class='none'> </div><div class='board-text'>", "</div><div class=content><p>밖</p></div></body>")
    return _content(whole, _SPEC).filter(F.col("content") != F.md5(F.lit("")))


@query("html_parser_fallback", _body_sql("제목", "false", "common"))
def html_parser_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specification's body is not there, so the common parser reads the page."""
    return _content(_pages(spark, sf_dir, "<body><h1>제목</h1><article>", "</article></body>"), _SPEC.replace("board-text", "gone").replace('".none", ', "")).filter(F.col("content") != F.md5(F.lit("")))


@query("html_layout_content", _body_sql("제목", "false", "layout"))
def html_layout_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_pages(spark, sf_dir, "<body><p>소개</p><div class='b-title'>제목</div><div class='b-content-box'>", "</div><ul><li>다음 공지</li></ul></body>"), None, "box").filter(F.col("content") != F.md5(F.lit("")))


@query("ui_block_filter", rf"WITH {_LINES_SQL} SELECT doc_id, count(*) AS kept FROM kept GROUP BY 1")
def ui_block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "notice_docs").filter("content is not null").select("doc_id", F.explode(F.split("content", "\n")).alias("l"))
    lines = lines.withColumn("k", F.trim(F.regexp_replace("l", _BLANK, " ")))
    return lines.filter((F.col("k") != "") & ~F.col("k").rlike(r"^(?:이전글|다음글)(?:\s|이 없습니다|$)|^(?:수정|삭제|목록|공유|프린트|SNS 공유)$")).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("html_visible_hash", rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(content, '{_BLANK}', ' ', 'g')) AS t FROM notice_docs WHERE content IS NOT NULL) SELECT doc_id, sha256('제목' || CASE WHEN t = '' THEN '' ELSE ' ' || t END) AS h FROM t""")
def html_visible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, "<head><title>제목</title><style>p {}</style></head><body><!-- x --><script>var a;</script>", "</body>")
    return pages.select("doc_id", html.read_page("html", F.lit(None).cast("string"))["text_hash"].alias("h"))


@query("html_attachments", r"""SELECT DISTINCT attachment_id, 'http://h.kr/d/f' || attachment_id || e AS url, 'f' || attachment_id AS name
FROM (SELECT attachment_id, lower(regexp_extract(trim(filename), '(\.[A-Za-z]+)$', 1)) AS e FROM attachments) WHERE e IN ('.pdf', '.hwp', '.hwpx', '.doc', '.docx')""")  # fmt: skip
def html_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower(F.regexp_extract(F.trim("filename"), r"(\.[A-Za-z]+)$", 1))
    page = F.concat(F.lit("<p><a href='../d/f"), "attachment_id", kind, F.lit("'><i>f"), "attachment_id", F.lit("</i></a><a href='x.html'>x</a></p>"))
    files = table(spark, sf_dir, "attachments").select("attachment_id", html.read_page(page, F.lit("http://h.kr/c/view"))["attachments"].alias("a")).distinct()
    return files.select("attachment_id", F.explode("a").alias("a")).select("attachment_id", "a.url", "a.name")


@query("html_digest")
def html_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawled_pages").select("page_id", "raw_html").distinct()
    told = pages.select("page_id", F.length("raw_html").alias("before"), html.page_digest("raw_html").alias("digest"))
    return told.select("page_id", "before", F.length("digest").alias("after"), F.md5("digest").alias("digest"))


@query("pattern_samples", r"""WITH l AS (SELECT school_id, source_url, regexp_replace(source_url, '\d+', '#', 'g') AS pattern FROM notice_docs WHERE source_url IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY school_id, pattern ORDER BY source_url) AS n FROM l) SELECT school_id, pattern, count(*) AS samples FROM r WHERE n <= 12 GROUP BY 1, 2""")  # fmt: skip
def pattern_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "notice_docs").filter("source_url is not null").select("school_id", "source_url").distinct().withColumn("pattern", urls.url_pattern(F.col("source_url")))
    return quality.sample(links, ["school_id", "pattern"], ["source_url"], html.PATTERN_LINKS).groupBy("school_id", "pattern").agg(F.count("*").alias("samples"))


@query("largest_pattern_group", r"""WITH g AS (SELECT school_id, regexp_replace(source_url, '\d+', '#', 'g') AS pattern, count(*) AS n FROM (SELECT DISTINCT school_id, source_url FROM notice_docs WHERE source_url IS NOT NULL) GROUP BY 1, 2)
SELECT school_id, pattern, n FROM g WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY n DESC, pattern) = 1""")  # fmt: skip
def largest_pattern_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "notice_docs").filter("source_url is not null").select("school_id", "source_url").distinct()
    groups = links.groupBy("school_id", urls.url_pattern(F.col("source_url")).alias("pattern")).agg(F.count("*").alias("n")).filter("n >= 3")
    return groups.groupBy("school_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "pattern")).alias("x")).select("school_id", "x.pattern", (-F.col("x.m")).alias("n"))


@query("board_label_filter", """SELECT DISTINCT entity_id, name FROM entities WHERE length(name) <= 16 AND regexp_matches(name, '공지|알림|소식|공고|게시판') AND NOT regexp_matches(name, '자유게시판|소식지|신문|웹진|Q&A|문의|FAQ|자료실|갤러리')""")
def board_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    e = table(spark, sf_dir, "entities").select("entity_id", "name").distinct()
    return e.filter((F.length(name) <= html.LABEL_CHARS) & name.rlike(html.BOARD_LABEL.pattern) & ~name.rlike(html.NO_BOARD.pattern))


@query("sibling_boards", """SELECT school_id AS site, 'http://s' || school_id || '.kr/notice' || n AS board_url, '공지 ' || n AS label FROM schools, (VALUES (2), (3)) v(n)""")
def sibling_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a school's links one leads to itself, two to boards, one to the same board under another address, one to a page without items, and one to a notice."""
    base = F.concat(F.lit("http://s"), F.col("school_id").cast("string"), F.lit(".kr/"))
    menu = "<a href='notice1'>공지 1</a><a href='notice2'>공지 2</a><a href='/notice3#x'>공지 3</a><a href='notice1?sort=y'>공지 정렬</a><a href='about'>학교 소식</a><a href='v/9'>공지 휴강</a><a href='//o.kr/n'>공지 밖</a><a href='free'>자유게시판</a>"
    rows = lambda n: "<table><tbody>" + "".join(f"<tr><td><a href='v/{n}{i}'>글 {i}</a></td></tr>" for i in range(4)) + "</tbody></table>"
    schools = table(spark, sf_dir, "schools").select(F.col("school_id").alias("site"), base.alias("base"))
    none = F.lit(None).cast("string")
    pages = schools.select("site", F.concat("base", F.lit("notice1")).alias("url"), F.lit(menu + rows(1)).alias("html"), none.alias("spec"))
    bodies = {"notice2": rows(2), "notice3": rows(3), "notice1?sort=y": rows(1), "about": "<p>소개</p>"}
    fetched = schools.select("base", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in bodies.items()])).alias("x")).select(F.concat("base", "x.k").alias("url"), F.col("x.v").alias("html"))
    return specs.other_boards(pages, fetched)


# ---------------------------------------------------------------- addresses


@query("url_detail_normal", r"""SELECT DISTINCT page_id, 'http://h.kr/v?id=' || page_id || CASE WHEN page_id % 2 = 0 THEN '&z=1' ELSE '' END AS url FROM crawled_pages""")
def url_detail_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("HTTP://H.kr/v/?utm_source=a&"), F.when(F.col("page_id") % 2 == 0, "z=1&").otherwise(""), F.lit("article.offset=10&articleLimit=10&id="), "page_id", F.lit("#top"))
    return table(spark, sf_dir, "crawled_pages").select("page_id", urls.normalize_detail_url(raw).alias("url")).distinct()


@query("url_host", r"""SELECT DISTINCT source_url, regexp_replace(regexp_replace(lower(regexp_extract(trim(source_url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '') AS host FROM notice_docs WHERE source_url IS NOT NULL""")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").filter("source_url is not null").select("source_url", urls.host(F.col("source_url")).alias("host")).distinct()


@query("url_advance_offset", """WITH p AS (SELECT DISTINCT page_id FROM crawled_pages)
SELECT page_id, 'http://h/l?a=1&o=' || (page_id + 10) || '#f' AS there, 'http://h/l?a=&o=10' AS missing, 'http://h/l?o=11' AS odd FROM p""")  # fmt: skip
def url_advance_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda url, start: urls.advance_offset(url, F.lit("o"), F.lit(10), F.lit(start))
    there = F.concat(F.lit("http://h/l?a=0&o=3&a=1&o="), "page_id", F.lit("#f"))
    return table(spark, sf_dir, "crawled_pages").select("page_id").distinct().select("page_id", at(there, 0).alias("there"), at(F.lit("http://h/l?a="), 0).alias("missing"), at(F.lit("http://h/l?o=x"), 1).alias("odd"))


@query("url_joined", """SELECT DISTINCT page_id, 'http://h.kr/b/v?id=' || page_id AS relative, 'http://h.kr/r/' || page_id AS rooted, 'http://o.kr/' || page_id AS other, 'http://h.kr/b/list?p=' || page_id AS query_only FROM crawled_pages""")
def url_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = ("v?id=", "/r/", "//o.kr/", "?p=")
    page = F.concat(*[x for h in hrefs for x in (F.lit(f"<a href='{h}"), F.col("page_id").cast("string"), F.lit("'>x</a>"))])
    told = table(spark, sf_dir, "crawled_pages").select("page_id").distinct().select("page_id", html.read_page(page, F.lit("http://h.kr/b/list?p=0#x"))["links"].alias("l"))
    return told.select("page_id", *[F.get("l", F.lit(i)).alias(n) for i, n in enumerate(("relative", "rooted", "other", "query_only"))])


@query("url_admission", r"""SELECT school_id, coalesce(regexp_matches(lower(trim(base_url)), '^https?://([^/?#@]*@)?[^/?#:@]+'), false) AS admitted, split_part(regexp_replace(regexp_replace(lower(regexp_extract(trim(base_url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)), '^.*@', ''), '^www\.', ''), '.', 1) AS label FROM schools""")
def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("base_url")
    return table(spark, sf_dir, "schools").select("school_id", urls.admissible(u).alias("admitted"), F.coalesce(urls.display_name(u), F.lit("")).alias("label"))


# ---------------------------------------------------------------- schedules


@query("next_cron_run", r"""WITH s AS (SELECT event_id, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS t FROM events), d AS (SELECT event_id, t, CASE WHEN hour(t) * 60 + minute(t) <= 210 THEN CAST(t AS DATE) ELSE CAST(t AS DATE) + 1 END AS day FROM s),
c AS (SELECT event_id, t, day, unnest(range(0, 32)) AS k FROM d), m AS (SELECT event_id, min(day + CAST(k AS INTEGER)) AS day FROM c WHERE dayofmonth(day + CAST(k AS INTEGER)) = 1 OR dayofweek(day + CAST(k AS INTEGER)) = 1 GROUP BY 1)
SELECT event_id, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) + 12600 AS next FROM m""")  # fmt: skip
def next_cron_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = times.next_run(F.col("ts").cast("timestamp"), F.lit("30 3 1 * 1"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(at).alias("next"))


@query("next_run_all", r"""WITH s AS (SELECT school_id, CAST(epoch(date_trunc('second', updated_at)) AS BIGINT) AS t, lower(trim(coalesce(crawl_schedule, ''))) AS s FROM schools WHERE updated_at IS NOT NULL),
n AS (SELECT *, CASE s WHEN 'hourly' THEN 3600 WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 604800 WHEN 'monthly' THEN 2592000 ELSE CASE WHEN regexp_full_match(s, '[0-9]{1,12}(\s*[smhd])?')
 THEN CAST(regexp_extract(s, '^([0-9]+)', 1) AS BIGINT) * CASE right(s, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END END END AS seconds FROM s) SELECT school_id, t + seconds AS next FROM n WHERE NOT regexp_full_match(s, '\S+(\s+\S+){4}')""")  # fmt: skip
def next_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schedule but cron ones, which next_cron_run holds against SQL."""
    s = table(spark, sf_dir, "schools").filter("updated_at is not null").filter(times.schedule_kind(F.col("crawl_schedule")) != "cron")
    return s.select("school_id", F.unix_timestamp(times.next_run(F.col("updated_at"), F.col("crawl_schedule"))).alias("next"))


@query("retry_waits", """SELECT DISTINCT coalesce(miss_count, 0) AS attempt, 1.5 * power(2, coalesce(miss_count, 0)) AS fetch, CAST(coalesce(miss_count, 0) + 1 AS DOUBLE) AS model, greatest(1.0, CASE WHEN miss_count > 0 THEN CAST(miss_count AS DOUBLE) END)::DOUBLE AS delay FROM notice_docs""")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce("miss_count", F.lit(0))
    declared = F.when(F.col("miss_count") > 0, F.col("miss_count").cast("double"))
    return table(spark, sf_dir, "notice_docs").select(n.alias("attempt"), times.retry_seconds("fetch", n, 1.5).alias("fetch"), times.retry_seconds("model", n).alias("model"), times.crawl_delay(F.lit(1.0), declared).alias("delay")).distinct()


# ---------------------------------------------------------------- texts


@query("squeezed_text", rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(content, '{_BLANK}', ' ', 'g')) AS t FROM notice_docs) SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS t FROM t""")
def squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").select("doc_id", text.squeeze(F.col("content"), 80).alias("t"))


@query("stripped_text", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(content, '^{_BLANK}', ''), '{_BLANK}$', '')) AS t FROM notice_docs")
def stripped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notice_docs").select("doc_id", F.md5(text.strip(F.col("content"))).alias("t"))


@query("error_details", r"SELECT doc_id, 'E' || CASE WHEN trim(regexp_replace(title, '[\r\n]+', ' ', 'g')) <> '' THEN ': ' || left(trim(regexp_replace(title || title || title || title, '[\r\n]+', ' ', 'g')), 60) ELSE '' END AS detail FROM notice_docs")
def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return table(spark, sf_dir, "notice_docs").select("doc_id", text.error_detail(F.lit("E"), F.concat(t, t, t, t), 60).alias("detail"))


@query("filled_template", "SELECT DISTINCT attachment_id, '/v/' || school_id || '/' || attachment_id || '?x=' || school_id AS url FROM attachments")
def filled_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(F.col("attachment_id").cast("string"), F.col("school_id").cast("string"))
    return table(spark, sf_dir, "attachments").select("attachment_id", text.fill_template(F.lit("/v/{1}/{0}?x={1}"), groups).alias("url")).distinct()


@query("answer_split", r"""WITH d AS (SELECT doc_id, coalesce(nullif(trim(replace(title, chr(10), ' ')), ''), 'x') AS t, regexp_replace(regexp_replace(content, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS c FROM notice_docs WHERE content IS NOT NULL AND NOT contains(content, '[핵심 답변]') AND NOT contains(content, '[상세 답변]'))
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(regexp_replace(t, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') ELSE regexp_replace(split_part(c, chr(10), 1), '[\s\p{Z}]+$', '') END AS summary,
md5(CASE WHEN doc_id % 2 = 0 THEN c ELSE regexp_replace(substr(c, length(split_part(c, chr(10), 1)) + 1), '^[\s\p{Z}]+', '') END) AS detail FROM d""")  # fmt: skip
def answer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with tags (even ids) and without."""
    d = table(spark, sf_dir, "notice_docs").filter("content is not null and not contains(content, '[핵심 답변]') and not contains(content, '[상세 답변]')")
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", "\n", " ")), F.lit("")), F.lit("x"))
    tagged = F.concat(F.lit("[핵심 답변]\n"), title, F.lit("\n\n[상세 답변]\n"), "content")
    told = d.select("doc_id", text.answer_parts(F.when(F.col("doc_id") % 2 == 0, tagged).otherwise(F.col("content"))).alias("p"))
    return told.select("doc_id", "p.summary", F.md5("p.detail").alias("detail"))


@query("byte_sizes", r"""SELECT DISTINCT attachment_id, CASE WHEN byte_size < 1024 THEN byte_size || ' B' WHEN byte_size < 1048576 THEN printf('%.1f KB', byte_size / 1024.0::DOUBLE) ELSE printf('%.1f MB', byte_size / 1048576.0::DOUBLE) END AS size FROM attachments""")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "attachments").select("attachment_id", text.byte_size(F.col("byte_size")).alias("size")).distinct()


@query("labels_and_addresses", "SELECT DISTINCT attachment_id, 'attachment://' || attachment_id AS uri, 'e_' || attachment_id AS node FROM attachments")
def labels_and_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attachment_id")
    return table(spark, sf_dir, "attachments").select("attachment_id", text.attachment_uri(a).alias("uri"), text.node_label(a).alias("node")).distinct()


@query("sorted_node_labels", "SELECT school_id, array_to_string(list_sort(list(DISTINCT 'e_' || entity_id)), ',') AS labels FROM entities GROUP BY 1")
def sorted_node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As texts: e_10 comes before e_2."""
    return table(spark, sf_dir, "entities").groupBy("school_id").agg(F.array_join(F.array_sort(F.collect_set(text.node_label(F.col("entity_id")))), ",").alias("labels"))


@query("model_prompt", r"""SELECT doc_id, md5('읽어라.' || CASE WHEN trim(title, ' ' || chr(10) || chr(9) || chr(13)) <> '' AND title IS NOT NULL AND regexp_matches(title, '[^\s\p{Z}]') THEN chr(10) || chr(10) || '제목:' || chr(10) || title ELSE '' END
 || CASE WHEN regexp_matches(content, '[^\s\p{Z}]') THEN chr(10) || chr(10) || '본문:' || chr(10) || content ELSE '' END) AS prompt FROM notice_docs""")  # fmt: skip
def model_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = text.prompt("읽어라.", ("제목", F.col("title")), ("본문", F.col("content")))
    return table(spark, sf_dir, "notice_docs").select("doc_id", F.md5(told).alias("prompt"))


@query("category_ignore", r"SELECT DISTINCT page_id, CASE WHEN NOT regexp_full_match(trim(category_hint), '(\d+|공지)') THEN category_hint END AS category FROM crawled_pages")
def category_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("category_hint")
    return table(spark, sf_dir, "crawled_pages").select("page_id", F.when(~F.trim(c).rlike(r"^(?:\d+|공지)$"), c).alias("category")).distinct()
