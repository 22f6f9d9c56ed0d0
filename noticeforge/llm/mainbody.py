"""The main body of pages by consensus host paths: containers are scored per page, voted on per host, and read again."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from noticeforge.functions.urls import website
from noticeforge.llm.htmlines import Line, lines_of
from noticeforge.plans.joins import small_side, spread
from noticeforge.sources.tables import materialized

#: Part of its lines from which a path counts as boilerplate: linked text, or lines that stand there again and again.
LINKED, REPEATED = 0.5, 0.5
#: Lines from which a host's own figures about noise count; with fewer, those of the path on all hosts do. Its votes always count.
OWN_LINES = 30
#: The same for the figures of a path on all hosts; with fewer, those of all paths that end in the same container do.
ALL_LINES = 200
#: A line that stands in this share of a host's texts, or of its pages' main bodies (and in MIN_DOCS at least), is the site's.
TEXT_SHARE, PAGE_SHARE, MIN_DOCS = 0.2, 0.5, 5
#: A line belongs to the frame if MIN_DOCS pages, this share of the host's pages with a main body, and this share of the pages
#: that show it have it outside of the main body.
FRAME_SHARE, OUTSIDE_SHARE = 0.01, 0.8
#: What stands before the title of a neighbouring notice, and separators of menus and of the way to a page.
_NEIGHBOUR = r"(?:이전\s?글|다음\s?글|이전|다음|윗글|아랫글|prev(?:ious)?|next|[▲▼△▽∧∨])\s*[:：|]?\s+\S|^(?:이전글|다음글)\S"
_MENU_SEP = r"\s+[|·>»›/ㅣ]\s+|\s*[|>»›]\s*"
_BUTTONS = "목록 인쇄 인쇄하기 글쓰기 수정 삭제 답글 공유 공유하기 스크랩 신고 추천 닫기 확인 top 맨위로 위로 list print share edit delete write reply close".split()
_PLAIN = frozenset("ul ol dl tr table p center figure blockquote fieldset".split())
_STRIP = re.compile(r"[\s\d]+")
_LETTER = re.compile(r"[^\W\d_]")


def line_hash(text: str) -> int:
    """A line without digits, case and blanks, as a signed number; 0 for a line without letters."""
    bare = _STRIP.sub("", text).lower()
    return int.from_bytes(xxhash.xxh64_digest(bare), "big", signed=True) if _LETTER.search(bare) else 0


def container(line: Line) -> tuple[str, int]:
    """(path, node) of the nearest container that tells something: one with a class or id, a cell, or a speaking element."""
    for i in range(len(line.path) - 1, -1, -1):
        name = line.path[i]
        if name not in _PLAIN and (name != "div" or i == 0):
            return " ".join(x for x in line.path[: i + 1] if x not in _PLAIN and x != "div"), line.nodes[i]
    return "", 0


#: Rows of a batch that are unfolded into Python objects at a time.
SLICE = 256


def _in_slices(fn: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """fn over the columns in slices of SLICE rows, so that a batch of large rows is never unfolded at once."""
    parts = [fn(*[c.slice(at, SLICE) for c in columns]) for at in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else fn(*columns)


_PARSED = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("head", T.BooleanType()), T.StructField("path", T.StringType()), T.StructField("nodes", T.ArrayType(T.IntegerType())), T.StructField("node", T.IntegerType()), T.StructField("linked", T.IntegerType()), T.StructField("k", T.LongType())])
)


@arrow_udf(_PARSED)
def _parse(pages: pa.Array) -> pa.Array:
    return _in_slices(_parse_slice, pages)


def _parse_slice(pages: pa.Array) -> pa.Array:
    cols: list[list] = [[] for _ in range(7)]
    sizes = [0]
    for page in pages.to_pylist():
        for line in lines_of(page):
            path, node = container(line)
            for c, v in zip(cols, (line.text, line.tag in ("h1", "h2"), path, line.nodes, node, line.linked, line_hash(line.text)), strict=True):
                c.append(v)
        sizes.append(len(cols[0]))
    types = [pa.string(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()]
    names = ["text", "head", "path", "nodes", "node", "linked", "k"]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names))


def _best_container(lines: Column) -> Column:
    """The path whose own lines hold the most text that is no link; a heading counts as much as a long line."""
    paths = F.array_distinct(F.transform(lines, lambda x: x["path"]))

    def score(p: Column) -> Column:
        own = F.filter(lines, lambda x: x["path"] == p)
        return F.aggregate(own, F.lit(0), lambda a, x: a + F.length(x["text"]) - 2 * x["linked"] + F.when(x["head"], 100).otherwise(0))

    return F.array_max(F.transform(paths, lambda p: F.struct(score(p).alias("score"), p.alias("path"))))


_RULE = T.MapType(T.StringType(), T.StructType([T.StructField("rank", T.LongType()), T.StructField("noise", T.BooleanType())]))


def host_paths(parsed: DataFrame) -> DataFrame:
    """host, rule: per host a map of path -> (rank, noise) of all paths of its pages.

    A page votes for its best container. A path is noise where most of its text is linked, or most of its lines are repeats of
    lines of the same path on the host; where the host has too few lines of it, the path's figures on all hosts tell, and then
    those of all paths that end in the same container. Votes of all hosts count far less than the host's own.
    Lines are combined by (host, path, line) on the map side; a map holds the generalised paths of one host, which its templates
    bound.
    """
    lines = parsed.select("host", F.explode("lines").alias("x")).select("host", "x.path", "x.k", F.length("x.text").alias("len"), "x.linked")
    kinds = lines.groupBy("host", "path", "k").agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.sum("linked").alias("linked"))
    sums = [F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("len").alias("len"), F.sum("linked").alias("linked")]
    own = kinds.groupBy("host", "path").agg(*sums)
    votes = parsed.select("host", _best_container(F.col("lines"))["path"].alias("path")).filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    per_host = materialized(own.join(votes, ["host", "path"], "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long"))))
    noisy = (F.col("linked") > LINKED * F.col("len")) | (F.col("n") - F.col("kinds") > REPEATED * F.col("n"))
    ending = F.substring_index("path", " ", -1)

    def noise(least: int) -> Column:
        return F.when(F.col("n") >= least, noisy)

    totals = [F.sum(c).alias(c) for c in ("n", "kinds", "len", "linked", "votes")]
    everywhere = per_host.groupBy("path").agg(*totals)
    ends = everywhere.groupBy(ending.alias("ending")).agg(*totals).select("ending", noise(OWN_LINES).alias("by_end"))
    # The figures of a path are one row of its own and of its ending, so both are joined before the hosts' rows meet them.
    told = everywhere.select("path", F.col("votes").alias("all_votes"), noise(ALL_LINES).alias("by_path"), ending.alias("ending")).join(ends, "ending", "left")
    told = told.select("path", "all_votes", F.coalesce("by_path", "by_end", F.lit(False)).alias("elsewhere"))
    told, _ = small_side(told)
    figures = per_host.join(told, "path").select("host", "path", (F.col("votes") * 1_000 + F.col("all_votes")).alias("rank"), F.coalesce(noise(OWN_LINES), "elsewhere").alias("noise"))
    return figures.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("rank", "noise")))).alias("rule"))


def pick(lines: list[dict], rule: dict) -> list[int]:
    """Indices of the lines of the main body of one page's parsed lines; rule is that of its host."""
    score: dict[int, list] = {}
    for x in lines:
        told = rule[x["path"]]
        if not told["noise"] and told["rank"]:
            s = score.setdefault(x["node"], [told["rank"], 0])
            s[1] += len(x["text"]) - 2 * x["linked"]
    if not score:
        return []
    node = max(score, key=lambda n: (score[n][0], score[n][1], -n))
    return [i for i, x in enumerate(lines) if node in x["nodes"] and (x["node"] == node or not rule[x["path"]]["noise"])]


_BODY = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("k", T.LongType()), T.StructField("head", T.BooleanType())]))


@arrow_udf(_BODY)
def _body(pages: pa.Array, rules: pa.Array) -> pa.Array:
    return _in_slices(_body_slice, pages, rules)


def _body_slice(pages: pa.Array, rules: pa.Array) -> pa.Array:
    out = []
    for lines, rule in zip(pages.to_pylist(), rules.to_pylist(), strict=True):
        lines = lines or []
        out.append([{"text": lines[i]["text"], "k": lines[i]["k"], "head": lines[i]["head"]} for i in pick(lines, dict(rule or []))])
    return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("k", pa.int64()), ("head", pa.bool_())])))


def _host(url: str, school: str) -> Column:
    return F.coalesce(website(F.col(url)), F.concat(F.lit("school "), F.col(school)), F.lit(""))


@arrow_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("k", T.LongType()), T.StructField("parts", T.ArrayType(T.LongType()))])))
def _text_lines(texts: pa.Array) -> pa.Array:
    """The lines of a plain text with their hashes and those of their parts between the separators of menus."""
    return _in_slices(_text_slice, texts)


def _text_slice(texts: pa.Array) -> pa.Array:
    sep, blanks = re.compile(_MENU_SEP), re.compile(r"[ \t\r]+")
    out, known = [], {}
    for text in texts.to_pylist():
        lines = []
        for raw in (text or "").split("\n"):
            line = blanks.sub(" ", raw).strip(" ")
            if line:
                parts = [p for p in sep.split(line) if p]
                if len(parts) == 1:
                    parts = line.split(" ")
                for p in parts if len(parts) > 1 else ():
                    if p not in known:
                        known[p] = line_hash(p)
                lines.append({"text": line, "k": line_hash(line), "parts": [known[p] for p in parts] if len(parts) > 1 else []})
        out.append(lines)
    return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("k", pa.int64()), ("parts", pa.list_(pa.int64()))])))


def main_lines(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """src, rec_id, line_text: each line of the main body of crawled_pages and of web rows of notice_docs, once per record.

    Pages: containers are scored, their generalised paths voted on per host, and the page is read again at the winning path
    without the paths inside it that are noise (host_paths, pick). A page whose main body is one line without a heading that
    other pages show as their only one too (a message) has none. Lines that stand in PAGE_SHARE of a host's bodies are the site's.

    Texts have no containers: of their lines those go that are the frame of the host's pages (whole lines, and menus all of
    whose parts are such lines), those that stand in TEXT_SHARE of the host's texts, lines of buttons, neighbours'
    titles behind a sign for the next or the previous notice, and the way to the page (parts joined by '>').

    Null pages and texts give no line; repeated rows count once. A host that no URL tells is the school.
    """
    raw = spread(pages.filter("page_id is not null").select("page_id", _host("source_url", "school_id").alias("host"), "raw_html"), "page_id")
    parsed = materialized(raw.select("page_id", "host", _parse("raw_html").alias("lines")))
    rules, _ = small_side(host_paths(parsed))
    bodies = parsed.join(rules, "host", "left").select("page_id", "host", "lines", _body("lines", F.coalesce("rule", F.create_map().cast(_RULE))).alias("body"))
    inside = F.transform("body", lambda x: x["k"])
    # Of each page the main lines and what it shows outside of them.
    outside = F.array_except(F.transform("lines", lambda x: x["k"]), inside)
    bodies = materialized(bodies.select("page_id", "host", "body", outside.alias("outside")))

    lone = bodies.filter((F.size("body") == 1) & ~F.col("body")[0]["head"]).select(F.col("body")[0]["k"].alias("k"), "page_id")
    message = lone.groupBy("k").agg(F.count_distinct("page_id").alias("n")).filter("n > 1").select("k", F.lit(True).alias("message"))
    message, _ = small_side(message)
    shown = bodies.select("page_id", "host", F.size("body").alias("size"), F.explode("body").alias("x")).select("page_id", "host", "size", "x.text", "x.k", "x.head")
    site_page = _frequent(shown, "page_id", bodies, PAGE_SHARE)
    shown = shown.join(message, "k", "left").join(site_page, ["host", "k"], "left").filter("site is null and not (size = 1 and not head and coalesce(message, false))")
    from_pages = shown.select(F.lit("crawled_pages").alias("src"), F.col("page_id").alias("rec_id"), F.col("text").alias("line_text"))

    web = spread(docs.filter("source_type = 'web' and doc_id is not null").select("doc_id", _host("source_url", "school_id").alias("host"), "content"), "doc_id")
    web = materialized(web.select("doc_id", "host", _text_lines("content").alias("lines")))
    texts = web.select("doc_id", "host", F.explode("lines").alias("x")).select("doc_id", "host", "x.text", "x.k", "x.parts")
    site_text = _frequent(texts, "doc_id", web, TEXT_SHARE)
    frame = _frame_lines(bodies).union(site_text.select("host", "k"))
    frames, _ = small_side(frame.groupBy("host").agg(F.collect_set("k").alias("frame")))
    texts = texts.join(frames, "host", "left").withColumn("frame", F.coalesce("frame", F.array().cast("array<bigint>")))
    # A line of nothing but lost characters tells nothing about menus.
    lost = F.contains("text", F.lit("\ufffd")) & ~F.exists("parts", lambda p: p != 0)
    menu = (F.size("parts") > 1) & F.forall("parts", lambda p: (p == 0) | F.array_contains("frame", p)) & ~lost
    way = F.col("text").rlike(r"(?i)^(?:home|홈|ホーム|首页|메인)\s*[>»›]|^[^>]{1,30} > [^>]{1,30} > ")
    neighbour = F.col("text").rlike("(?i)^" + _NEIGHBOUR)
    labels = F.split(F.regexp_replace(F.lower("text"), r"맨\s위로", "맨위로"), r"[\s|·/]+")
    buttons = F.forall(labels, lambda w: w.isin(*_BUTTONS))
    kept = texts.filter(~F.array_contains("frame", F.col("k")) & ~menu & ~way & ~neighbour & ~buttons)
    from_texts = kept.select(F.lit("notice_docs").alias("src"), F.col("doc_id").alias("rec_id"), F.col("text").alias("line_text"))
    return from_pages.unionByName(from_texts).distinct()


def _frame_lines(bodies: DataFrame) -> DataFrame:
    """host, k of the lines of a host's frame (MIN_DOCS, FRAME_SHARE, OUTSIDE_SHARE).

    bodies has page_id, host, body and outside (hashes of the lines outside the body). Pages without a body tell nothing.
    """
    told = bodies.filter(F.size("body") > 0)
    sides = F.concat(F.transform("outside", lambda k: F.struct(k.alias("k"), F.lit(True).alias("out"))), F.transform(F.array_distinct(F.transform("body", lambda x: x["k"])), lambda k: F.struct(k.alias("k"), F.lit(False).alias("out"))))
    shown = told.select("host", "page_id", F.explode(sides).alias("x")).groupBy("host", "x.k").agg(F.count_distinct(F.when(F.col("x.out"), F.col("page_id"))).alias("n"), F.count_distinct("page_id").alias("pages"))
    totals, _ = small_side(told.groupBy("host").agg(F.count_distinct("page_id").alias("records")))
    most = (F.col("n") >= FRAME_SHARE * F.col("records")) & (F.col("n") >= OUTSIDE_SHARE * F.col("pages"))
    return shown.filter(F.col("n") >= MIN_DOCS).join(totals, "host").filter(most).select("host", "k")


def _frequent(lines: DataFrame, record: str, records: DataFrame, share: float) -> DataFrame:
    """host, k, site (true) of the lines that stand in that share of a host's records; broadcast if their number allows."""
    totals, _ = small_side(records.groupBy("host").agg(F.count_distinct(record).alias("records")))
    counts = lines.filter("k <> 0").groupBy("host", "k").agg(F.count_distinct(record).alias("n")).filter(f"n >= {MIN_DOCS}")
    often = counts.join(totals, "host").filter(F.col("n") >= share * F.col("records")).select("host", "k", F.lit(True).alias("site"))
    return small_side(often)[0]
