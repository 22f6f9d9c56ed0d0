"""Quality checks of crawls, of sampled pages and of specifications, and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noticeforge.functions.text import squash, strip, titles_match

#: Bounds of the checks, and the findings that forbid a specification and those that speak of single pages.
MIN_ROWS, MIN_TITLES, MIN_DATES, MIN_CONTENT, DROP = 1, 0.9, 0.7, 50, 0.5
BLOCKING = ("NO_LISTING_ROWS", "MISSING_TITLES", "LISTING_FETCH_FAILED", "DETAIL_NOT_IN_LISTING", "NO_BODY_SELECTOR")
SAMPLED = ("EMPTY_CONTENT", "TITLE_MISMATCH", "NEIGHBOUR_LEAK", "BODY_SELECTOR_NOT_FOUND")
DEFAULT_BOARD = "기본"


def ratio(true: Column) -> Column:
    """Share of rows where a predicate holds; null counts as false, no row gives 0."""
    return F.coalesce(F.avg(F.coalesce(true, F.lit(False)).cast("int").cast("double")), F.lit(0.0))


def _codes(*cases: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(code)) for code, hit in cases]), lambda c: c.isNotNull())


def board_quality(items: DataFrame, group: list[str], loop: str | None = None) -> DataFrame:
    """group, listing_rows, title_ratio, date_ratio, findings of listing items (title, published_at) per board.

    A board's rows without a url (a board of which no item could be read) are no items: with fewer than MIN_ROWS items the only
    finding is NO_LISTING_ROWS. `loop` names a boolean column: whether the board's next page is the page itself.
    """
    is_item = F.col("url").isNotNull() if "url" in items.columns else F.lit(True)
    looped = F.bool_or(F.coalesce(F.col(loop), F.lit(False))) if loop else F.lit(False)
    out = items.groupBy(*group).agg(
        F.count_if(is_item).alias("listing_rows"), ratio(F.when(is_item, F.coalesce(strip("title") != "", F.lit(False)))).alias("title_ratio"),
        ratio(F.when(is_item, F.col("published_at").isNotNull())).alias("date_ratio"), looped.alias("__loop"),
    )
    some = F.col("listing_rows") >= MIN_ROWS
    codes = _codes(("NO_LISTING_ROWS", ~some), ("MISSING_TITLES", some & (F.col("title_ratio") < MIN_TITLES)), ("MISSING_DATES", some & (F.col("date_ratio") < MIN_DATES)), ("PAGINATION_LOOP", some & F.col("__loop")))
    return out.withColumn("findings", codes).drop("__loop")


def board_of(pages: DataFrame, boards: DataFrame) -> DataFrame:
    """pages with the board they were found on (boards: url, board); pages of none belong to the default one."""
    known = boards.groupBy("url").agg(F.min("board").alias("board"))
    return pages.join(known, "url", "left").withColumn("board", F.coalesce("board", F.lit(DEFAULT_BOARD)))


def sample(pages: DataFrame, group: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first n pages of each board; ranking keeps n rows a task before its shuffle."""
    place = F.row_number().over(W.Window.partitionBy(*group).orderBy(*order))
    return pages.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def detail_findings(pages: DataFrame, items: DataFrame, group: list[str], key: str) -> DataFrame:
    """key, findings of sampled pages (group, key, hint, title, content, fallback) against their board's items (group, title).

    EMPTY_CONTENT below MIN_CONTENT characters; TITLE_MISMATCH if the listing's title (hint) is another notice's;
    NEIGHBOUR_LEAK if another title of the board stands in the content; BODY_FALLBACK if the page has no body of its own. Only
    sampled pages may come in: each meets every title of its board.
    """
    titles = items.filter(squash("title") != "").select(*group, F.col("title").alias("__other")).distinct()
    met = pages.join(titles, group).filter(~F.col("__other").eqNullSafe(F.col("hint")) & F.contains(squash("content"), squash("__other")))
    leaks = met.select(key).distinct().withColumn("__leak", F.lit(True))
    codes = _codes(
        ("EMPTY_CONTENT", F.length(strip(F.coalesce("content", F.lit("")))) < MIN_CONTENT),
        ("TITLE_MISMATCH", (F.col("hint") != "") & ~titles_match(F.col("hint"), F.col("title"), F.col("content"))),
        ("NEIGHBOUR_LEAK", F.col("__leak")), ("BODY_FALLBACK", F.col("fallback")),
    )
    return pages.join(leaks, key, "left").select(key, codes.alias("findings"))


def spec_findings(samples: DataFrame, items: DataFrame, site: str, has_body: str) -> DataFrame:
    """site, url, code of sampled pages (site, url, found: whether a body was met) held against a specification's listing items.

    A page that the listing does not link to is DETAIL_NOT_IN_LISTING, and nothing else is asked of it; then a specification
    without a body selector (`has_body`) gives NO_BODY_SELECTOR, and one whose selectors are not there BODY_SELECTOR_NOT_FOUND.
    """
    listed = items.select(site, "url").distinct().withColumn("__listed", F.lit(True))
    code = F.when(F.col("__listed").isNull(), "DETAIL_NOT_IN_LISTING").when(~F.coalesce(F.col(has_body), F.lit(False)), "NO_BODY_SELECTOR").when(~F.coalesce("found", F.lit(False)), "BODY_SELECTOR_NOT_FOUND")
    return samples.join(listed, [site, "url"], "left").select(site, "url", code.alias("code")).filter("code is not null")


def latest_run(history: DataFrame, group: str, run: str, at: str) -> DataFrame:
    """All rows of each group's latest run (by at, then run)."""
    last = history.groupBy(group).agg(F.max(F.struct(at, run))[run].alias("__run"))
    return history.join(last, group).filter(F.col(run).eqNullSafe(F.col("__run"))).drop("__run")


def drops(history: DataFrame, group: list[str], at: str, value: str, least: float = DROP) -> DataFrame:
    """history with previous (the value of the run before) and dropped (LISTING_ROWS_DROPPED): below that share of it."""
    before = F.lag(value).over(W.Window.partitionBy(*group).orderBy(at))
    return history.withColumn("previous", before).withColumn("dropped", F.coalesce((F.col("previous") > 0) & (F.col(value) < F.col("previous") * least), F.lit(False)))


def previous_rows(history: DataFrame, group: list[str], run: str, at: str, value: str, current: Column) -> DataFrame:
    """group, previous: the latest value of each board from another run than the current one."""
    return history.filter(~F.col(run).eqNullSafe(current)).groupBy(*group).agg(F.max(F.struct(at, run, value))[value].alias("previous"))


def acceptable(findings: DataFrame, group: list[str], samples: str) -> DataFrame:
    """group, accepted: no BLOCKING finding, and SAMPLED ones for half the samples at most (rounded down, none without samples).

    findings has a row per finding (code) or one with a null code; `samples` names the column of the number of sampled pages.
    """
    hit = findings.groupBy(*group).agg(F.count_if(F.col("code").isin(*BLOCKING)).alias("b"), F.count_if(F.col("code").isin(*SAMPLED)).alias("s"), F.max(samples).alias("n"))
    return hit.select(*group, ((F.col("b") == 0) & ((F.col("s") == 0) | (F.col("s") <= F.floor(F.col("n") / 2)))).alias("accepted"))


def rollup(boards: DataFrame, schools: DataFrame, group: str) -> DataFrame:
    """group, boards, state, checked_at of all schools: ok if no board has a finding, else warning; unknown without boards."""
    good = F.bool_and(F.size("findings") == 0)
    known = boards.groupBy(group).agg(F.count("*").alias("boards"), F.when(good, "ok").otherwise("warning").alias("state"), F.max("checked_at").alias("checked_at"))
    out = schools.select(group).distinct().join(known, group, "left")
    return out.withColumns({"boards": F.coalesce("boards", F.lit(0).cast("bigint")), "state": F.coalesce("state", F.lit("unknown"))})


def usable(rows: Column, title_ratio: Column, body_chars: Column) -> Column:
    """Whether a board can be collected: it has rows, nearly all have titles, and sampled bodies are no shells."""
    return F.coalesce((rows > 0) & (title_ratio >= MIN_TITLES) & (body_chars >= MIN_CONTENT), F.lit(False))


def batch_summary(sites: DataFrame) -> DataFrame:
    """usable, total of sites (listing_rows, title_ratio, body_chars)."""
    ok = usable(F.col("listing_rows"), F.col("title_ratio"), F.col("body_chars"))
    return sites.agg(F.count_if(ok).alias("usable"), F.count("*").alias("total"))
