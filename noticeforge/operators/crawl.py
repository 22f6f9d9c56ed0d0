"""Crawl frontier, change detection and rules over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noticeforge.functions.urls import normalize_url, origin
from noticeforge.plans.windows import ranked, running_sum


def classify_changes(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages (school_id, url, content_hash) with crawl_status: unchanged if the hash is known for the URL, changed if only the URL is, else new."""
    urls = known.groupBy("school_id", "url").agg(F.lit(True).alias("__url"))
    hashes = known.groupBy("school_id", "url", "content_hash").agg(F.lit(True).alias("__hash"))
    out = pages.join(urls, ["school_id", "url"], "left").join(hashes, ["school_id", "url", "content_hash"], "left")
    return out.withColumn("crawl_status", F.when(F.col("__hash"), "unchanged").when(F.col("__url"), "changed").otherwise("new")).drop("__url", "__hash")


def first_seen(pages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by `order`."""
    rest = [c for c in pages.columns if c not in key]
    return pages.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__x")).select(*key, "__x.*")


def round_robin(items: DataFrame, group: str, board: str, position: str, max_items: int = 300) -> DataFrame:
    """items with turn (1..) and place: boards of a group take turns, one item each, at most max_items a board."""
    capped = ranked(items, [group, board], [position], "turn").filter(F.col("turn") <= max_items)
    return ranked(capped, [group], ["turn", board], "place")


def within_budget(items: DataFrame, group: str, order: list[str], cost: str, budget: int, seconds: str | None = None, deadline: float | None = None) -> DataFrame:
    """The items of each group whose running cost by `order` stays within the budget, and which begin before the deadline.

    `seconds` names a column of the time that each item takes; the deadline counts from the group's first item.
    """
    out = running_sum(items, [group], order, F.col(cost), "spent").filter(F.col("spent") <= budget)
    if seconds is None or deadline is None:
        return out
    timed = running_sum(out, [group], order, F.col(seconds), "__until")
    return timed.filter(F.col("__until") - F.col(seconds) < deadline).drop("__until")


def budget_failure(spent: Column, budget: int, begun: Column, deadline: float) -> Column:
    """struct(stage, error_code, retryable) of an item that was not fetched as the requests or the time were used up; else null."""
    code = F.when(spent > budget, "MAX_REQUESTS_EXCEEDED").when(begun >= deadline, "TIME_BUDGET_EXCEEDED")
    return F.when(code.isNotNull(), F.struct(F.lit("budget").alias("stage"), code.alias("error_code"), F.lit(True).alias("retryable")))


def early_stop(pages: DataFrame, board: list[str], page: str, unchanged: str) -> DataFrame:
    """The listing pages up to and with the first one that is wholly unchanged, per board."""
    before = F.max(F.col(unchanged).cast("int")).over(W.Window.partitionBy(*board).orderBy(page).rowsBetween(W.Window.unboundedPreceding, -1))
    return pages.withColumn("__stop", F.coalesce(before, F.lit(0))).filter("__stop = 0").drop("__stop")


def in_scope(url: Column, hosts: list[str], prefixes: list[str]) -> Column:
    """Whether a URL's host (ports aside) and path are allowed; empty lists allow all, a URL without a host is out."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    by_host = host.isin(*[h.lower() for h in hosts]) if hosts else host != ""
    by_path = F.lit(True)
    if prefixes:
        by_path = F.lit(False)
        for p in prefixes:
            by_path |= path.startswith(p)
    return by_host & by_path


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with allowed: of an origin's rules (origin, allow, pattern) that match, the longest holds, allow on a tie.

    A pattern is a path prefix with * for any text and a closing $ for the end; no rule that matches allows.
    """
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1), "^$", "/")
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([\\.\[\](){}+?^|])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\$(?!$)", r"\\\\\\$"))
    left = urls.select("url").distinct().withColumn("origin", origin(F.col("url"))).withColumn("__path", path)
    hits = left.join(rules.withColumn("__re", regex), "origin", "left").withColumn("__hit", F.expr("__path rlike __re"))
    best = F.max(F.when(F.col("__hit"), F.struct(F.length("pattern").alias("n"), F.col("allow").alias("allow"))))
    verdict = hits.groupBy("url").agg(F.coalesce(best["allow"], F.lit(True)).alias("allowed"))
    return urls.join(verdict, "url", "left")


def node_cap(chunks: DataFrame, group: str, order: str, key: str, cap: int = 1200) -> DataFrame:
    """group, order of the chunks that are indexed until `cap` distinct keys of the group are stored (the chunk that reaches it counts)."""
    first = chunks.groupBy(group, key).agg(F.min(order).alias(order)).groupBy(group, order).agg(F.count("*").alias("__new"))
    steps = chunks.select(group, order).distinct().join(first, [group, order], "left").withColumn("__new", F.coalesce("__new", F.lit(0)))
    before = F.coalesce(F.sum("__new").over(W.Window.partitionBy(group).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("__before", before).filter(F.col("__before") < cap).select(group, order)


def adjacent_dedupe(lines: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """lines without those that repeat the line just before them, blanks aside."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return lines.withColumn("__k", bare).withColumn("__b", F.lag("__k").over(W.Window.partitionBy(*group).orderBy(order))).filter(~F.col("__k").eqNullSafe(F.col("__b"))).drop("__k", "__b")


def miss_streaks(seen: DataFrame, key: list[str], run: str) -> DataFrame:
    """key, streak: runs since the record was last seen, of (key, run, seen) rows."""
    last = F.max(F.when(F.col("seen"), F.col(run)))
    at = seen.groupBy(*key).agg(last.alias("__last"))
    late = F.coalesce(F.col(run) > F.col("__last"), F.lit(True))
    return seen.select(*key, run).distinct().join(at, key).groupBy(*key).agg(F.count_if(late).alias("streak"))


def same_page(a: Column, b: Column) -> Column:
    """Whether two URLs have one normal form."""
    return normalize_url(a) == normalize_url(b)
