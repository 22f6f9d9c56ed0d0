"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from noticeforge.llm.tokens import encode_tokens
from noticeforge.plans.joins import spread
from noticeforge.sources.tables import materialized

#: Most listed sources: the targets and one row of sums per source are planned on the driver.
MAX_SOURCES = 100_000
#: Parts into which an epoch's order of a source is cut, so that no task sorts a whole source.
EPOCH_PARTS = 4096


@dataclass
class Leaf:
    """One source of the tree."""

    source: str
    domain: str
    language: str
    share: float
    tokens: int
    max_repeat: int
    budget: float = 0.0

    @property
    def capacity(self) -> float:
        return float(self.tokens * self.max_repeat)


def _fill(nodes: dict[str, tuple[float, float]], budget: float) -> dict[str, float]:
    """budget spread over siblings (weight, capacity) by weight; what one can't take goes to the others by weight."""
    got, free = dict.fromkeys(nodes, 0.0), {k for k, (w, c) in nodes.items() if w > 0 and c > 0}
    left = budget
    while free and left > 1e-9:
        weight = sum(nodes[k][0] for k in free)
        full = {k for k in free if left * nodes[k][0] / weight >= nodes[k][1] - got[k]}
        if not full:
            for k in free:
                got[k] += left * nodes[k][0] / weight
            break
        for k in full:
            left -= nodes[k][1] - got[k]
            got[k] = nodes[k][1]
        free -= full
    return got


def plan_budgets(leaves: Iterable[Leaf], total: float) -> list[Leaf]:
    """The leaves with their budgets of tokens.

    Weights go down the tree domain - language - source. What a source can't take (its tokens times max_repeat is less) goes
    to its siblings of the same language and domain first, then to the other languages of the domain, then to other domains.
    """
    leaves = list(leaves)

    def descend(members: list[Leaf], levels: list[str], budget: float) -> None:
        groups: dict[str, list[Leaf]] = {}
        for leaf in sorted(members, key=lambda x: x.source):
            groups.setdefault(getattr(leaf, levels[0]), []).append(leaf)
        spread = _fill({k: (sum(x.share for x in g), sum(x.capacity for x in g)) for k, g in groups.items()}, budget)
        for k, g in groups.items():
            if len(levels) == 1:
                g[0].budget = spread[k]
            else:
                descend(g, levels[1:], spread[k])

    descend(leaves, ["domain", "language", "source"], min(total, sum(x.capacity for x in leaves if x.share > 0)))
    return leaves


def exact_total(leaves: Iterable[Leaf]) -> float:
    """The largest total at which every source that has tokens can meet its planned budget without a shortage."""
    leaves = [x for x in leaves if x.share > 0 and x.capacity > 0]
    if not leaves:
        return 0.0
    # With a very small total only empty sources fall short; the budgets then grow in proportion to the total.
    unit = sum(x.capacity for x in leaves) * 1e-9 / max(1, len(leaves))
    tiny = min([unit, *(x.capacity * 1e-6 for x in leaves)])
    return min(x.capacity / x.budget * tiny for x in plan_budgets(leaves, tiny) if x.budget > 0)


def source_key(source: Column) -> Column:
    """Sources that differ in case and outer blanks are one."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def _epoch_hash(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col("doc_id"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = 42, distinct_texts: bool = False, **tokenizer: str
) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of texts put together so that each source has its target share of the tokens.

    docs      doc_id, text, lang, source; texts that are null or have no token are left out; of rows with one doc_id the smallest counts; with distinct_texts, texts that are equal count as one
              (the smallest doc_id stands for them, in its own source)
    targets   source, target_share, max_repeat; shares are scaled to sum 1, a null share is 0, a null max_repeat 1; of several
              rows of one source the greatest holds
    total     tokens to reach; by default all tokens of the listed sources, so that shortages of small ones are redistributed;
              "exact" is the largest total at which no source with texts falls short of its share
    uses      doc_id, source, epoch (from 1), n_tokens: one row per use of a text. Each epoch takes a source's texts in its own
              seeded order; the last one is a prefix of that order by tokens, so no text is used twice before all were used once.
    shares    one row per target source, those without texts too: source, domain, language, target_share, budget_tokens,
              n_texts, n_copies (texts that another document of the source has too, all but one of them), source_tokens,
              mixed_tokens, actual_share, full_epochs, max_repeat

    Tree: the domain is what follows the last '-' of a source's name, the language the one of most of its tokens. Only sums
    per listed source reach the driver (MAX_SOURCES at most); a source of any size is cut into EPOCH_PARTS parts of each
    epoch's order, and only the part in which the budget ends is sorted. The sources' texts never meet in one task.
    """
    spark = docs.sparkSession
    wanted = targets.select(
        source_key(F.col("source")).alias("source"), F.coalesce(F.greatest("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.coalesce(F.greatest("max_repeat", F.lit(0)), F.lit(1)).cast("int").alias("max_repeat"),
    ).filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("share").alias("share"), F.max("max_repeat").alias("max_repeat"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    listed = docs.select("doc_id", "text", F.lower(F.trim("lang")).alias("lang"), source_key(F.col("source")).alias("source"))
    listed = listed.filter(F.length("text") > 0).join(F.broadcast(names), "source", "left_semi")
    sized = encode_tokens(spread(listed, "doc_id"), "text", "n_tokens", count_only=True, **tokenizer).filter("n_tokens > 0")
    sized = sized.select("doc_id", "source", "lang", "n_tokens", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    one = F.min(F.struct("doc_id", "source", "lang", "n_tokens", "h", "g")).alias("x")
    sized = sized.groupBy("doc_id").agg(one).select("x.*")
    if distinct_texts:
        sized = sized.groupBy("h", "g").agg(one).select("x.*")
    texts = materialized(sized)
    copies = texts.groupBy("source", "h", "g").agg((F.count("*") - 1).alias("c")).groupBy("source").agg(F.sum("c").alias("n_copies"))
    texts = texts.select("doc_id", "source", "lang", "n_tokens")
    sums = texts.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    found: dict[str, tuple[int, int, str]] = {}
    by_lang = sums.groupBy("source").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.max(F.struct("t", F.coalesce("lang", F.lit("")).alias("lang")))["lang"].alias("lang"))
    for r in by_lang.collect():  # at most one row per listed source
        found[r["source"]] = (r["n"], r["t"], r["lang"] or "?")
    scale = sum(r["share"] for r in rows) or 1.0
    leaves = [
        Leaf(r["source"], r["source"].rsplit("-", 1)[-1], found.get(r["source"], (0, 0, "?"))[2], r["share"] / scale, found.get(r["source"], (0, 0, "?"))[1], r["max_repeat"])
        for r in rows
    ]
    if total_tokens is None:
        total_tokens = sum(x.tokens for x in leaves)
    plan_budgets(leaves, exact_total(leaves) if total_tokens == "exact" else float(total_tokens))
    schema = "source string, domain string, language string, target_share double, n_texts long, source_tokens long, max_repeat int, budget_tokens double, full_epochs int, rest long"
    rest = lambda x: (int(x.budget + 1e-6) % x.tokens if x.tokens else 0)
    full = lambda x: (int(x.budget + 1e-6) // x.tokens if x.tokens else 0)
    plan = spark.createDataFrame([(x.source, x.domain, x.language, x.share, found.get(x.source, (0, 0, ""))[0], x.tokens, x.max_repeat, x.budget, full(x), rest(x)) for x in leaves], schema)
    small = F.broadcast(plan.select("source", "full_epochs", "rest"))
    whole = texts.join(small, "source").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("full_epochs") + F.lit(1))))
    whole = whole.filter((F.col("epoch") <= F.col("full_epochs")) | (F.col("rest") > 0))
    ordered = whole.withColumn("order", _epoch_hash(seed, F.col("epoch"))).withColumn("part", F.pmod("order", F.lit(EPOCH_PARTS)).cast("int"))
    last = ordered.filter(F.col("epoch") > F.col("full_epochs"))
    parts = last.groupBy("source", "part").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    upto = W.Window.partitionBy("source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    edge = parts.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))  # EPOCH_PARTS rows a source at most
    inside = edge.filter(F.col("before") + F.col("t") <= F.col("rest")).select("source", "part", F.lit(None).cast("long").alias("room"))
    cut = edge.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).select("source", "part", (F.col("rest") - F.col("before")).alias("room"))
    taken = last.join(inside.unionByName(cut), ["source", "part"])
    run = W.Window.partitionBy("source").orderBy("order", "doc_id").rowsBetween(W.Window.unboundedPreceding, 0)
    fitting = taken.filter("room is not null").withColumn("so_far", F.sum("n_tokens").over(run)).filter("so_far <= room").drop("so_far")
    cols = ["doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "n_tokens"]
    uses = ordered.filter(F.col("epoch") <= F.col("full_epochs")).select(*cols).unionByName(taken.filter("room is null").select(*cols)).unionByName(fitting.select(*cols))
    mixed = uses.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    every = W.Window.partitionBy(F.lit(1))
    shares = plan.join(mixed, "source", "left").join(copies, "source", "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(0).cast(T.LongType())))
    shares = shares.withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast(T.LongType())))
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(every)), F.lit(0.0)))
    return uses, shares.drop("rest")
