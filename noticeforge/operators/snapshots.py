"""What changed between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.urls import normalize_url
from noticeforge.plans.joins import small_side

PREFIX = "__snap_"


def snapshot_changes(
    rows: DataFrame,
    snapshot: str,
    group: str,
    key: dict[str, Column],
    content: Sequence[Column],
    order: Sequence[Column],
    max_groups: int = 200_000,
) -> DataFrame:
    """Added, removed and changed records between consecutive snapshots of each group.

    rows        all delivered rows; `snapshot` and `group` are columns, key and content are expressions over them
    group       the deliverer; a group without a row in a snapshot did not deliver it, so its next snapshot is compared
                with its last one and its first gives no rows
    order       of several rows of a record in one snapshot the greatest by `order` (null is least) holds; rows that tie
                there are resolved by the greatest row hash, so the result never depends on row order
    Result      snapshot (the later one), group, the key columns, change_kind; and hash_before, hash_after.

    Every row is tagged twice, as the `after` side of the pair that ends in its snapshot and as the `before` side of the pair
    that begins there; one aggregation by (pair, key) then classifies from the per-side row hashes. It has map-side
    combination, so repeated rows and hot groups shrink before the only shuffle of rows. Rows with a null snapshot or group
    belong to no delivery and give nothing; null key parts are values like others. Empty input gives an empty result.
    """
    s, g = F.col(f"{PREFIX}s"), F.col(f"{PREFIX}g")
    base = rows.select(
        F.col(snapshot).alias(f"{PREFIX}s"), F.col(group).alias(f"{PREFIX}g"),
        *[c.alias(f"{PREFIX}k_{n}") for n, c in key.items()],
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*content).alias("hash")).alias(f"{PREFIX}v"),
    ).filter(s.isNotNull() & g.isNotNull())
    # One row per group: the deliveries that exist, from two columns of the scan.
    plan = rows.select(F.col(snapshot).alias(f"{PREFIX}s"), F.col(group).alias(f"{PREFIX}g")).filter(s.isNotNull() & g.isNotNull())
    plan = plan.groupBy(f"{PREFIX}g").agg(F.array_sort(F.collect_set(f"{PREFIX}s")).alias(f"{PREFIX}all"))
    plan, _ = small_side(plan)
    here = F.array_position(f"{PREFIX}all", s).cast("int")
    sides = F.array(
        F.when(here > 1, F.struct(s.alias("pair"), F.lit(True).alias("after"))),
        F.when(here < F.size(f"{PREFIX}all"), F.struct(F.get(F.col(f"{PREFIX}all"), here).alias("pair"), F.lit(False).alias("after"))),
    )
    keys = [f"{PREFIX}k_{n}" for n in key]
    tagged = base.join(plan, f"{PREFIX}g").withColumn(f"{PREFIX}t", F.explode(F.filter(sides, lambda x: x.isNotNull())))
    value, after = F.col(f"{PREFIX}v"), F.col(f"{PREFIX}t.after")
    done = tagged.groupBy(F.col(f"{PREFIX}t.pair").alias(f"{PREFIX}pair"), g, *keys).agg(
        F.max(F.when(~after, value))["hash"].alias(f"{PREFIX}b"), F.max(F.when(after, value))["hash"].alias(f"{PREFIX}a"),
    )
    b, a = F.col(f"{PREFIX}b"), F.col(f"{PREFIX}a")
    kind = F.when(b.isNull(), "added").when(a.isNull(), "removed").when(a != b, "changed")
    return done.withColumn(f"{PREFIX}kind", kind).filter(F.col(f"{PREFIX}kind").isNotNull()).select(
        F.col(f"{PREFIX}pair").alias(snapshot), g.alias(group), *[F.col(f"{PREFIX}k_{n}").alias(n) for n in key],
        F.col(f"{PREFIX}kind").alias("change_kind"), b.alias("hash_before"), a.alias("hash_after"),
    )


def document_changes(docs: DataFrame) -> DataFrame:
    """snapshot_changes of Document rows: a record is (school_id, normal source_url, chunk_index).

    changed means another content_hash (case and outer blanks aside; null is a value) or miss_count (null is 0).
    """
    return snapshot_changes(
        docs, "snapshot_no", "school_id",
        {"source_url": normalize_url(F.col("source_url")), "chunk_index": F.col("chunk_index")},
        [F.lower(F.trim("content_hash")), F.coalesce("miss_count", F.lit(0))],
        [F.col("crawled_at"), F.col("delivered_at")],
    )
