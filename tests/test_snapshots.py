from __future__ import annotations

from pyspark.sql import SparkSession

from noticeforge.operators.snapshots import document_changes

SCHEMA = "snapshot_no int, delivered_at timestamp, school_id long, source_url string, chunk_index int, content_hash string, crawled_at timestamp, miss_count int, pair string, after string, hash string, __snap_x int"


def rows(*items: tuple) -> list[tuple]:
    """(snapshot, school, url, chunk, hash, crawled day, delivered day, misses) with clashing extra columns."""
    day = lambda d: None if d is None else __import__("datetime").datetime(2025, 1, d)
    return [(s, day(e), c, u, k, h, day(w), m, "p", "a", "h", 1) for s, c, u, k, h, w, e, m in items]


def changes(spark: SparkSession, *items: tuple) -> set[tuple]:
    out = document_changes(spark.createDataFrame(rows(*items), SCHEMA)).collect()
    found = [(r["snapshot_no"], r["school_id"], r["source_url"], r["chunk_index"], r["change_kind"]) for r in out]
    assert len(found) == len(set(found))
    return set(found)


def test_kinds(spark: SparkSession) -> None:
    got = changes(
        spark,
        (1, 1, "HTTPS://A.x/b/?utm_a=1&z=2&y=1#f", 0, "AB", 1, 1, None), (2, 1, "https://a.x/b?y=1&z=2", 0, "ab", 2, 2, 0),
        (1, 1, "https://a.x/c", 0, "h", 1, 1, 0), (2, 1, "https://a.x/c", 0, "h", 1, 1, 1),
        (1, 1, "https://a.x/d", 0, "h", 1, 1, 0), (2, 1, "https://a.x/e", 0, "h", 1, 1, 0),
    )
    assert got == {(2, 1, "https://a.x/c", 0, "changed"), (2, 1, "https://a.x/d", 0, "removed"), (2, 1, "https://a.x/e", 0, "added")}


def test_undelivered_snapshot_is_skipped(spark: SparkSession) -> None:
    got = changes(spark, (1, 1, "u", 0, "a", 1, 1, 0), (3, 1, "u", 0, "b", 1, 1, 0), (1, 2, "u", 0, "a", 1, 1, 0), (2, 2, "u", 0, "a", 1, 1, 0))
    assert got == {(3, 1, "u", 0, "changed")}


def test_latest_version_and_repeats(spark: SparkSession) -> None:
    old, new, late = (2, 1, "u", 0, "x", 1, 9, 0), (2, 1, "u", 0, "a", 2, 1, 0), (2, 1, "u", 0, "y", 2, None, 0)
    assert changes(spark, (1, 1, "u", 0, "a", 1, 1, 0), old, new, new, late) == set()


def test_ties_do_not_depend_on_order(spark: SparkSession) -> None:
    a, b, base = (2, 1, "u", 0, "x", 2, 2, 0), (2, 1, "u", 0, "y", 2, 2, 0), (1, 1, "u", 0, "a", 1, 1, 0)
    assert changes(spark, base, a, b) == changes(spark, b, a, base) == {(2, 1, "u", 0, "changed")}


def test_nulls_and_empty(spark: SparkSession) -> None:
    assert changes(spark, (None, 1, "u", 0, "a", 1, 1, 0), (1, None, "u", 0, "a", 1, 1, 0)) == set()
    got = changes(spark, (1, 1, None, None, None, None, None, None), (2, 1, None, None, "a", None, None, None), (2, 1, "u" * 100_000, 0, None, None, None, 0))
    assert {g[4] for g in got} == {"changed", "added"}
    assert document_changes(spark.createDataFrame([], SCHEMA)).count() == 0
