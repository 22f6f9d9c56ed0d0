from __future__ import annotations

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from noticeforge.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_entry_and_names(spark: SparkSession) -> None:
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_core_query_matches_its_sql(spark: SparkSession, name: str) -> None:
    import duckdb

    df = entry.queries()[name](spark, SF)
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    con.execute("SET TimeZone = 'UTC'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rel.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_core_does_not_import_the_subpackage() -> None:
    root = Path(entry.__file__).parent / "noticeforge"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"noticeforge\.llm|from \.+llm", path.read_text()), path
