from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noticeforge.operators import crawl, graph, quality, rag, store, vector
from noticeforge.streaming.incremental import VersionedTable, detect, maintain

DOC = "doc_id long, school_id long, source_url string, source_type string, miss_count int, expired_at timestamp"


def test_upsert_is_idempotent_and_numbers_new_rows(spark: SparkSession) -> None:
    t = spark.createDataFrame([(7, "a", "x", 2), (9, None, "n", 1)], "id long, k string, v string, m int")
    s = spark.createDataFrame([("a", "y"), ("c", "z"), ("b", "w")], "k string, v string")
    once = store.upsert(t, s, ["k"], ["v"], {"m": F.lit(0)}, "id")
    assert sorted(map(tuple, once.collect())) == [(7, "a", "y", 0), (9, None, "n", 1), (10, "b", "w", 0), (11, "c", "z", 0)]
    again = store.upsert(once, s, ["k"], ["v"], {"m": F.lit(0)}, "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    assert store.upsert(t.limit(0), s.limit(0), ["k"], ["v"], None, "id").count() == 0


def test_entities_and_edges(spark: SparkSession) -> None:
    e = spark.createDataFrame(
        [(1, "k", 1, "t", "first", {"a": "1", "b": "1"}, [3, 1]), (1, "k", 2, "u", "second", {"a": "2", "c": None}, [2, 3]), (1, "k", 3, "v", "none", {"a": "9"}, []), (1, "z", 1, None, None, None, [None, 4])],
        "school_id long, norm_key string, ord int, type string, name string, attributes map<string,string>, source_doc_ids array<long>",
    )
    got = {r["norm_key"]: r for r in store.merge_entities(e).collect()}
    assert got["k"]["name"] == "first" and got["k"]["attributes"] == {"a": "2", "b": "1", "c": None} and got["k"]["source_doc_ids"] == [1, 2, 3]
    assert got["z"]["attributes"] == {} and got["z"]["source_doc_ids"] == [4]
    edges = spark.createDataFrame([(1, 2, "r", [2, 1]), (1, 2, "r", [3]), (1, 9, "r", [1]), (2, 2, "r", [])], "src long, tgt long, relation string, doc_ids array<long>")
    nodes = spark.createDataFrame([(1,), (2,), (2,)], "node long")
    assert [tuple(r) for r in store.merge_edges(edges, nodes).collect()] == [(1, 2, "r", [1, 2, 3])]


def test_observe_and_expire(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, 1, "a", "web", 2, None), (2, 1, "b", "web", 2, None), (3, 1, "c", "attachment", 1, None), (4, 2, "a", "web", None, None)], DOC)
    seen = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "")], "school_id long, source_url string")
    after = store.expire(store.observe(docs, seen), F.lit("2026-01-01").cast("timestamp"))
    assert {r["doc_id"]: (r["miss_count"], r["expired_at"] is not None) for r in after.collect()} == {1: (0, False), 2: (3, True), 3: (1, False), 4: (None, False)}


def test_graph(spark: SparkSession) -> None:
    e = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 3), (4, 4, 5)], "edge_id long, src long, tgt long")
    assert [tuple(r) for r in graph.degree_top(e, 2).collect()] == [(2, 2), (3, 2)]
    nodes = spark.createDataFrame([(2,), (3,), (9,)], "node long")
    assert {tuple(r) for r in graph.subgraph_degree(nodes, e).collect()} == {(2, 1), (3, 3), (9, 0)}
    assert {r["edge_id"] for r in graph.neighbours(e, nodes).collect()} == {1, 2, 3}
    assert graph.degree_top(e.limit(0), 5).count() == 0


def test_vector(spark: SparkSession) -> None:
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "item_id long, i_vec array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "query_id long, q_vec array<float>")
    got = [tuple(r) for r in vector.top_k(asked, items, 3).select("query_id", "item_id", "score", "rank").orderBy("rank").collect()]
    assert got == [(7, 1, 1.0, 1), (7, 2, 1.0, 2), (7, 3, 0.0, 3)]
    assert vector.top_k(asked, items, 0).count() == 0 and vector.above(vector.top_k(asked, items, 3), 0.5).count() == 2


def test_hybrid_and_context(spark: SparkSession) -> None:
    hit = "query_id long, item_id long, score double, rank long"
    g = spark.createDataFrame([(1, 1, 0.7, 1), (2, 1, 0.5, 1)], hit)
    d = spark.createDataFrame([(1, 5, 0.9, 1), (2, 6, 0.4, 1), (3, 7, 0.1, 1)], hit)
    assert {(r["question_id"], r["stage"], r["item_id"]) for r in rag.hybrid(g, d).collect()} == {(1, "graph", 1), (2, "document", 6)}
    hits = spark.createDataFrame([(1, "u", "t", 3, 2, "b"), (1, "u", "t", 1, 1, "a"), (1, "v", None, None, 3, None)], "question_id long, url string, title string, page int, rank long, content string")
    assert rag.contexts(hits).first()["context"] == "[근거 1] t - 1페이지\na\n\n[근거 2] t - 3페이지\nb\n\n[근거 3] (제목 없음)\n"
    assert {r["url"]: r["label"] for r in rag.merge_sources(hits).collect()} == {"u": "t - 1, 3페이지", "v": "(제목 없음)"}


def test_crawl_rules(spark: SparkSession) -> None:
    urls = spark.createDataFrame([("http://h/a/b",), ("http://h/a/x.pdf",), ("http://h/c",), ("http://o/a/b",)], "url string")
    rules = spark.createDataFrame([("http://h", False, "/a/"), ("http://h", True, "/a/b"), ("http://h", False, "/*.pdf$")], "origin string, allow boolean, pattern string")
    assert {r["url"]: r["allowed"] for r in crawl.robots_allowed(urls, rules).collect()} == {"http://h/a/b": True, "http://h/a/x.pdf": False, "http://h/c": True, "http://o/a/b": True}
    items = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 5)], "g int, board string, pos int")
    assert [r["pos"] for r in crawl.round_robin(items, "g", "board", "pos").orderBy("place").collect()] == [1, 5, 2]
    chunks = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (1, 3, "c")], "g int, o int, k string")
    assert {r["o"] for r in crawl.node_cap(chunks, "g", "o", "k", 2).collect()} == {1, 2}


def test_quality_rules(spark: SparkSession) -> None:
    codes = [(1, "EMPTY_CONTENT", 3), (1, "TITLE_MISMATCH", 3), (2, "MISSING_TITLES", 9), (3, "NEIGHBOUR_LEAK", 3), (4, "MISSING_DATES", 0), (5, None, 0), (6, "EMPTY_CONTENT", 1)]
    findings = spark.createDataFrame(codes, "t int, code string, n int")
    assert {r["t"]: r["accepted"] for r in quality.acceptable(findings, ["t"], "n").collect()} == {1: False, 2: False, 3: True, 4: True, 5: True, 6: False}
    items = spark.createDataFrame([(1, "u", "t", None, True), (1, "v", " ", None, False), (2, None, None, None, None)], "b int, url string, title string, published_at timestamp, loop boolean")
    got = {r["b"]: (r["listing_rows"], r["findings"]) for r in quality.board_quality(items, ["b"], "loop").collect()}
    assert got == {1: (2, ["MISSING_TITLES", "MISSING_DATES", "PAGINATION_LOOP"]), 2: (0, ["NO_LISTING_ROWS"])}
    pages = spark.createDataFrame([(1, "p", "제목", "제목", "짧다", True), (1, "q", "제목", "제목", "가" * 60 + " 다른 글", False), (1, "r", None, None, None, None)], "b int, page string, hint string, title string, content string, fallback boolean")
    titles = spark.createDataFrame([(1, "제목"), (1, "다른 글"), (1, "--"), (2, "짧다")], "b int, title string")
    assert {r["page"]: r["findings"] for r in quality.detail_findings(pages, titles, ["b"], "page").collect()} == {"p": ["EMPTY_CONTENT", "BODY_FALLBACK"], "q": ["NEIGHBOUR_LEAK"], "r": ["EMPTY_CONTENT"]}
    boards = spark.createDataFrame([(1, [], 5), (1, ["X"], 4), (2, [], 3)], "s int, findings array<string>, checked_at int")
    assert {r["s"]: (r["state"], r["boards"], r["checked_at"]) for r in quality.rollup(boards, spark.range(1, 4).select(F.col("id").cast("int").alias("s")), "s").collect()} == {1: ("warning", 2, 5), 2: ("ok", 1, 3), 3: ("unknown", 0, None)}


def test_stream_maintains_versions(spark: SparkSession, tmp_path: Path) -> None:
    docs = VersionedTable(spark, str(tmp_path / "docs"))
    assert docs.version() == -1
    docs.write(spark.createDataFrame([(1, 1, "a", "web", 2, None), (2, 1, "b", "web", 2, None)], DOC), 0)
    seen = tmp_path / "seen"
    schema = "school_id long, source_url string, observed_at timestamp"
    spark.createDataFrame([(1, "a")], "school_id long, source_url string").withColumn("observed_at", F.lit("2026-01-01").cast("timestamp")).write.parquet(str(seen))
    for _ in range(2):  # a second run finds nothing new and changes nothing
        maintain(spark.readStream.schema(schema).parquet(str(seen)), docs, str(tmp_path / "check")).awaitTermination()
        assert docs.version() == 1
        assert {r["doc_id"]: (r["miss_count"], r["expired_at"] is not None) for r in docs.read().collect()} == {1: (0, False), 2: (3, True)}


def test_materialized_tables_are_dropped(spark: SparkSession) -> None:
    import os

    from noticeforge.sources.tables import drop_materialized, materialized

    df = materialized(spark.range(3).toDF("id"))
    path = os.path.dirname(os.path.dirname(df.inputFiles()[0].removeprefix("file://")))
    assert df.count() == 3 and os.path.isdir(path)
    drop_materialized(spark)
    assert not os.path.isdir(path)


def test_running_sums_of_hot_groups(spark: SparkSession) -> None:
    from noticeforge.plans.windows import ranked, running_sum

    rows = [(None if i % 9 == 0 else 1 if i % 3 else 2, i, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(7)
    got = {(r["g"], r["o"]): (r["s"], r["n"]) for r in ranked(running_sum(df, ["g"], ["o"], F.col("v"), "s"), ["g"], [F.desc("o")], "n").collect()}
    for g in (None, 1, 2):
        mine = [r for r in rows if r[0] == g]
        for i, r in enumerate(mine):
            assert got[g, r[1]] == (sum(x[2] for x in mine[: i + 1]), len(mine) - i)
    assert ranked(df.limit(0), ["g"], ["o"], "n").count() == 0
    costs = spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 1, 5.0), (1, 3, 1, 5.0), (1, 4, 9, 1.0)], "g int, o int, c int, t double")
    assert sorted(r["o"] for r in crawl.within_budget(costs, "g", ["o"], "c", 3, "t", 9.0).collect()) == [1, 2]


def test_stream_detects_changes(spark: SparkSession, tmp_path: Path) -> None:
    known = VersionedTable(spark, str(tmp_path / "known"))
    schema = "school_id long, url string, content_hash string"
    known.write(spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], schema), 0)
    spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", "z"), (1, "d", None)], schema).write.parquet(str(tmp_path / "pages"))
    detect(spark.readStream.schema(schema).parquet(str(tmp_path / "pages")), known, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r["url"]: r["crawl_status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert known.version() == 1 and known.read().count() == 4


def test_settings(tmp_path: Path) -> None:
    from noticeforge.sources.settings import load_env

    (tmp_path / "env").write_text("# x\nA=1\nexport B='two words'\nC = 3\nno line\n", "utf-8")
    env = {"C": "kept"}
    assert load_env(str(tmp_path / "env"), env) == {"A": "1", "B": "two words"} and env == {"A": "1", "B": "two words", "C": "kept"} and load_env(str(tmp_path / "none"), {}) == {}
