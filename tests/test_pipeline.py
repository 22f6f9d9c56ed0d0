from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noticeforge.functions import models
from noticeforge.operators import extraction, ingest, rag, scheduler, specs, store, vector

ENTITIES, RELATIONS = f"array<{extraction.ENTITY}>", f"array<{extraction.RELATION}>"


def test_extraction_rules(spark: SparkSession) -> None:
    rows = [([("부서·기관", " 팀 ", {}), ("공지", "글", {"a": "b"}), ("x", "y", None), ("공지", " ", None), (None, "z", None)], [("팀", "게시", "글"), ("글", "게시", "팀"), ("팀", "모름", "글"), ("팀", "게시", "없음"), (None, "게시", "글")]), (None, None)]
    df = spark.createDataFrame(rows, f"e {ENTITIES}, r {RELATIONS}").select(extraction.validated(F.col("e"), F.col("r")).alias("v"))
    got = [r[0] for r in df.collect()]
    assert [(e["type"], e["name"]) for e in got[0]["entities"]] == [("부서·기관", "팀"), ("공지", "글")] and [tuple(r) for r in got[0]["relations"]] == [("글", "게시", "팀")] * 2
    assert got[0]["discarded"] == 6 and got[1]["discarded"] == 0 and got[1]["entities"] == []
    meta = spark.createDataFrame([([], [], "분", "제목"), ([("공지", "a", None)], [("a", "분류", "분")], " 분 ", "제목"), ([("공지", "a", None)], [], " ", "제목"), ([], [], None, None), ([], [], "분", None)], f"e {ENTITIES}, r {RELATIONS}, c string, t string")
    made = [([(e["type"], e["name"]) for e in r[0]["entities"]], [tuple(x) for x in r[0]["relations"]]) for r in meta.select(extraction.with_category(F.col("e"), F.col("r"), F.col("c"), F.col("t"))).collect()]
    kind = "주제·카테고리"
    assert made == [([("공지", "제목"), (kind, "분")], [("제목", "분류", "분")]), ([("공지", "a"), (kind, "분")], [("a", "분류", "분")]), ([("공지", "a")], []), ([], []), ([(kind, "분")], [])]


def test_pages_to_chunks(spark: SparkSession) -> None:
    pages = [(1, "u1", "제목", "분", "<article><p>가 팀</p></article>", "new"), (2, "u2", None, None, "<h1>h</h1><main><p>" + "나 " * 1500 + "</p></main>", "changed"), (3, "u3", "t", None, "<main></main>", "new"), (4, "u4", "t", None, "x", "unchanged"), (5, "u5", "t", None, "<p>나쁨</p>", "new"), (6, None, None, None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, source_url string, title_hint string, category_hint string, raw_html string, crawl_status string")

    def extract(text: str) -> object:
        if text.startswith("나 ") and len(text) < 1900:
            raise OSError("no answer")
        return "no json" if text == "나쁨" else {"entities": [{"type": "부서·기관", "name": "팀"}], "relations": []}

    chunks, failures = extraction.extract_pages(df, models.extractor(lambda: extract, sleep=lambda _: None))
    got = {(r["page_id"], r["chunk_index"]): r for r in chunks.collect()}
    assert set(got) == {(1, 0), (2, 0)} and got[1, 0]["extraction_status"] == "complete" and got[2, 0]["extraction_status"] == "partial"
    assert [tuple(x) for x in got[1, 0]["relations"]] == [("제목", "분류", "분")] and got[2, 0]["title"] == "h"
    assert {(r["page_id"], r["error_code"], r["retryable"]) for r in failures.collect()} == {(3, "EMPTY_CONTENT", False), (4, "UNSUPPORTED_CRAWL_STATUS", False), (5, "LLM_EXTRACTION_FAILED", False), (6, "UNSUPPORTED_CRAWL_STATUS", False)}


def test_build_graph(spark: SparkSession) -> None:
    chunk = "school_id long, target_school_id long, source_url string, title string, content string, chunk_index int, content_hash string, crawled_at timestamp, embedding array<float>, extraction_status string"
    t = dt.datetime(2026, 1, 1)
    a, b = ("부서·기관", "팀", {"x": "1"}), ("공지", "글", {})
    rows = [
        (1, 1, "u", "t", "c", 0, "h", t, [1.0], "complete", [a, b, ("", "없음", None)], [("글", "게시", "팀"), ("글", "게시", "모름")]), (1, 1, "u2", "t", "c", 0, "h2", t, [1.0], "complete", [("부서·기관", "팀!", {"x": "2", "y": "3"}), b], [("글", "게시", "팀!")]),
        (1, 2, "u3", "t", "c", 0, "h3", t, [1.0], "complete", [], []), (1, 1, "u4", "t", "c", 0, "h4", t, None, "complete", [], []), (1, 1, "u5", "t", "c", 0, "h5", t, [1.0], "partial", [], []),
    ]
    df = spark.createDataFrame(rows, f"{chunk}, entities {ENTITIES}, relations {RELATIONS}")
    empty = {n: spark.createDataFrame([], store.SCHEMAS[n]) for n in ("documents", "entities", "edges")}
    built = ingest.build_graph(df, **empty)
    state = {r["source_url"]: (r["status"], r["error_code"], r["retryable"], r["skipped"]) for r in built.results.collect()}
    assert state == {"u": ("partial", None, False, 2), "u2": ("complete", None, False, 0), "u3": ("failed", "SCHOOL_ID_MISMATCH", False, 0), "u4": ("failed", "EMBEDDING_FAILED", True, 0), "u5": ("partial", None, False, 0)}
    found = {r["norm_key"]: (r["name"], r["attributes"], r["source_doc_ids"]) for r in built.entities.collect()}
    docs = {r["source_url"]: r["doc_id"] for r in built.documents.collect()}
    assert found["부서기관:팀"] == ("팀", {"x": "2", "y": "3"}, sorted([docs["u"], docs["u2"]])) and len(built.edges.collect()) == 1
    # Building the same chunks again changes nothing.
    again = ingest.build_graph(df, built.documents, built.entities, built.edges)
    for x, y in ((built.documents, again.documents), (built.entities, again.entities), (built.edges, again.edges)):
        assert sorted(map(str, x.drop("crawled_at").collect())) == sorted(map(str, y.drop("crawled_at").collect()))


def test_retrieval(spark: SparkSession) -> None:
    q = [(1, 1, "질문", [1.0, 0.0], [("부서·기관", "팀!", {})]), (2, 1, "질문", [0.0, 1.0], []), (3, 2, "질문", [1.0, 0.0], []), (4, 1, "질문", None, [])]
    questions = spark.createDataFrame(q, f"question_id long, school_id long, question string, q_vec array<float>, found {ENTITIES}")
    docs = [(1, 1, "web", "u1", "t1", None, "c1", [1.0, 0.0], None), (2, 1, "web", "u1", "t2", None, "c2", [0.9, 0.1], None), (3, 1, "web", "u3", None, None, "c3", [1.0, 0.0], dt.datetime(2026, 1, 1)), (4, 1, "attachment", "attachment://7", "f.pdf", 3, "c4", [0.1, 1.0], None),
            (5, 1, "attachment", "attachment://7", "f.pdf", 1, "c5", [0.0, 1.0], None), (6, 2, "web", "u6", "t", None, "c", [0.0, 1.0], None)]
    d = spark.createDataFrame(docs, "doc_id long, school_id long, source_type string, source_url string, title string, page int, content string, embedding array<float>, expired_at timestamp")
    e = spark.createDataFrame([(10, 1, "부서·기관", "팀", "부서기관:팀"), (2, 1, "공지", "글", "공지:글")], "entity_id long, school_id long, type string, name string, norm_key string")
    edges = spark.createDataFrame([(1, 2, 10, "게시", [3, 1])], "edge_id long, src long, tgt long, relation string, doc_ids array<long>")
    out = rag.retrieve(questions, d, e, edges)
    got = {r["question_id"]: r for r in out.collect()}
    assert got[1]["source_type"] == "graph" and got[1]["entity_ids"] == ["e_10", "e_2"]
    assert got[1]["context"] == "[근거 1] t1\n출처: u1\nc1\n\n[근거 2] t2\n출처: u1\nc2\n\n[관계]\n- 글 —게시→ 팀 (출처: u3)"
    assert [tuple(s) for s in got[1]["sources"]] == [("t1", "u1"), (None, "u3")]
    assert got[2]["source_type"] == "document" and [tuple(s) for s in got[2]["sources"]] == [("f.pdf - 1, 3페이지", "attachment://7")] and got[2]["context"].startswith("[근거 1] f.pdf - 1페이지\nc5")
    assert got[3]["source_type"] is got[4]["source_type"] is None and got[3]["context"] == "" and got[3]["sources"] == []
    answered = {r["question_id"]: r["answer"] for r in rag.answers(out, questions, models.generator(models.provider("generate")), "모름").collect()}
    assert answered[3] == "모름" and answered[1].startswith("[핵심 답변]\n출처: u1")


def test_vectors(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    vec = rng.standard_normal((400, 16)) + np.repeat(rng.standard_normal((20, 16)) * 2, 20, axis=0)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)] + [(900, None), (901, [1.0]), (902, [0.0] * 16)], "item_id long, i_vec array<float>")
    asked = items.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("i_vec").alias("q_vec"))
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in vector.top_k(asked, items, 5, block=64).collect()}
    unit = vec.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(0, 400, 20):
        want = sorted(range(400), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:5]
        assert [got[i, r] for r in range(1, 6)] == want
    near = {(r["query_id"], r["item_id"]) for r in vector.approximate_top_k(asked, items, 5).collect()}
    exact = {(q, i) for (q, _), i in got.items() if q < 400}
    assert len(near & exact) / len(exact) >= 0.9
    assert vector.top_k(asked, items, 0).count() == vector.top_k(asked, items.limit(0), 5).count() == 0


def test_scheduler(spark: SparkSession) -> None:
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    schools = spark.createDataFrame([(1, "daily", "idle", None), (2, "none", "idle", None), (3, "1h", "crawling", None), (4, "2h", None, None)], "school_id long, crawl_schedule string, status string, crawl_started_at timestamp")
    jobs = spark.createDataFrame([(1, "daily", dt.datetime(2026, 1, 3), 5, 0), (2, "daily", dt.datetime(2026, 1, 1), 1, 0), (4, "9h", dt.datetime(2027, 1, 1), 2, 3)], "school_id long, schedule string, next_run timestamp, run_count int, error_count int")
    synced = scheduler.sync_jobs(jobs, schools, now)
    assert {r["school_id"]: (r["run_count"], r["error_count"]) for r in synced.collect()} == {1: (5, 0), 3: (0, 0), 4: (2, 3)}
    assert {tuple(r) for r in scheduler.due_jobs(synced, schools, now).collect()} == {(3, "skip"), (4, "start")}
    begun = scheduler.start(schools, schools.select("school_id"), now)
    assert {r["school_id"]: (r["status"], r["crawl_started_at"] is not None) for r in begun.collect()} == {1: ("crawling", True), 2: ("crawling", True), 3: ("crawling", False), 4: ("crawling", True)}
    results = spark.createDataFrame([(3, True), (4, True), (4, False)], "school_id long, ok boolean")
    after = {r["school_id"]: (r["next_run"], r["run_count"], r["error_count"]) for r in scheduler.finish(synced, results, now).collect()}
    assert after == {1: (dt.datetime(2026, 1, 3), 5, 0), 3: (dt.datetime(2026, 1, 2, 1), 1, 0), 4: (dt.datetime(2026, 1, 2, 0, 8), 3, 4)}


def test_models(spark: SparkSession) -> None:
    df = spark.createDataFrame([("장학금 신청: A장학금",), (None,), ("",)], "t string")
    vectors = [r[0] for r in df.select(models.embedder()("t")).collect()]
    assert abs(np.linalg.norm(vectors[0]) - 1) < 1e-5 and vectors[1] is None and not any(vectors[2])
    rules = models.pattern_rules({"장학금": r"(\w+장학금)", "신청": "(신청)"})
    found = [r[0] for r in df.select(models.extractor(lambda: rules)("t")).collect()]
    assert [(x["type"], x["name"]) for x in found[0]["entities"]] == [("장학금", "A장학금"), ("신청", "신청")] and [tuple(x) for x in found[0]["relations"]] == [("A장학금", "관련", "신청")]
    assert found[1] is None and found[2]["entities"] == []


def test_retries_and_drafts() -> None:
    waits: list[float] = []

    def broken(_: str) -> str:
        raise OSError("a\nb")

    told = models.extract_with_retry(broken, "x", 2, waits.append)
    assert waits == [1.0, 2.0] and told["error_code"] == "LLM_CALL_FAILED" and told["retryable"] and told["detail"] == "OSError: a b"
    assert models.extract_with_retry(lambda _: '{"entities": 3}', "x", 2, waits.append)["error_code"] == "LLM_INVALID_RESPONSE" and len(waits) == 2
    good = '{"listing": {"row": "tr", "detail_link": "a"}}'
    answers = iter(["{", good, good])
    prompts: list[list[str]] = []
    spec, found = specs.draft(lambda f: prompts.append(f) or "", lambda _: next(answers), lambda _: ["MISSING_TITLES"] if len(prompts) < 3 else [], sleep=waits.append)
    assert spec and not found and prompts == [[], ["INVALID_SPEC"], ["MISSING_TITLES"]]
    assert specs.draft(lambda _: "", broken, lambda _: [], retries=2, sleep=waits.append)[0] is None and waits[2:] == [20.0, 40.0]
    try:
        models.provider("extract", "nobody")
        raise AssertionError
    except ValueError:
        pass


def test_store_tables(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    store.create_tables(spark, str(tmp_path))
    spark.createDataFrame([(1, 2, "u")], "doc_id long, school_id long, source_url string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    store.create_tables(spark, str(tmp_path))
    row = store.read_table(spark, str(tmp_path), "documents").first()
    assert (row["doc_id"], row["miss_count"], row["source_type"], row["embedding"]) == (1, 0, "web", None)
    assert store.read_table(spark, str(tmp_path), "edges").count() == 0


def test_crawl_from_pages_to_graph(spark: SparkSession) -> None:
    from noticeforge.operators import pipeline

    t = dt.datetime(2026, 1, 1)
    pages = [(1, 1, "u1", "글 하나", "분", "<main><p>가 팀</p></main>", "h1", t), (2, 1, "u2", "글", None, "<main></main>", "h2", t), (3, 2, "u3", "글", None, "<main><p>나 팀</p></main>", "h3", t), (4, 3, "u4", None, None, "<main></main>", "h4", t)]
    df = spark.createDataFrame(pages, "page_id long, school_id long, source_url string, title_hint string, category_hint string, raw_html string, content_hash string, fetched_at timestamp")
    tables = [spark.createDataFrame([], store.SCHEMAS[n]) for n in ("documents", "entities", "edges")]
    model = models.extractor(lambda: models.pattern_rules({"부서·기관": r"(\w 팀)"}))
    broken = lambda _: spark.sql("select raise_error('x') as x")
    out = pipeline.run(df, *tables, model, models.embedder(), check=broken, now=F.lit(t).cast("timestamp"))
    assert {r["school_id"]: r["status"] for r in out.status.collect()} == {1: "partial_failed", 2: "ready", 3: "failed"} and out.quality is None
    assert {(r["page_id"], r["error_code"]) for r in out.failures.collect()} == {(2, "EMPTY_CONTENT"), (4, "EMPTY_CONTENT")}
    assert {r["name"] for r in out.entities.collect()} == {"가 팀", "나 팀", "글 하나", "분"} and out.edges.count() == 1
    # Nothing changed: nothing is read again, and the missed page's documents count a miss.
    again = pipeline.run(df.filter("page_id = 1"), out.documents, out.entities, out.edges, model, models.embedder(), check=lambda p: p.groupBy("school_id").count(), misses=1)
    assert {r["school_id"]: r["status"] for r in again.status.collect()} == {1: "ready"} and again.quality.count() == 1
    assert again.entities.count() == out.entities.count() and again.documents.count() == 2
