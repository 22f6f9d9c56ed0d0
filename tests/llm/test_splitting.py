from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from noticeforge.llm.splitting import oversized, split_documents, split_text

LIMITS = "source_type string, size_unit string, max_size int, overlap_size int"
DOCS = "doc_id long, school_id long, source_url string, source_type string, attachment_id long, chunk_index int, content string, pieces int, p string, rest int"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 가.\n\n,é😊́。", max_size=300), st.integers(1, 40), st.integers(0, 45), st.booleans())
def test_pieces_are_whole_and_fit(text: str, limit: int, overlap: int, in_bytes: bool) -> None:
    size = lambda t: len(t.encode()) if in_bytes else len(t)
    pieces = split_text(text, limit, overlap, in_bytes)
    assert "".join(text[o:e] for _, o, e in pieces) == text
    assert (len(pieces) == 1) == (size(text) <= limit) or len(text) == 1
    overlap = min(overlap, limit - 1)
    for k, (s, o, e) in enumerate(pieces):
        assert s <= o < e or not text
        assert size(text[s:e]) <= limit or e - o == 1
        if k:
            assert size(text[s:o]) <= overlap and (in_bytes or o - s == min(overlap, o))


def test_natural_boundaries() -> None:
    text = "첫 문단의 첫 문장입니다. 둘째 문장입니다.\n\n둘째 문단입니다. 끝입니다."
    cuts = [text[o:e] for _, o, e in split_text(text, 30)]
    assert cuts == ["첫 문단의 첫 문장입니다. 둘째 문장입니다.\n\n", "둘째 문단입니다. 끝입니다."]
    assert [e - o for _, o, e in split_text("x" * 100_000, 1000, 100)][:2] == [900, 900]
    assert split_text(None, 5) == [(0, 0, 0)] == split_text("", 5)


def test_operator(spark: SparkSession) -> None:
    limits = spark.createDataFrame([("web", "chars", 10, 2), ("attachment", "bytes", 12, 3), ("odd", None, None, None), (None, "chars", 5, 1)], LIMITS)
    rows = [
        (1, 1, "http://a/x/", "web", None, 0, "가" * 10, 1, "", 0), (2, 1, "http://A/x", "web", None, 1, "aaaa bbbb cccc", 1, "", 0), (3, 1, "at", "attachment", 9, 0, "가" * 5, 1, "", 0),
        (4, 1, "at", "attachment", 9, 0, "가" * 4, 1, "", 0), (5, None, None, "odd", None, None, "x" * 99, 1, "", 0), (6, None, None, None, None, None, None, 1, "", 0), (7, 1, "w", "web", 8, 0, "y" * 30, 1, "", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    files = spark.createDataFrame([(9,), (9,), (10,), (None,)], "attachment_id long")
    assert {tuple(r) for r in oversized(docs, files, limits).collect()} == {("notice_docs", 2), ("notice_docs", 3), ("notice_docs", 7), ("attachments", 9)}
    out = split_documents(docs, limits).collect()
    index = {(r["doc_id"], r["piece_no"]): r["chunk_index"] for r in out}
    assert index[1, 0] == 0 and [index[2, k] for k in range(2)] == [1, 2] and sorted(v for (d, _), v in index.items() if d in (3, 4)) == [0, 1, 2]
    assert {r["doc_id"]: r["piece"] for r in out}[5] == "x" * 99 and {r["doc_id"]: r["piece"] for r in out}[6] is None
    assert oversized(docs.limit(0), files.limit(0), limits.limit(0)).count() == 0 and split_documents(docs.limit(0), limits).count() == 0
