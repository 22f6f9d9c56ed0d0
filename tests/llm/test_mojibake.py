from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, SparkSession

from noticeforge.llm import mojibake as m

WORDS = ["신청서를", "제출하시기", "바랍니다", "학생지원팀", "안내문", "붙임", "최종", "공지", "장학금", "모집요강"]
CLEAN = [" ".join(WORDS), "Thông báo học bổng", "Résumé à côté Übersicht São Ísland", "请将材料发送至教务处", "書類を再提出してください", "ÁREA DE ADMISSÃO – 3ª", "Þórs háskóli, Ísafold", "ƒ(x)=αx²+β ★☆★", "Приём заявок Εγγραφές", "กรุณาส่งเอกสาร", "본\xa0안내는 ± ½ °C «É»"]


def texts(spark: SparkSession, *items: str | None) -> DataFrame:
    rows = [("clean", i, t, "r") for i, t in enumerate(CLEAN)] + [("x", i, t, "r") for i, t in enumerate(items)]
    return spark.createDataFrame(rows, "src string, rec_id long, text string, run string")


def test_found_under_every_chain(spark: SparkSession) -> None:
    good = "신청서를 제출하시기 바랍니다"
    bad = [m.garble([good], chain)[0] for chain in m.CHAINS]
    bad = [b for b in bad if "?" not in b and b != good]
    assert len(bad) > 12
    df = texts(spark, *bad, *[f"<p>{b}</p> plain text" for b in bad])
    got = {tuple(r) for r in m.garbled_records(df.unionByName(df)).collect()}
    assert got == {("x", i) for i in range(2 * len(bad))}


def test_originals_come_back(spark: SparkSession) -> None:
    bad = "ì‹\xa0ì²\xadì„œë¥¼ RÃ©sumÃ© ��"
    got = {r["run"]: r["original"] for r in m.repaired_runs(texts(spark, bad)).collect()}
    assert got == {"ì‹\xa0ì²\xadì„œë¥¼": "신청서를", "Ã©": "é", "��": None}


def test_hangul_read_as_chinese(spark: SparkSession) -> None:
    bad = ["신청서를".encode("cp949").decode("gbk"), "공지".encode("cp949").decode("gbk"), "바랍니다".encode("cp949").decode("big5"), "붙임·최종".encode("cp949").decode("gbk")]
    assert all(m.clean_words(b) for b in bad)
    df = texts(spark, *bad, *["공지 붙임 최종"] * 2)
    assert {tuple(r) for r in m.garbled_records(df).collect()} == {("x", i) for i in range(4)}
    got = {r["run"]: r["original"] for r in m.repaired_runs(df).collect()}
    assert got == {bad[0]: "신청서를", bad[1]: "공지", bad[2]: "바랍니다", bad[3]: None}
    # A Chinese word that is far commoner than the Hangul it happens to be a form of is none.
    assert m.garbled_records(texts(spark, *[bad[0]] * 11, *[bad[1]] * 2)).count() == 0


def test_one_odd_word_makes_no_common_token_garbled(spark: SparkSession) -> None:
    odd = "★☆★".encode("cp932").decode("cp949")
    assert m.garbled_records(texts(spark, odd, *["★☆★ 공지"] * 30)).count() == 0
    # The garbled form of a Polish word is found, its original is not, although each is a form of the other.
    bad = "żółć".encode().decode("cp949")
    df = texts(spark, bad, *["żółć w"] * 15)
    assert {tuple(r) for r in m.repaired_runs(df).select("rec_id", "run", "original").collect()} == {(0, bad, "żółć")}


def test_single_syllables_signs_and_marked_words(spark: SparkSession) -> None:
    bad = ["3명".encode("cp949").decode("latin-1"), "※".encode().decode("cp1252"), "żółć".encode().decode("cp1252"), "수".encode().decode("latin-1")]
    df = texts(spark, *bad, *["3명 2월 할 수 ※ 붙임, żółć"] * 8)
    assert {r["run"]: r["original"] for r in m.repaired_runs(df).collect()} == {bad[0][1:]: "명", bad[1]: "※", bad[2]: "żółć", bad[3]: "수"}


def test_clean_and_odd_input(spark: SparkSession) -> None:
    assert m.garbled_records(texts(spark)).count() == 0
    assert m.garbled_records(texts(spark, "", "a" * 200_000, "가" * 100_000)).count() == 0
    none = spark.createDataFrame([(None, None, None, None)], "page_id long, raw_html string, filename string, content string")
    all_null = m.project_texts(none, none.withColumnRenamed("page_id", "attachment_id"), none.withColumnRenamed("page_id", "doc_id"))
    assert m.garbled_records(all_null).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="가나힣é汉あก9 x", min_size=1, max_size=6), min_size=1, max_size=8))
def test_garbling_in_one_go_equals_one_by_one(words: list[str]) -> None:
    for chain in m.CHAINS:
        assert m.garble(words, chain) == [m.garble([w], chain)[0] for w in words]
