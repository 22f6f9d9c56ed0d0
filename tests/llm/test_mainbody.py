from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from noticeforge.llm.htmlines import generalise, lines_of
from noticeforge.llm.mainbody import main_lines

PAGES = "page_id long, school_id long, source_url string, raw_html string, host string, lines int"
DOCS = "doc_id long, school_id long, source_url string, source_type string, content string, k int"


def page(i: int, body: str, side: str = "") -> str:
    return (
        f"<html><head><title>t{i}</title><script>if(1<2){{}}</script></head><body><div class='menu{i}'><ul><li><a href='/a'>입학 안내</a><li><a href='/b'>도서관</a></ul></div><div class='view'>"
        f"<div class='info'>조회 {i}</div>{body}<div class='css-{i * 7919 + 99991:x}'><a href='/n'>다른 공지 하나</a><br><a href='/m'>다른 공지 둘</a></div></div><div id='foot'>주소 서울<br>전화 02-{i}</div>{side}</body>"
    )


def body(i: int) -> str:
    rnd = random.Random(i)
    word = lambda n: "".join(rnd.choice("가나다라마바사아자차카타파하거너더러") for _ in range(n))
    return f"<h1>제목 {word(6)}</h1><p>본문 <b>첫</b>&amp; 줄 {word(60)}<p>둘째 {word(50)}<table><tr><td>칸</td><td>{word(9)}</td></tr></table>"


def test_pages(spark: SparkSession) -> None:
    rows = [(i, 1, f"http://www.a.x/{i}", page(i, body(i)), "h", 1) for i in range(60)]
    rows += [(100 + i, 1, "http://a.x/z", page(i, "<p>삭제된 글입니다.</p>"), "h", 1) for i in range(3)]
    rows += [(200, None, None, None, "h", 1), (201, 1, "http://a.x/q", "", "h", 1), (202, 1, None, "<p>cut off <div class='view", "h", 1), (None, 1, "u", "x", "h", 1), rows[0]]
    out = main_lines(spark.createDataFrame(rows, PAGES), spark.createDataFrame([], DOCS)).collect()
    got: dict[int, list[str]] = {}
    for r in out:
        got.setdefault(r["rec_id"], []).append(r["line_text"])
    assert all(len(v) == len(set(v)) for v in got.values())
    assert set(got) <= set(range(60)) | {202}
    for i in range(60):
        want = {x.text for x in lines_of(body(i))}
        assert set(got[i]) == want, (i, got[i])


def test_texts(spark: SparkSession) -> None:
    pages = [(i, 1, f"http://a.x/{i}", page(i, body(i)), "h", 1) for i in range(60)]
    docs = [(i, 1, "http://a.x/d", "web", f"입학 안내 | 도서관\n홈 > 소식 > 글\n제목 {'가나다라마바사아자차'[i % 10] * (i + 1)}\n\n 본문\t {'xyz'[i % 3] * (i + 2)} \n이전글 다른 글\n글쓰기 수정 삭제\n알림 {i}호 구독하세요", 1) for i in range(20)]
    docs += [(50, 1, None, "web", None, 1), (51, None, None, None, "x", 1), (52, 1, "http://a.x", "attachment", "x", 1), (53, 1, "", "web", "", 1)]
    out = main_lines(spark.createDataFrame(pages, PAGES), spark.createDataFrame(docs, DOCS)).filter("src = 'notice_docs'").collect()
    assert {(r["rec_id"], r["line_text"]) for r in out} == {(i, t) for i in range(20) for t in (f"제목 {'가나다라마바사아자차'[i % 10] * (i + 1)}", f"본문 {'xyz'[i % 3] * (i + 2)}")}


def test_a_few_misread_pages_are_no_frame(spark: SparkSession) -> None:
    often, rare = "많은 참여 바랍니다 여러분", "서류를 방문 제출하시기 바랍니다"
    pages = [(i, 1, f"http://a.x/{i}", page(i, body(i) + (f"<p>{often}</p>" if i % 2 else ""), f"<div id='etc'>{often}</div>" if i in range(0, 12, 2) else ""), "h", 1) for i in range(60)]
    # Pages of menus alone have no main body; what they show tells nothing.
    pages += [(100 + i, 1, f"http://a.x/m{i}", f"<div class='menu1'><ul><li><a href='/a'>입학 안내</a><li><a href='/c'>{rare}</a></ul></div>", "h", 1) for i in range(6)]
    docs = [(i, 1, "http://a.x/d", "web", f"입학 안내\n제목 {'가나다라마바사아자차'[i] * 5}" + (f"\n{often}\n{rare}" if i == 3 else ""), 1) for i in range(10)]
    out = main_lines(spark.createDataFrame(pages, PAGES), spark.createDataFrame(docs, DOCS)).filter("src = 'notice_docs'").collect()
    got = {(r["rec_id"], r["line_text"]) for r in out}
    assert {(3, often), (3, rare)} <= got and not any(t == "입학 안내" for _, t in got)


def test_small_hosts_count_their_own_votes(spark: SparkSession) -> None:
    # One page a host, each with a template of its own, whose main body stands in a path that no other host has.
    own = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, 1, f"http://{own(i)}.x/1", f"<div class='main-{own(i)}'><h1>제목 {own(i)}</h1><p>본문 {own(i) * 9}</div>", "h", 1) for i in range(20)]
    # Ten thousand lines of one host in paths of their own are commoner than each of these.
    many = "".join(f"<div class='x-{own(j)}'><p>가 {own(j)}<p>나 {own(j)}<p>다 {own(j)}</div>" for j in range(5_500))
    rows.append((100, 1, "http://big.x/1", many, "h", 1))
    out = main_lines(spark.createDataFrame(rows, PAGES), spark.createDataFrame([], DOCS)).filter("rec_id < 100").collect()
    assert {(r["rec_id"], r["line_text"]) for r in out} == {(i, t) for i in range(20) for t in (f"제목 {own(i)}", f"본문 {own(i) * 9}")}


def test_empty(spark: SparkSession) -> None:
    assert main_lines(spark.createDataFrame([], PAGES), spark.createDataFrame([], DOCS)).count() == 0


def test_lines() -> None:
    html = "<body><table width=9><tr><td colspan=2>a&nbsp;<i>b</i> c<br/>d<td>e</tr><tr><td>f<td> g </table><ul><li>h<li>i <ul><li>j</ul></ul><!-- x --><p>k\n l"
    assert [x.text for x in lines_of(html)] == ["a\xa0b c", "d e", "f g", "h", "i", "j", "k l"]
    assert generalise("css-3dc775") == "css-*" and generalise("menu12") == "menu#" and generalise("b-content-box") == "b-content-box" and generalise("cookie-bar") == "cookie-bar"
    assert lines_of(None) == lines_of("") == [] and len(lines_of("<div>" * 3000 + "x")) == 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/dipa br&;\"'=!-é\n", max_size=120))
def test_any_markup(page: str) -> None:
    for line in lines_of(page):
        assert line.text == line.text.strip(" \t\r\n") != ""
