from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from noticeforge.llm import sentences as s


def corpus() -> list[str]:
    rnd, out = random.Random(4), []
    for i in range(250):
        a, b = "가나다라마바사"[i % 7] * 2, "ABCDEFG"[i % 7] + "o" * (i % 5 + 2)
        blocks = [
            [f"{a} 안내", f"신청은 2026. {i % 12 + 1}. 3. 이후 3.{i}점부터 받습니다.", f"“{a}를 내 주세요.”라고 말했습니다.", "문의해 주세요."],
            [f"About {b}", f"Prof. {b} will speak in Rm. {i} about it.", f"Please bring the form (max. {i} pages) by 5 p.m. to us.", f"See www.{b.lower()}.example for more."],
            [f"关于{a}", "请将材料发送至教务处。", "收到“请重新提交材料。”的同学请联系我们。", "你还在发愁吗？"],
            [f"ประกาศ {b}", f"กรุณาส่งเอกสาร ที่ห้อง {i} ก่อนวันนี้", "หากมีข้อสงสัยให้ติดต่อสำนักทะเบียน ได้ทุกวัน", "นักศึกษาสมัคร ทุนได้"],
        ]
        for head, *units in blocks:
            if i >= 2:
                rnd.shuffle(units)
                units = units[: rnd.randrange(1, 4)]
            out.append(head + "\n\n" + ("" if head.startswith("关") else " ").join(units) + ("\n- No. 3\n- Room 4" if i % 2 else ""))
    return out


def units(text: str, model: s.Model) -> list[str]:
    return [text[a:b] for a, b in s.sentence_spans(text, model)]


def test_learned_boundaries(spark: SparkSession) -> None:
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k", 1.0) for i, t in enumerate(texts)] + [(9_000, None, "k", 1.0), (9_001, "", "k", 1.0), (9_002, " ﻿\n", "k", 1.0)], "doc_id long, text string, key string, n double")
    places = s.candidate_table(docs)
    model = s.train(places)
    assert units(texts[0], model)[1:] == ["신청은 2026. 1. 3. 이후 3.0점부터 받습니다.", "“가가를 내 주세요.”라고 말했습니다.", "문의해 주세요."]
    assert units(texts[1], model)[1:] == ["Prof. Aoo will speak in Rm. 0 about it.", "Please bring the form (max. 0 pages) by 5 p.m. to us.", "See www.aoo.example for more."]
    assert units(texts[2], model)[1:] == ["请将材料发送至教务处。", "收到“请重新提交材料。”的同学请联系我们。", "你还在发愁吗？"]
    assert units(texts[3], model)[1:] == ["กรุณาส่งเอกสาร ที่ห้อง 0 ก่อนวันนี้", "หากมีข้อสงสัยให้ติดต่อสำนักทะเบียน ได้ทุกวัน", "นักศึกษาสมัคร ทุนได้"]
    assert units(texts[4], model)[-2:] == ["- No. 3", "- Room 4"]
    rows = s.split_sentences(places, model).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts))) and len(rows) == len({tuple(r) for r in rows})
    none = s.candidate_table(docs.limit(0))
    assert not s.train(none).b.any() and s.split_sentences(none, model).count() == 0


def test_wrapped_lines_go_on() -> None:
    text = "Questions about the Renfeylin Exchange\nProgram go to cudra@nuren.example or\nto the office which is in the hall on\nthe left side of the old main building"
    assert units(text, s.Model.empty()) == [text]
    assert units("Title\nA short line\n1) item\n2) item", s.Model.empty()) == ["Title", "A short line", "1) item", "2) item"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB 1.!?。\n\r﻿“”(\")ก้가汉ا।-:", max_size=120))
def test_spans_cover_all_but_blanks(text: str) -> None:
    spans = s.sentence_spans(text, s.Model.empty())
    at = 0
    for a, b in spans:
        assert at <= a < b and not text[at:a].strip(" \n\r﻿") and text[a] not in " \n\r﻿" and text[b - 1] not in " \n\r﻿"
        at = b
    assert not text[at:].strip(" \n\r﻿")


def test_long_text() -> None:
    text = "가나다 라마바. " * 20_000
    assert len(s.sentence_spans(text, s.Model.empty())) >= 1 and s.sentence_spans("x" * 500_000, s.Model.empty()) == [(0, 500_000)]
