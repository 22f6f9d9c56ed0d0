from __future__ import annotations

import base64
import os
import random

import pytest
from pyspark.sql import SparkSession

from noticeforge.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="needs the public vocabularies")
TEXTS = ["", None, "a" * 20_000, "한" * 3000, "aaa aaaa  aaaaa\n\n x", "<|endoftext|>x", " \t\r\n", "é﻿\u0000😊👩‍👩‍👧", "The 2026년 “x”, it's we'll I'D"]


def reference():  # noqa: ANN201
    import tiktoken

    path = os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_encoder(spark: SparkSession) -> None:
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("aab  가나é😊\n19’'") for _ in range(rnd.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, words string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_tokens(df).collect()}
    ref = reference()
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n"] for r in tokens.encode_tokens(df, out="n", count_only=True).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokens.encode_tokens(df.limit(0)).count() == 0


def test_blocks_and_forgetting_change_nothing(monkeypatch: pytest.MonkeyPatch) -> None:
    import pyarrow as pa

    coder = tokens.PairIndexEncoder(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 2)
    ids = [i for part in tokens._blocks(pa.array(TEXTS)) for i in coder.encode(part.to_pylist())[0].tolist()]
    ref = reference()
    assert ids == [i for t in TEXTS for i in ref.encode_ordinary(t or "")]


def docs(spark: SparkSession, *rows: tuple):  # noqa: ANN201
    return spark.createDataFrame(list(rows), "doc_id long, text string, lang string, source string, n_tokens int, part int, epoch int, rest int")


TARGETS = "source string, target_share double, max_repeat int"


def test_mixing_reaches_shares(spark: SparkSession) -> None:
    rows = [(i, f"text number {i} " * 5, "en", ["a-x", " A-X ", "b-x", "c-y"][i % 4], 1, 1, 1, 1) for i in range(400)]
    rows += [(1000 + i, None if i % 2 else "", None, None, None, None, None, None) for i in range(6)] + [(2000, rows[0][1], "en", "c-y", 1, 1, 1, 1), rows[3]]
    targets = spark.createDataFrame([("a-x", 0.25, 2), ("b-x", 0.25, 1), ("c-y", 0.5, 3), ("gone-y", 0.2, 1), (None, 0.1, 1)], TARGETS)
    uses, shares = mixing.mix_sources(docs(spark, *rows), targets, "exact", distinct_texts=True)
    got = {r["source"]: r for r in shares.collect()}
    assert got["gone-y"]["mixed_tokens"] == 0 and set(got) == {"a-x", "b-x", "c-y", "gone-y"}
    # The empty source's share went to its sibling of the domain.
    assert abs(got["c-y"]["actual_share"] - 0.7 / 1.2) < 0.02 and abs(got["a-x"]["actual_share"] - 0.25 / 1.2) < 0.02
    times: dict[str, int] = {}
    text = {r[0]: r[1] for r in rows}
    used = uses.collect()
    for r in used:
        times[text[r["doc_id"]]] = times.get(text[r["doc_id"]], 0) + 1
    limit = {"a-x": 2, "b-x": 1, "c-y": 3}
    assert max(times.values()) <= 3 and len({(r["doc_id"], r["epoch"]) for r in used}) == len(used)
    assert all(times[text[r["doc_id"]]] <= limit[r["source"]] for r in used)
    assert {s: sum(r["n_tokens"] for r in used if r["source"] == s) for s in limit} == {s: got[s]["mixed_tokens"] for s in limit}


def test_default_total_redistributes_and_keeps_copies(spark: SparkSession) -> None:
    rows = [(i, f"text number {i % 90} " * 5, "en", ["a-x", "b-x", "c-y"][0 if i < 10 else 1 + i % 2], 1, 1, 1, 1) for i in range(200)]
    targets = spark.createDataFrame([("a-x", 0.4, 2), ("b-x", 0.1, 9), ("c-y", 0.5, 9)], TARGETS)
    uses, shares = mixing.mix_sources(docs(spark, *rows, rows[5]), targets)
    got = {r["source"]: r for r in shares.collect()}
    total = sum(r["source_tokens"] for r in got.values())
    assert sum(r["n_texts"] for r in got.values()) == 200 and got["a-x"]["n_copies"] == 0 and got["b-x"]["n_copies"] == 50
    # a-x gives all it may, b-x takes over what it lacks, and c-y keeps its own share.
    assert got["a-x"]["mixed_tokens"] == 2 * got["a-x"]["source_tokens"] and abs(got["c-y"]["mixed_tokens"] - total / 2) < 40
    assert abs(sum(r["mixed_tokens"] for r in got.values()) - total) < 80
    assert uses.groupBy("doc_id").count().filter("count > 9").count() == 0


def test_shortage_goes_to_siblings_first() -> None:
    leaf = lambda s, d, lang, share, tokens: mixing.Leaf(s, d, lang, share, tokens, 1)
    plan = {x.source: x.budget for x in mixing.plan_budgets([leaf("a", "x", "ko", 0.4, 10), leaf("b", "x", "ko", 0.1, 1000), leaf("c", "x", "en", 0.1, 1000), leaf("d", "y", "ko", 0.4, 1000)], 100)}
    assert plan == pytest.approx({"a": 10, "b": 40, "c": 10, "d": 40})
    assert sum(x.budget for x in mixing.plan_budgets([leaf("a", "x", "ko", 1.0, 10)], 1000)) == 10
    assert mixing.exact_total([]) == 0 and mixing.exact_total([leaf("a", "x", "k", 0.5, 10), leaf("b", "y", "k", 0.5, 100)]) == pytest.approx(20)


def test_mixing_empty(spark: SparkSession) -> None:
    targets = spark.createDataFrame([("a-x", None, None)], TARGETS)
    uses, shares = mixing.mix_sources(docs(spark), targets)
    assert uses.count() == 0 and shares.first()["actual_share"] == 0
    assert mixing.mix_sources(docs(spark, (1, "t", "en", "a-x", 1, 1, 1, 1)), targets.limit(0))[0].count() == 0
