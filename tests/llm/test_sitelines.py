from __future__ import annotations

import random
from itertools import pairwise

from pyspark.sql import SparkSession

from noticeforge.llm import sitelines as s

DOCS = "doc_id long, school_id long, content string, k long, site string, cluster long"
SCHOOLS = "school_id long, base_url string, k long"


def brute(docs: list[tuple], schools: dict[int, str | None]) -> set[tuple]:
    by: dict[str, list[tuple]] = {}
    for d, school, content, *_ in set(docs):
        if schools.get(school):
            by.setdefault(schools[school], []).append((d, content))
    out = set()
    for group in by.values():
        seen: dict[str, set] = {}
        for d, content in group:
            for key in s.line_keys(content or ""):
                if sum(c.isalpha() for c in key) >= 2:
                    seen.setdefault(key, set()).add(d)
        over = {k for k, v in seen.items() if len(v) >= 5 and len(v) >= 0.2 * len(group)}
        out |= {(d, i + 1) for d, content in group for i, key in enumerate(s.line_keys(content or "")) if key in over}
    return out


def test_found_equals_brute_force(spark: SparkSession) -> None:
    rnd = random.Random(5)
    lines = ["", "- 학보 제{n}호 -", "ALL RIGHTS {n}", "All  rights　{n}", "a", "1 2", "목록 보기", "Share this notice with {w} friends of the school today", "고유한 줄 {w} {w}", "​목록\xa0보기"]
    word = lambda: "".join(rnd.choice("가나다라마") for _ in range(5))
    docs = [(i, rnd.choice([1, 1, 1, 2, 3, 4, None]), None if i % 17 == 0 else "\n".join(rnd.choice(lines).format(n=rnd.randrange(99), w=word()) for _ in range(rnd.randrange(6))), 1, "x", 1) for i in range(120)]
    docs += docs[:7]
    schools = [(1, "https://WWW.a.x:443/b", 1), (2, "http://a.x", 1), (3, None, 1), (4, "b.x", 1)]
    found = s.repeated_lines(spark.createDataFrame(docs, DOCS), spark.createDataFrame(schools, SCHOOLS)).collect()
    got = [(r["doc_id"], r["line_no"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute(docs, {1: "a.x", 2: "a.x"}) and got


def test_near_lines_are_one_cluster(spark: SparkSession) -> None:
    tail = "with all of your friends and family members so that nobody misses the dates of this term at our school"
    docs = [(i, 1, f"share notice {tail} {'x' * (i % 3)}\nown line {i} of text number {'abcdefgh'[i]}{i}", 1, "x", 1) for i in range(8)]
    df, schools = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "http://a.x", 1)], SCHOOLS)
    near = s.repeated_lines(df, schools, exact=False, min_share=0.9).collect()
    assert {(r["doc_id"], r["line_no"]) for r in near} == {(i, 1) for i in range(8)} and len({r["cluster"] for r in near}) == 1
    assert s.repeated_lines(df, schools, exact=True, min_share=0.9).count() == 0
    clean = {r["doc_id"]: r["clean_content"] for r in s.without_lines(df, schools).collect()}
    assert clean[0] == docs[0][2].split("\n")[1]


def test_every_similar_pair_is_found(spark: SparkSession) -> None:
    rnd = random.Random(7)
    lines, common = [], "all of these words stand in each line and fill its buckets".split()
    for _ in range(25):
        own = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(rnd.choice([8, 14, 30, 60]))]
        lines += [" ".join([*own, *common, *["x"] * j]) for j in range(4)] + [" ".join([*common, *own[:j], "y", *own[j:]]) for j in (0, 3)]
    sets = [set(s.shingles([x])[0].tolist()) for x in lines]
    want = {(j, i) for i in range(len(lines)) for j in range(len(lines)) if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    classes = spark.createDataFrame([("a.x", i, x) for i, x in enumerate(lines)] + [("b.x", 1000 + i, x) for i, x in enumerate(lines)], "site string, k long, sample string")
    got = {tuple(r) for r in s.near_pairs(classes).collect()}
    assert len(want) > 50 and got == want | {(j + 1000, i + 1000) for j, i in want}


def test_connected_finds_long_chains(spark: SparkSession) -> None:
    pairs = list(pairwise(range(100, 160))) + [(1, 2), (5, 5)]
    got = {r["k"]: r["cluster"] for r in s.connected(spark.createDataFrame(pairs, "k long, head long"), "k", "head").collect()}
    assert {got[i] for i in range(100, 160)} == {100} and got[2] == got[1] == 1 and got[5] == 5


def test_bands_meet_similar_lines() -> None:
    rnd = random.Random(2)
    import pyarrow as pa

    hits = 0
    for _ in range(200):
        words = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(40)]
        other = [*words[:-1], "zzz"]  # one of 36 shingles differs on either side
        a, b = (set(x) for x in s._bands.func(pa.array([" ".join(words), " ".join(other)])).to_pylist())
        hits += bool(a & b)
    assert hits >= 198


def test_empty(spark: SparkSession) -> None:
    empty, schools = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "http://a.x", 1)], SCHOOLS)
    assert s.repeated_lines(empty, schools).count() == 0
    docs = spark.createDataFrame([(None, None, None, 1, "x", 1), (1, 1, "x\n" * 50_000 + "긴" * 100_000, 1, "x", 1)], DOCS)
    assert s.repeated_lines(docs, schools).count() == 0 and s.repeated_lines(docs, schools.limit(0)).count() == 0
    assert s.without_lines(docs, schools).count() == 2
