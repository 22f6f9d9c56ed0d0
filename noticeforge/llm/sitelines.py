"""Lines repeated across one site's documents: masked lines clustered by locality-sensitive hashing within each site."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from noticeforge.functions.urls import website
from noticeforge.plans.joins import fan_out, small_side, spread
from noticeforge.sources.tables import materialized

#: Blanks that are no white space to Unicode: soft hyphen, joiners and marks without width, fillers.
_INVISIBLE = "­᠎​‌‍‎‏⁠﻿ㅤ⠀"
#: Digits and blanks of any kind, taken out of a line (the line feed between lines is kept).
_IGNORED = {c: None for c in range(sys.maxunicode + 1) if c != 10 and (unicodedata.category(chr(c))[0] in "NZ" or chr(c).isspace() or chr(c) in _INVISIBLE)}
_TWO_LETTERS = re.compile(r"[^\W\d_].*?[^\W\d_]", re.S)
#: What names of persons follow and what follows them, in scripts without capital letters.
_NAME_LABELS = "작성자|담당자|글쓴이|등록자|게시자|책임자|성명|이름|作者|发布人|发布者|联系人|负责人|投稿者|担当者|作成者|氏名"
_NAME_TITLES = "기자|교수|선생님|선생|팀장|조교|주무관|과장|실장|님|老师|教授|先生|さん|様"
#: The clustering mask, in this order: addresses, names of persons, words that begin with a capital letter, numbers and dates.
_MASKS = (
    (re.compile(r"(?:https?://|www\.)\S+|(?<![^\s@])[^\s@]++@\S+"), "@"),
    (re.compile(rf"(?<![가-힣])({_NAME_LABELS})(\s*[:：]\s*|\s+)[가-힣ぁ-んァ-ヶ一-鿿]{{2,5}}(?![가-힣ぁ-んァ-ヶ一-鿿])"), r"\1\2@"),
    (re.compile(rf"(?<![가-힣一-鿿])[가-힣一-鿿]{{2,4}}(?=\s?(?:{_NAME_TITLES})(?![가-힣ぁ-んァ-ヶ一-鿿]))"), "@"),
    (re.compile(r"\b[A-ZÀ-ÖØ-Þ][\w'’-]*"), "@"),
    (re.compile(r"\d+(?:[.,:/-]\d+)*"), "0"),
)
SHINGLE, SIMILARITY = 5, 0.8
#: Counters of shingles by which their minima are ordered, 4 MB whatever the input, and the classes (one of so many) they are
#: counted in. Any order finds every pair; one that puts frequent shingles last keeps buckets small.
SLOTS, COUNTED = 1 << 20, 16


def line_keys(content: str) -> list[str]:
    """The lines of content without digits, letter case and blanks: lines with one key are the same line."""
    return content.translate(_IGNORED).lower().split("\n")


_LINES = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("line", T.StringType())]))


@arrow_udf(_LINES)
def _lines_of(sites: pa.Array, contents: pa.Array) -> pa.Array:
    """The lines of each content that count: number, key within the site, and the line itself where its key is new in the document."""
    numbers, keys, texts, sizes = [], [], [], []
    for site, content in zip(sites.to_pylist(), contents.to_pylist(), strict=True):
        n, seen, raw = len(numbers), set(), content.split("\n") if content is not None else []
        seed = xxhash.xxh64_intdigest(site)
        for i, key in enumerate(line_keys(content) if raw else ()):
            if _TWO_LETTERS.search(key):
                k = xxhash.xxh64_intdigest(key, seed)
                numbers.append(i + 1)
                keys.append(k)
                texts.append(None if k in seen else raw[i])
                seen.add(k)
        sizes.append(len(numbers) - n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
    cols = [pa.array(numbers, pa.int32()), pa.array(np.array(keys, np.uint64).astype(np.int64)), pa.array(texts, pa.string())]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(cols, ["line_no", "k", "line"]))


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): of each line the hashes of its runs of SHINGLE masked words; a shorter line is one shingle."""
    text = "\n".join(x.replace("\n", " ").replace("\0", " ") for x in lines)
    for mask, sign in _MASKS:
        text = mask.sub(sign, text)
    words = np.array([*text.lower().replace("\n", " \0 ").split(), "\0"], object)
    codes, unique = pd.factorize(words)
    ends = np.flatnonzero(codes == codes[-1])
    flat = np.delete(pd.util.hash_array(unique, categorize=False)[codes], ends)
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    starts = np.cumsum(sizes) - sizes
    runs = np.maximum(sizes - SHINGLE + 1, 1)
    first = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(starts, runs)
    last = np.repeat(starts + sizes, runs)
    flat = np.append(flat, np.uint64(0))
    out = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        step = np.where(first + k < last, flat[np.minimum(first + k, len(flat) - 1)], np.uint64(0))
        out = (out ^ step) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    return out, runs


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


@arrow_udf(T.ArrayType(T.LongType()))
def _shingles(lines: pa.Array) -> pa.Array:
    return _lists(*shingles(lines.to_pylist()))


def _bands_by(counts: bytes | None):  # noqa: ANN202
    """Bands of lines: the hash of the whole set of shingles, and of four shingles or more its first ones in the order of counts.

    Sets of similarity SIMILARITY have so many shingles in common that those a set may lack, and one more, hold a common one:
    of n shingles the first n - ceil(SIMILARITY n) + 1. Sets of three or fewer are similar only to themselves.
    """
    shared = counts and SparkSession.active().sparkContext.broadcast(counts)

    @arrow_udf(T.ArrayType(T.LongType()))
    def bands(lines: pa.Array) -> pa.Array:
        if not len(lines):
            return _lists(np.zeros(0), np.zeros(0, np.int64))
        values, runs = shingles(lines.to_pylist())
        owner = np.repeat(np.arange(len(runs)), runs)
        often = np.frombuffer(shared.value, np.int32)[(values % np.uint64(SLOTS)).astype(np.int64)] if shared else np.zeros(len(values), np.int32)
        order = np.lexsort((values, often, owner))
        values, owner = values[order], owner[order]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
        values, owner = values[new], owner[new]
        n = np.bincount(owner, minlength=len(runs))
        starts = np.cumsum(n) - n
        mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts) + n.astype(np.uint64)
        first = np.where(n > 3, n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1, 0)
        kept = np.arange(len(values)) - np.repeat(starts, n) < np.repeat(first, n)
        at = np.cumsum(first) - first
        return _lists(np.insert(values[kept], at, whole), first + 1)

    return bands


#: In the order of the hashes alone.
_bands = _bands_by(None)


def _frequencies(classes: DataFrame) -> bytes:
    """How often shingles stand in one of COUNTED classes, by SLOTS: at most that many rows reach the driver."""
    some = classes.filter(F.pmod(F.xxhash64("k"), F.lit(COUNTED)) == 0).select(F.explode(_shingles("sample")).alias("h"))
    # The low bits are those of the unsigned hash.
    rows = some.groupBy(F.col("h").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts.tobytes()


def site_docs(docs: DataFrame, schools: DataFrame) -> DataFrame:
    """site, doc_id, content of each document once, of the schools that have a website."""
    sites = schools.select("school_id", website(F.col("base_url")).alias("site")).filter("site is not null").groupBy("school_id").agg(F.min("site").alias("site"))
    sites, _ = small_side(sites)
    # doc_id is unique by contract; that is checked on its column alone, and repeated rows are dropped only if there are any.
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.max(F.struct("school_id", "content")).alias("x")).select("doc_id", "x.*")
    return docs.select("doc_id", "school_id", "content").join(sites, "school_id").select("site", "doc_id", "content")


def excessive(counted: DataFrame, documents: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """The rows of counted (site, n_docs, ...) that stand in at least min_docs and min_share of their site's documents."""
    totals, _ = small_side(documents.groupBy("site").agg(F.count("doc_id").alias("site_docs")))
    # The tolerance makes a share of exactly min_share count.
    return counted.join(totals, "site").filter((F.col("n_docs") >= min_docs) & (F.col("n_docs") + 1e-9 >= min_share * F.col("site_docs"))).drop("site_docs")


def near_pairs(classes: DataFrame) -> DataFrame:
    """k, head: all pairs of line classes (site, k, sample) that are similar; equal sets of shingles with the smallest of them only.

    Each set is compared with every other one of the site that it meets in a band (_bands_by), which misses no similar pair.
    """
    banded = materialized(classes.select("k", F.xxhash64("site").alias("site"), _bands_by(_frequencies(classes))("sample").alias("bands")))
    # One exchange by set serves both the heads and their join; a row is two numbers and is streamed, however hot its set.
    whole = fan_out(banded.select("k", F.xxhash64("site", F.col("bands")[0]).alias("whole")), "whole")
    heads = whole.groupBy("whole").agg(F.min("k").alias("head"), F.max("k").alias("last")).filter("head <> last").drop("last")
    same = materialized(whole.join(heads.hint("shuffle_hash"), "whole").filter("k <> head").select("k", "head"))
    several = F.size("bands")
    heads = banded.filter(several > 1).join(same.select("k"), "k", "left_anti")
    met = fan_out(heads.select("k", several.alias("n"), F.explode(F.slice("bands", 2, several - 1)).alias("band"), "site").select("k", "n", F.xxhash64("site", "band").alias("bucket")), "bucket")
    # The number of bands tells that of the shingles within five; a set of less than SIMILARITY of the other's size is not similar.
    close = 5 * F.least("n", "n2") - 6 >= SIMILARITY * 5 * (F.greatest("n", "n2") - 2)
    other = met.select(F.col("k").alias("head"), F.col("n").alias("n2"), "bucket")
    # Several bands find the same pair; it is compared once.
    found = materialized(met.join(other, "bucket").filter((F.col("head") < F.col("k")) & close).select("k", "head").distinct())
    named, _ = small_side(found.select(F.explode(F.array("k", "head")).alias("k")).distinct())
    texts = materialized(classes.join(named, "k", "left_semi").select("k", _shingles("sample").alias("sh")))
    both = found.join(texts, "k").join(texts.select(F.col("k").alias("head"), F.col("sh").alias("sh2")), "head")
    alike = F.size(F.array_intersect("sh", "sh2")) / F.size(F.array_union("sh", "sh2")) >= SIMILARITY
    return both.filter(alike).select("k", "head").unionByName(same)


def connected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """k, cluster: the smallest k that each k of the pairs is connected with, by spreading labels until none moves."""
    edges = materialized(pairs.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e")).select("e.*").distinct())
    label = materialized(edges.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.col("k")).alias("cluster")))
    while True:
        near = edges.join(label.select(F.col("k").alias("v"), "cluster"), "v").groupBy(F.col("u").alias("k")).agg(F.min("cluster").alias("c"))
        # A label's own label is taken over too, which halves the way on long chains.
        far = label.select(F.col("k").alias("cluster"), F.col("cluster").alias("c2"))
        new = label.join(near, "k").join(far, "cluster", "left").select("k", F.least("cluster", "c", "c2").alias("new"), "cluster")
        new = materialized(new)
        label = new.select("k", F.col("new").alias("cluster"))
        if new.filter("new <> cluster").isEmpty():
            return label


def repeated_lines(docs: DataFrame, schools: DataFrame, exact: bool = True, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """site, doc_id, line_no, k, cluster: each occurrence of an excessively repeated line.

    Lines of a site with one key (line_keys) are one class, and a document counts once for it. The classes' masked words give
    5-word shingles and their minima; classes of Jaccard similarity SIMILARITY or more are clustered. A cluster is
    excessive if at least min_docs and min_share of the site's documents hold any of its lines, and its lines are found. With
    `exact` the line's own class must be excessive too. Lines with fewer than two letters never count; a line of fewer than
    five words joins only lines of the same masked words. Documents of schools without a website hold no line, nor does a
    null content, which still counts as a document. The classes to look for are at most lines per document / min_share a
    site; their number is checked before they are broadcast.
    """
    documents = site_docs(docs, schools)
    text = spread(documents, "doc_id")
    lines = materialized(text.select("site", "doc_id", F.explode(_lines_of("site", "content")).alias("x")).select("site", "doc_id", "x.*"))
    at = lines.select("site", "doc_id", "line_no", "k")
    first = lines.filter("line is not null").select("site", "k", "line")
    classes = materialized(first.groupBy("k").agg(F.min("site").alias("site"), F.count("*").alias("n_docs"), F.min("line").alias("sample")))
    label = connected(near_pairs(classes), "k", "head")
    classes = classes.select("site", "k", "n_docs").join(label, "k", "left").withColumn("cluster", F.coalesce("cluster", "k"))
    sums = classes.groupBy("site", "cluster").agg(F.count("*").alias("n"), F.sum("n_docs").alias("n_docs"))
    # A cluster's distinct documents are at most the sum of its classes': only sums that reach the bar are counted exactly.
    might = materialized(excessive(sums, documents, min_docs, min_share))
    members, _ = small_side(classes.join(might.filter("n > 1").select("cluster"), "cluster", "left_semi").select("k", "cluster"))
    counted = at.join(members, "k").groupBy("site", "cluster").agg(F.count_distinct("doc_id").alias("n_docs"))
    clusters = might.filter("n = 1").select("cluster").unionByName(excessive(counted, documents, min_docs, min_share).select("cluster"))
    hit = classes.join(clusters, "cluster", "left_semi")
    if exact:
        hit = excessive(hit, documents, min_docs, min_share)
    hit, _ = small_side(hit.select("k", "cluster"))
    return at.join(hit, "k").select("site", "doc_id", "line_no", "k", "cluster")


def without_lines(docs: DataFrame, schools: DataFrame, exact: bool = False) -> DataFrame:
    """docs with a column clean_content: content without its excessively repeated lines; null content stays null."""
    hits = repeated_lines(docs, schools, exact).groupBy("doc_id").agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.coalesce(F.array_contains("__drop", (i + 1).cast("int")), F.lit(False)))
    return docs.join(hits, "doc_id", "left").withColumn("clean_content", F.array_join(kept, "\n")).drop("__drop")
