"""Splitting oversized items at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.functions import arrow_udf

from noticeforge.functions.urls import normalize_url

#: Boundaries by strength, strongest first: a match ends a segment. Below the last one only single characters are left.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[^\S\n]*\n\s*",  # paragraphs
        r"\n+",  # lines
        r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？｡।॥؟۔]+[」』”’）)】\]]*)\s*",  # sentences
        r"[,;:،؛、，；：)\]）】」』](?=\s|[^\x00-\x7f])\s*",  # clauses
        r"\s+",  # words
        r"(?<=[^\W\d_])(?=[^\w\s])|(?<=[^\w\s])(?=\w)",  # between letters and marks
    )
)
#: Rows of one item per bucket of the running count that renumbers its pieces.
INDEX_BUCKET = 256

_JOINS = regex.compile(r"[\p{M}\u200c\u200d\U0001f3fb-\U0001f3ff]")


def _size(text: str, in_bytes: bool) -> int:
    return len(text.encode()) if in_bytes else len(text)


def _segments(text: str, start: int, cap: int, in_bytes: bool, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """(end, size, level of the boundary at end) of the coarsest segments of text that fit cap."""
    if level == len(BOUNDARIES):
        at = 0
        while at < len(text):
            end, size = at, 0
            while end < len(text):
                step = _size(text[end], in_bytes)
                if size + step > cap and end > at:
                    break
                size, end = size + step, end + 1
            # A mark stays with the character it belongs to, where the piece has another place to end.
            back = end
            while back > at + 1 and end < len(text) and _JOINS.match(text[back]):
                back -= 1
            if back != end and back > at + 1:
                size, end = size - _size(text[back:end], in_bytes), back
            yield start + end, size, level
            at = end
        return
    cuts = [m.end() for m in BOUNDARIES[level].finditer(text) if 0 < m.end() < len(text)] + [len(text)]
    at = 0
    for cut in cuts:
        size = _size(text[at:cut], in_bytes)
        if size <= cap:
            yield start + cut, size, level
        else:
            inner = list(_segments(text[at:cut], start + at, cap, in_bytes, level + 1))
            yield from inner[:-1]
            yield inner[-1][0], inner[-1][1], level
        at = cut


def split_text(text: str | None, limit: int, overlap: int = 0, in_bytes: bool = False) -> list[tuple[int, int, int]]:
    """(start, own, end) of the pieces of text in code points: the piece is text[start:end], text[start:own] its overlap.

    A text within the limit, an empty or a null one is one piece. Of a longer one no piece is larger than limit (only a single
    character that is larger itself), the own parts are the whole text in order, and each piece but the first begins with
    the last `overlap` units before its own part (fewer by a part of a character in bytes). The overlap is at most limit - 1.

    Segments are merged with a heap of adjacent pairs: weakest boundary first, then the smaller pair, then the earlier one,
    while their size plus the overlap fits. It starts from the coarsest segments that fit, since all weaker boundaries inside
    them would be merged before any stronger one.
    """
    text = text or ""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if len(text) <= limit and _size(text, in_bytes) <= limit:
        return [(0, 0, len(text))]
    cap = limit - overlap
    ends, sizes, levels = (list(x) for x in zip(*_segments(text, 0, cap, in_bytes), strict=True))
    n = len(ends)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(-levels[i], sizes[i] + sizes[i + 1], i) for i in range(n - 1) if sizes[i] + sizes[i + 1] <= cap]
    heapq.heapify(heap)
    while heap:
        _, size, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or sizes[i] + sizes[j] != size:
            continue
        ends[i], sizes[i], levels[i], after[i], alive[j] = ends[j], size, levels[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and sizes[a] + sizes[b] <= cap:
                heapq.heappush(heap, (-levels[a], sizes[a] + sizes[b], a))
    pieces, own = [], 0
    for i in range(n):
        if alive[i]:
            start = own
            if own and overlap:
                start = max(0, own - overlap)
                if in_bytes:
                    while _size(text[start:own], True) > overlap:
                        start += 1
            pieces.append((start, own, ends[i]))
            own = ends[i]
    return pieces


_PIECES = T.ArrayType(T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("start", "own", "end")], T.StructField("piece", T.StringType())]))


@arrow_udf(_PIECES)
def _split(texts: pa.Array, limits: pa.Array, overlaps: pa.Array, in_bytes: pa.Array) -> pa.Array:
    out = []
    for text, limit, overlap, b in zip(texts.to_pylist(), limits.to_pylist(), overlaps.to_pylist(), in_bytes.to_pylist(), strict=True):
        out.append([{"start": s, "own": o, "end": e, "piece": text[s:e]} for s, o, e in split_text(text, limit, overlap, b)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("own", pa.int32()), ("end", pa.int32()), ("piece", pa.string())]))
    return pa.array(out, kind)


def split_oversized(rows: DataFrame, limits: DataFrame, text: str = "content", kind: str = "source_type") -> DataFrame:
    """rows with a column `pieces`, array<struct<start,own,end,piece>> (see split_text), within the limits of their kind.

    limits   one row per kind: kind, size_unit (chars or bytes), max_size, overlap_size; of several rows the smallest max_size
             holds. Rows of another kind, and all rows if max_size is null, have no limit: one piece. A null text gives one
             piece with a null text. A row is oversized where size(pieces) > 1.

    Only rows above their limit, by a check in the JVM, go through Python. It is narrow: the limits are a fixed table.
    """
    unit = F.lower(F.trim("size_unit")) == "bytes"
    rule = limits.filter("max_size is not null").groupBy(F.col(kind).alias("__kind")).agg(
        F.min(F.struct("max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap"), unit.alias("in_bytes"))).alias("__limit")
    )
    joined = rows.join(F.broadcast(rule), rows[kind] == F.col("__kind"), "left").drop("__kind")
    size = F.when(F.col("__limit.in_bytes"), F.octet_length(text)).otherwise(F.length(text))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("own"), F.coalesce(F.length(text), F.lit(0)).alias("end"), F.col(text).alias("piece"))).cast(_PIECES)
    over = F.coalesce(size > F.col("__limit.max_size"), F.lit(False))
    # Two branches, so that Python sees none of the rows that fit.
    fits = joined.filter(~over).withColumn("pieces", whole).drop("__limit")
    cut = joined.filter(over)
    cut = cut.withColumn("pieces", _split(F.col(text), F.col("__limit.max_size").cast("int"), F.col("__limit.overlap").cast("int"), F.col("__limit.in_bytes"))).drop("__limit")
    return fits.unionByName(cut)


def split_documents(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per piece of the Document rows: doc_id, source_type, school_id, attachment_id, chunk_index, piece_no, start_at, own_at, end_at, piece.

    chunk_index is new and counts all pieces of one item from 0, in the order of the old chunk_index, then of doc_id. An item
    is a file (attachment_id) or a page (school_id, source_url in normal form). The running count is taken over
    sums by buckets of the old chunk_index first, so no task holds all rows of an item.
    """
    parts = split_oversized(docs.select("doc_id", "school_id", "source_url", "source_type", "attachment_id", "chunk_index", "content"), limits)
    item = ["item_file", "item_school", "item_url"]
    web = F.col("attachment_id").isNull()
    keyed = parts.select(
        "doc_id", "school_id", "source_type", "attachment_id", "pieces", F.coalesce("chunk_index", F.lit(0)).alias("old"),
        F.col("attachment_id").alias("item_file"), F.when(web, F.col("school_id")).alias("item_school"), F.when(web, normalize_url(F.col("source_url"))).alias("item_url"),
        F.floor(F.coalesce("chunk_index", F.lit(0)) / INDEX_BUCKET).alias("bucket"),
    )
    counts = keyed.select("doc_id", "old", "bucket", F.size("pieces").alias("n"), *item)
    sums = counts.groupBy(*item, "bucket").agg(F.sum("n").alias("t"))
    before = W.Window.partitionBy(*item).orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).select(*[F.col(c).alias(f"b_{c}") for c in [*item, "bucket"]], "base")
    inside = W.Window.partitionBy(*item, "bucket").orderBy("old", "doc_id").rowsBetween(W.Window.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.coalesce(F.sum(F.size("pieces")).over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in [*item, "bucket"]]
    on = same[0]
    for s in same[1:]:
        on &= s
    first = local.join(base, on).withColumn("first", F.col("base") + F.col("local"))
    out = first.select("doc_id", "source_type", "school_id", "attachment_id", "first", F.posexplode("pieces").alias("piece_no", "p"))
    return out.select(
        "doc_id", "source_type", "school_id", "attachment_id", (F.col("first") + F.col("piece_no")).cast("int").alias("chunk_index"), "piece_no",
        F.col("p.start").alias("start_at"), F.col("p.own").alias("own_at"), F.col("p.end").alias("end_at"), F.col("p.piece").alias("piece"),
    )


def oversized(docs: DataFrame, attachments: DataFrame, limits: DataFrame) -> DataFrame:
    """src, rec_id: the documents that split_oversized cuts, and the attachments that have one."""
    cut = split_oversized(docs.select("doc_id", "source_type", "attachment_id", "content"), limits).filter(F.size("pieces") > 1)
    cut = cut.select("doc_id", F.when(F.col("source_type") == "attachment", F.col("attachment_id")).alias("attachment_id"))
    # One narrow pass gives both ids; the distinct attachments are then looked up.
    ids = cut.select(F.explode(F.array(F.struct(F.lit("notice_docs").alias("src"), F.col("doc_id").alias("rec_id")), F.struct(F.lit("attachments").alias("src"), F.col("attachment_id").alias("rec_id")))).alias("x"))
    ids = ids.select("x.*").filter("rec_id is not null").distinct()
    have = attachments.select(F.lit("attachments").alias("src"), F.col("attachment_id").alias("rec_id")).distinct()
    return ids.join(have.withColumn("there", F.lit(True)), ["src", "rec_id"], "left").filter("src = 'notice_docs' or there").select("src", "rec_id")
