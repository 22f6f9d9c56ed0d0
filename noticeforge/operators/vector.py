"""Nearest neighbours by cosine over array columns: exact in blocks, or by random planes with a measured recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from noticeforge.plans.joins import spread
from noticeforge.sources.tables import materialized

#: Queries of one block: a block meets every item batch that it may match as one matrix product.
BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; 0 if either has no length, null if either is null or their sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def with_dimension(rows: DataFrame, column: str, size: int) -> DataFrame:
    """rows whose vectors must have that many numbers: another one is an error, null is none."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector of {column} has "), F.size(column).cast("string"), F.lit(f" numbers, not {size}")))
    return rows.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == size), F.col(column)).otherwise(wrong))


def _matrix(column: pa.Array, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors of one size."""
    places = np.flatnonzero(sizes == size)
    flat = np.asarray(column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(places), size)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return places, np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each batch of (block of queries, items): the k best items of each query; they are ranked over all batches afterwards."""
    for batch in batches:
        for row in range(batch.num_rows):
            q, i = batch.column("qs")[row].values, batch.column("items")[row].values
            if q is None or i is None or not len(q) or not len(i):
                continue
            qv, iv = q.field("vec"), i.field("vec")
            qn, im = qv.value_lengths().to_numpy(zero_copy_only=False), iv.value_lengths().to_numpy(zero_copy_only=False)
            qid, iid = q.field("id").to_numpy(zero_copy_only=False), i.field("id").to_numpy(zero_copy_only=False)
            for size in np.intersect1d(qn, im):
                qp, qm = _matrix(qv, qn, int(size))
                ip, items = _matrix(iv, im, int(size))
                # Ties go to the smaller id: items are ordered by it before a stable sort.
                order = np.argsort(iid[ip], kind="stable")
                ip, items = ip[order], items[order]
                scores = np.clip(qm @ items.T, -1.0, 1.0)
                if scores.shape[1] > k:
                    bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] - 1e-9
                    at, which = np.nonzero(scores >= bar)
                else:
                    at, which = np.indices(scores.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(qid[qp][at]), pa.array(iid[ip][which]), pa.array(scores[at, which])], ["query_id", "item_id", "score"])


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, same: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """query_id, item_id, score, rank: the k best items of each query, ties (scores equal to 12 digits) by the smaller item_id.

    queries (query_id, q_vec, *same) and items (item_id, i_vec, *same) with integer ids; `same` columns (tenant, pool) must agree,
    nulls agree with nothing. Null vectors and those of another size match nothing; k <= 0 gives no row.

    Both sides are cut into blocks of `block` rows by the hash of their ids within `same`; each pair of blocks is one matrix
    product in one Arrow row, whose best k go on. So no side is broadcast, a hot tenant is spread over as many pairs of blocks as
    it has, and a task holds two blocks at a time. The queries are a stated set (all against all costs what it costs).
    """
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id bigint, item_id bigint, score double, rank bigint")
    keys = list(same)

    def blocks(df: DataFrame, ident: str, vec: str, out: str) -> DataFrame:
        rows = df.filter(F.col(vec).isNotNull() & F.col(ident).isNotNull()).select(*keys, F.col(ident).cast("bigint").alias("id"), F.col(vec).alias("vec"))
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
        placed = rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))
        placed = placed.withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
        return placed.groupBy(*keys, F.col("__b").alias(f"__{out}")).agg(F.collect_list(F.struct("id", "vec")).alias(out))  # about `block` rows

    q, i = materialized(blocks(queries, "query_id", "q_vec", "qs")), materialized(blocks(items, "item_id", "i_vec", "items"))
    pairs = i.join(q, keys) if keys else i.crossJoin(q)  # of blocks, not of rows
    rows = spread(pairs.select("qs", "items"))
    spark = rows.sparkSession
    scored = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())).mapInArrow(lambda b: _best(b, k), "query_id bigint, item_id bigint, score double")
    best = W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "item_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)


def above(ranked: DataFrame, least: float) -> DataFrame:
    """The ranked rows of at least that score: the threshold comes after the limit."""
    return ranked.filter(F.col("score") >= least)


def approximate_top_k(queries: DataFrame, items: DataFrame, k: int = 5, planes: int = 6, tables: int = 24, seed: int = 7) -> DataFrame:
    """query_id, item_id, score, rank by random planes: items that share one of `tables` buckets of 2^planes with a query are compared.

    Every item is indexed. With more tables or fewer planes the recall rises; a query that meets fewer than k items has fewer rows.
    Vectors of the most common size only; those of other sizes match nothing.
    """
    vectors = items.filter(F.col("i_vec").isNotNull())
    size = vectors.groupBy(F.size("i_vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None or k <= 0:
        return top_k(queries, items, 0)
    normal = np.random.default_rng(seed).standard_normal((int(size["n"]), tables * planes))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            places, unit = _matrix(batch.column("vec"), lengths, normal.shape[0])
            bits = (unit @ normal > 0).reshape(len(places), tables, planes)
            codes = bits @ (1 << np.arange(planes)) + (np.arange(tables) << planes)
            ids = batch.column("id").take(pa.array(np.repeat(places, tables)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(codes.ravel().astype(np.int64))], ["id", "bucket"])

    def bucketed(df: DataFrame, ident: str, vec: str) -> DataFrame:
        rows = df.filter(F.col(vec).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
        return spread(rows).mapInArrow(buckets, "id bigint, bucket bigint").withColumnRenamed("id", ident)

    # Only ids meet in the buckets; the vectors join the distinct pairs.
    met = bucketed(queries, "query_id", "q_vec").join(bucketed(items, "item_id", "i_vec"), "bucket").select("query_id", "item_id").distinct()
    found = met.join(queries.select("query_id", "q_vec"), "query_id").join(vectors.select("item_id", "i_vec"), "item_id")
    scored = found.select("query_id", "item_id", cosine(F.col("q_vec"), F.col("i_vec")).alias("score"))
    best = W.Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "item_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)
