"""Graph operators over edge tables (edge_id, src, tgt, relation, doc_ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touching(edges: DataFrame) -> DataFrame:
    """node, other, edge columns: each edge once per endpoint, a self-loop once. Replaces a join on src or tgt."""
    ends = F.when(F.col("src") == F.col("tgt"), F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other")))).otherwise(
        F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other")), F.struct(F.col("tgt").alias("node"), F.col("src").alias("other")))
    )
    return edges.withColumn("e", F.explode(ends)).select("e.node", "e.other", *edges.columns)


def degree_top(edges: DataFrame, n: int = 100) -> DataFrame:
    """node, degree of the n nodes of most edges, ties by the smaller node; a self-loop counts once."""
    return touching(edges).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges that touch a seed (column node), each once; equal rows are one edge."""
    hit = touching(edges).join(seeds.select("node").distinct(), "node", "left_semi")
    return hit.select(*edges.columns).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose endpoints are both in nodes (column node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "tgt"), "tgt", "left_semi")


def subgraph_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree within the induced subgraph: both endpoints count, so a self-loop counts twice; lone nodes have 0."""
    ends = induced(edges, nodes).select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").distinct().join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def resolve_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (chunk, source, relation, target) with source_id, target_id and state of their names within the chunk.

    A name counts as it is written: one entity of the chunk resolves it, none is unknown, several are ambiguous.
    """
    ids = entities.groupBy("chunk", "name").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
    out = relations
    for side in ("source", "target"):
        part = ids.select("chunk", F.col("name").alias(side), F.when(F.col("low") == F.col("high"), F.col("low")).alias(f"{side}_id"), (F.col("low") != F.col("high")).alias(f"{side}_many"))
        out = out.join(part, ["chunk", side], "left")
    many = F.coalesce("source_many", F.lit(False)) | F.coalesce("target_many", F.lit(False))
    state = F.when(F.col("source_id").isNotNull() & F.col("target_id").isNotNull(), "resolved").when(many, "ambiguous").otherwise("unknown")
    return out.withColumn("state", state).drop("source_many", "target_many")
