"""Keyed merges and state updates: set-wise forms of row-by-row upserts, written as new versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.sources.tables import materialized


def latest(source: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`; combines on the map side. Rows with a null key part are rows of their own key."""
    rest = [c for c in source.columns if c not in key]
    if any("map<" in t for c, t in source.dtypes if c in rest):  # maps have no order, so ties are broken by the others' hash
        hashed = F.xxhash64(*[c for c, t in source.dtypes if c in rest and "map<" not in t])
        best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"__o{i}") for i, o in enumerate([*order, hashed])]))
        return source.groupBy(*key).agg(best.alias("__row")).select(*key, "__row.*").select(*source.columns)
    best = F.max(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row")))
    return source.groupBy(*key).agg(best["__row"].alias("__row")).select(*key, "__row.*").select(*source.columns)


def upsert(target: DataFrame, source: DataFrame, key: list[str], overwrite: list[str], reset: dict[str, Column] | None = None, surrogate: str | None = None) -> DataFrame:
    """target with the rows of source (one per key) merged in.

    On a match the `overwrite` columns are the source's, `reset` columns get their value, the others (the surrogate id too) stay
    the target's. New keys are added with the source's columns and `reset`; the surrogate id of the n-th new key, by key, is
    the greatest one so far plus n. Merging the same source again changes nothing.
    """
    reset = reset or {}
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    there, given = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    both = target.withColumn("__t", F.lit(1)).alias("t").join(source.withColumn("__s", F.lit(1)).alias("s"), cond, "full_outer")
    cols = []
    for c in target.columns:
        if c in reset:
            cols.append(F.when(given, reset[c]).otherwise(F.col(f"t.{c}")).alias(c))
        elif c in key or c not in source.columns:
            cols.append((F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) if c in source.columns else F.col(f"t.{c}")).alias(c))
        elif c in overwrite:
            cols.append(F.when(given, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.when(there, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    merged = both.select(*cols)
    if not surrogate:
        return merged
    merged = materialized(merged)  # read for the known and for the new keys
    top = target.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("__top"))
    fresh = number_rows(merged.filter(F.col(surrogate).isNull()).drop(surrogate), key, "__n")
    fresh = fresh.join(F.broadcast(top)).withColumn(surrogate, F.col("__top") + F.col("__n")).select(*target.columns)
    return merged.filter(F.col(surrogate).isNotNull()).unionByName(fresh)


def number_rows(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """rows numbered from 1 in the order of `order`, without bringing them into one task: sorted ranges, sizes, then offsets."""
    spark = rows.sparkSession
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    kept = materialized(parts)
    sizes = {r["__p"]: r["n"] for r in kept.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one row per range
    base, at = [], 0
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    offsets = spark.createDataFrame(base, "__p int, __base long")
    return kept.join(F.broadcast(offsets), "__p").withColumn(out, F.col("__base") + F.col("__i") + 1).drop("__p", "__i", "__base")


def merge_entities(rows: DataFrame) -> DataFrame:
    """Upserts of entities (school_id, norm_key, ord, type, name, attributes, source_doc_ids) folded to one row per key.

    The first writer keeps type and name; of attributes of one name the last writer's value holds; document ids are a sorted
    set. Writers without a document are rejected. Attributes are folded per (key, name), so no map is built over a hot key.
    """
    ok = rows.filter(F.size("source_doc_ids") > 0)
    key = ["school_id", "norm_key"]
    head = ok.groupBy(*key).agg(F.min(F.struct("ord", "type", "name")).alias("h"))
    fields = ok.select(*key, "ord", F.explode("attributes").alias("k", "v")).groupBy(*key, "k").agg(F.max(F.struct("ord", "v"))["v"].alias("v"))
    attributes = fields.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    docs = ok.select(*key, F.explode("source_doc_ids").alias("d")).filter("d is not null").groupBy(*key).agg(F.array_sort(F.collect_set("d")).alias("source_doc_ids"))
    merged = head.join(docs, key).join(attributes, key, "left")
    return merged.select(*key, "h.type", "h.name", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), "source_doc_ids")


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upserts of edges (src, tgt, relation, doc_ids) with both endpoints in nodes (node): one row per edge, ids a sorted set."""
    ids = nodes.select("node").distinct()
    ok = edges.filter(F.size("doc_ids") > 0).join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "tgt"), "tgt", "left_semi")
    return ok.select("src", "tgt", "relation", F.explode("doc_ids").alias("d")).groupBy("src", "tgt", "relation").agg(F.array_sort(F.collect_set("d")).alias("doc_ids"))


def observe(docs: DataFrame, observed: DataFrame) -> DataFrame:
    """docs with miss_count after a crawl that saw the pairs of `observed` (school_id, source_url).

    Active web rows that were seen start again at 0, the others of a crawled school count one more miss. Schools without any
    observation are left as they are (an empty crawl says nothing); attachments and expired rows too.
    """
    seen = observed.filter("source_url is not null and source_url <> ''").select("school_id", "source_url").distinct().withColumn("__seen", F.lit(True))
    crawled = seen.select("school_id").distinct().withColumn("__crawled", F.lit(True))
    active = (F.col("source_type") == "web") & F.col("expired_at").isNull() & F.coalesce("__crawled", F.lit(False))
    count = F.when(~active, F.col("miss_count")).when(F.col("__seen"), 0).otherwise(F.coalesce("miss_count", F.lit(0)) + 1)
    return docs.join(seen, ["school_id", "source_url"], "left").join(crawled, "school_id", "left").withColumn("miss_count", count.cast("int")).select(*docs.columns)


def expire(docs: DataFrame, at: Column, misses: int = 3) -> DataFrame:
    """docs with expired_at set where misses have been reached and it was null."""
    if misses < 1:
        raise ValueError("misses must be 1 or more")
    return docs.withColumn("expired_at", F.when(F.col("expired_at").isNull() & (F.col("miss_count") >= misses), at).otherwise(F.col("expired_at")))


def reconcile(target: DataFrame, seed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, action of seeding: created, updated (a field differs), unchanged, or kept (not in the seed)."""
    t, s = target.select(key, F.struct(*fields).alias("t")), seed.select(key, F.struct(*fields).alias("s"))
    action = F.when(F.col("t").isNull(), "created").when(F.col("s").isNull(), "kept").when(F.col("t").eqNullSafe(F.col("s")), "unchanged").otherwise("updated")
    return t.join(s, key, "full_outer").select(key, action.alias("action"))


def append(target: DataFrame, rows: DataFrame, surrogate: str, order: list[str]) -> DataFrame:
    """target and the new rows, numbered after its greatest id by `order`; columns that rows lack are null. No rows: no change."""
    missing = {c: F.lit(None).cast(t) for c, t in target.dtypes if c not in rows.columns and c != surrogate}
    top = target.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("__top"))
    fresh = number_rows(rows.withColumns(missing) if missing else rows, order, "__n").join(F.broadcast(top))
    return target.unionByName(fresh.withColumn(surrogate, (F.col("__top") + F.col("__n")).cast(target.schema[surrogate].dataType)).select(*target.columns))


def partial_update(target: DataFrame, changes: DataFrame, key: str, allowed: list[str], stamp: str | None = None, at: Column | None = None) -> DataFrame:
    """target with the fields of changes (key, values map<string,string>, one row per key) that are allowed.

    Other fields are ignored, blank texts become null, and a change without an allowed field leaves its row as it is, the
    stamp too.
    """
    mine = changes.select(key, F.map_filter("values", lambda k, _: k.isin(*allowed)).alias("__v")).filter(F.size("__v") > 0)
    out = target.join(mine, key, "left")
    cols = {c: F.when(F.map_contains_key("__v", F.lit(c)), F.nullif(F.trim(F.element_at("__v", c)), F.lit("")).cast(target.schema[c].dataType)).otherwise(F.col(c)) for c in allowed}
    if stamp:
        cols[stamp] = F.when(F.col("__v").isNotNull(), at).otherwise(F.col(stamp))
    return out.withColumns(cols).select(*target.columns)


def set_status(target: DataFrame, changes: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """target with the status of changes (key, *replace, *keep): `replace` columns are taken over, null too, `keep` ones only if given."""
    theirs = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in [*keep, *replace]])
    out = target.join(theirs, key, "left")
    cols = {c: F.coalesce(f"__{c}", c) for c in keep} | {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in replace}
    return out.withColumns(cols).select(*target.columns)


def delete(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """target without the rows of those ids; rows with a null key stay."""
    return target.join(ids.select(key).distinct(), key, "left_anti").select(*target.columns)


def delete_schools(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables (name -> rows with a school_id) without those schools; tables without that column, as specifications by host, stay."""
    return {n: delete(t, ids, "school_id") if "school_id" in t.columns else t for n, t in tables.items()}


def delete_attachments(attachments: DataFrame, docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """attachments and documents without those files and their chunks."""
    return delete(attachments, ids, "attachment_id"), delete(docs, ids, "attachment_id")


def with_schema(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with all columns of schema: missing ones are added as null, nulls of those with a default get it. Others are left out."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name))
    return df.select(*cols)


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()), "array<bigint>": T.ArrayType(T.LongType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(" ") for f in text.split(", "))])


#: The tables of the store.
SCHEMAS: dict[str, T.StructType] = {
    "schools": _schema("school_id bigint, name string, base_url string, image_url string, crawl_schedule string, status string, crawl_started_at timestamp, created_at timestamp, updated_at timestamp"),
    "adapter_specs": _schema("spec_id bigint, host string, spec string, source string, created_at timestamp, updated_at timestamp"),
    "crawl_quality": _schema("quality_id bigint, school_id bigint, crawl_id string, board string, listing_rows int, title_ratio double, date_ratio double, checked_details int, findings array<string>, recorded_at timestamp"),
    "attachments": _schema("attachment_id bigint, school_id bigint, filename string, content_type string, byte_size bigint, file_hash string, page_count int, chunk_count int, status string, error_code string, truncated boolean, uploaded_at timestamp"),
    "documents": _schema("doc_id bigint, school_id bigint, source_url string, title string, content string, chunk_index int, content_hash string, embedding array<float>, crawled_at timestamp, miss_count int, expired_at timestamp, source_type string, page int, attachment_id bigint"),
    "entities": _schema("entity_id bigint, school_id bigint, type string, name string, norm_key string, attributes map<string,string>, source_doc_ids array<bigint>"),
    "edges": _schema("edge_id bigint, school_id bigint, source_entity_id bigint, target_entity_id bigint, relation string, source_doc_ids array<bigint>"),
}
DEFAULTS: dict[str, dict[str, object]] = {"documents": {"miss_count": 0, "source_type": "web", "chunk_index": 0}, "attachments": {"status": "pending", "page_count": 0, "chunk_count": 0, "truncated": False}, "schools": {"status": "idle"}, "adapter_specs": {"source": "human"}}


def create_tables(spark: SparkSession, folder: str) -> None:
    """The store's tables as parquet in folder: missing ones are made empty; those there keep their rows, and columns they lack are null when read by read_table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, schema in SCHEMAS.items():
        at = path(f"{folder}/{name}.parquet")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the store in its present schema, with its defaults for nulls."""
    return with_schema(spark.read.parquet(f"{folder}/{name}.parquet"), SCHEMAS[name], DEFAULTS.get(name))
