"""Object statistics: topics, configs, counts, caches, storage, vectors,
search mappings, versions (O-24..O-30, O-38, O-41, O-42)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelens.functions.shapes import depth, entries, shape
from shapelens.functions.values import format_bytes
from shapelens.operators.documents import as_variant
from shapelens.session import footer_session, no_less, qualified, union_all

# Fixed value: the note shown for a cache whose keys cannot be listed.
CACHE_NOTE = "N/A (Memcached does not support key enumeration)"


def topic_rollup(partition_rows: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(topic, partitions, replication_factor) from one row per partition (O-24).

    partition_rows: topic, partition_id, replicas (array). The replication
    factor is the replica count of the lowest partition; a listed topic with
    no partition rows has 0 partitions and factor 0.
    """
    agg = partition_rows.groupBy("topic").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.min_by(F.size("replicas"), F.col("partition_id")).alias("replication_factor"))
    if topics is not None:
        agg = topics.select("topic").join(agg, "topic", "left")
    return agg.select("topic",
                      F.coalesce(F.col("partitions"), F.lit(0)).cast("bigint").alias("partitions"),
                      F.coalesce(F.col("replication_factor"), F.lit(0)).cast("int")
                      .alias("replication_factor"))


def config_map(config_rows: DataFrame) -> DataFrame:
    """(topic, config map<string,string>) of non-default, non-empty settings (O-25).

    config_rows: topic, name, value, is_default. A setting listed twice keeps
    its largest value, so the map is well defined.
    """
    kept = config_rows.where(~F.coalesce(F.col("is_default"), F.lit(False))
                             & (F.coalesce(F.col("value"), F.lit("")) != ""))
    one = kept.groupBy("topic", "name").agg(F.max("value").alias("value"))
    return one.groupBy("topic").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("name", "value")))).alias("config"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, row_count) of every table, as one job (O-26)."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
             .select(F.lit(name).alias("table"), "row_count")
             for name, df in tables.items()]
    return union_all(parts)


def cache_totals(stats: DataFrame, note: str = CACHE_NOTE) -> DataFrame:
    """One ``*`` row with the item count summed over all servers (O-27).

    stats: server, curr_items.
    """
    return stats.agg(F.coalesce(F.sum("curr_items"), F.lit(0)).cast("bigint").alias("count")) \
        .select(F.lit("*").alias("pattern"), "count", F.lit(note).alias("note"))


def storage_stats(paths: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """(table, total_rows, total_bytes, size_text) of Parquet tables by path (O-28).

    Rows are summed from the files' footers (``footer_session``); sizes come from one
    listing of all tables' files, so files without rows count too. A folder that
    isn't there is an error.
    """
    own = footer_session(spark)
    rows = union_all([own.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
                      .select(F.lit(name).alias("table"), no_less(F.col("n")).alias("total_rows")) for name, path in paths.items()])
    files = (own.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
             .load(list(dict.fromkeys(paths.values()))).select("path", "length"))
    under = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(qualified(spark, path)).alias("at")) for name, path in paths.items()])
    sizes = files.select("length", F.inline(F.filter(under, lambda t: (F.col("path") == t["at"]) | F.startswith(
        F.col("path"), F.concat(t["at"], F.lit("/")))))).groupBy("table").agg(F.sum("length").cast("bigint").alias("total_bytes"))
    return (rows.join(sizes, "table", "left").withColumn("total_bytes", F.coalesce("total_bytes", F.lit(0).cast("bigint")))
            .withColumn("size_text", format_bytes(F.col("total_bytes"))))


def vector_profile(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(entities, dimension, min_dim, max_dim, null_vectors) of a vector column (O-29).

    ``dimension`` is the common length when every vector has the same one.
    """
    n = F.size(F.col(vec_col))
    agg = df.agg(F.count(F.col(id_col)).cast("bigint").alias("entities"),
                 F.min(F.when(F.col(vec_col).isNotNull(), n)).alias("min_dim"),
                 F.max(F.when(F.col(vec_col).isNotNull(), n)).alias("max_dim"),
                 F.count_if(F.col(vec_col).isNull()).cast("bigint").alias("null_vectors"))
    return agg.select("entities",
                      F.when(F.col("min_dim") == F.col("max_dim"), F.col("min_dim"))
                      .alias("dimension"), "min_dim", "max_dim", "null_vectors")


def object_counts(objects: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, count) for each kind of object that has any (O-30)."""
    return row_counts(objects).select(F.col("table").alias("kind"),
                                      F.col("row_count").alias("count")) \
        .where(F.col("count") > 0)


def _mapping_docs(df: DataFrame, index_col: str, mapping_col: str) -> DataFrame:
    return df.select(F.col(index_col).cast("string").alias("index"),
                     as_variant(df, mapping_col).alias("mapping"))


def flatten_mapping(df: DataFrame, index_col: str = "index",
                    mapping_col: str = "mapping") -> DataFrame:
    """Search-engine mapping trees -> one row per field (O-41).

    A field is whatever stands under a ``properties`` key (of the root or of
    another field) or under a field's ``fields`` key. The tree is walked level by
    level, so each field is met once: a step adds the fields under the
    ``properties`` of the last level's. Type ``object`` (multi-fields:
    ``unknown``) where none is given; comment ``Analyzer: x``. Mappings that
    don't parse have no fields; ``unparsable_mappings`` lists them.
    """
    def under(path: Column, spec: Column, key: str) -> Column:
        inner = entries(F.try_variant_get(spec, f"$.{key}", "variant"))
        found = F.transform(inner, lambda e: F.struct(F.concat_ws(".", path, e["key"]).alias("path"), e["value"].alias("spec")))
        return F.coalesce(found, F.array())

    def step(state: Column, _: Column) -> Column:
        return F.struct(F.concat(state["all"], state["last"]).alias("all"), F.flatten(F.transform(
            state["last"], lambda f: under(f["path"], f["spec"], "properties"))).alias("last"))

    top = under(F.lit(None).cast("string"), F.col("mapping"), "properties")
    start = F.struct(F.slice(top, 1, 0).alias("all"), top.alias("last"))
    levels = F.sequence(F.lit(1), F.greatest(F.coalesce(depth(shape("mapping")), F.lit(1)), F.lit(1)))
    fields = F.aggregate(levels, start, step, lambda s: F.concat(s["all"], s["last"]))
    given = lambda spec, key: F.try_variant_get(spec, f"$.{key}", "string")
    named = lambda f: F.struct(
        f["path"].alias("path"), F.coalesce(given(f["spec"], "type"), F.lit("object")).alias("type"),
        F.concat(F.lit("Analyzer: "), given(f["spec"], "analyzer")).alias("comment"))
    multi = lambda f: F.transform(under(f["path"], f["spec"], "fields"), lambda m: F.struct(
        m["path"].alias("path"), F.coalesce(given(m["spec"], "type"), F.lit("unknown")).alias("type"),
        F.lit(None).cast("string").alias("comment")))
    rows = F.array_distinct(F.concat(F.transform("fields", named), F.flatten(F.transform("fields", multi))))
    return (_mapping_docs(df, index_col, mapping_col).withColumn("fields", fields)
            .select("index", F.inline(rows)).select("index", "path", "type", F.lit(True).alias("nullable"), "comment"))


def unparsable_mappings(df: DataFrame, index_col: str = "index",
                        mapping_col: str = "mapping") -> DataFrame:
    """(index) of the mappings that are given but don't parse."""
    docs = df.select(F.col(index_col).cast("string").alias("index"),
                     as_variant(df, mapping_col).alias("_doc"), F.col(mapping_col).alias("_given"))
    return docs.where(F.col("_given").isNotNull() & F.col("_doc").isNull()).select("index")
