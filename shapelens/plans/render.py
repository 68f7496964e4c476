"""Checked rendering queries (O-04, O-43..O-46)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shapelens.operators.catalog import (assemble_foreign_keys, assemble_indexes,
                                         normalise_columns, normalise_search_indices,
                                         normalise_topology)
from shapelens.operators.keys import key_template_groups, prefix_rollup
from shapelens.operators.objects import config_map, row_counts, topic_rollup
from shapelens.operators.documents import field_profile
from shapelens.operators.render import (collection_lines, nest_table_details, render_database, render_listing,
                                        render_objects, render_table_details, read_markdown, write_markdown)
from shapelens.plans import duck
from shapelens.operators.catalog import list_routines, list_tables, list_views
from shapelens.operators.objects import cache_totals, storage_stats, vector_profile
from shapelens.plans.catalog import (COLUMN_DUMPS, EXCHANGES, FK_KEY_USAGE, FK_RULES, INDEX_ROWS,
                                     OBJECT_LISTINGS, QUEUES, ROUTINE_LISTING, SEARCH_STATS, VIEW_LISTING)
from shapelens.plans.inputs import KEY_LISTING, ORDER_DOCUMENTS, PREFIX_KEYS
from shapelens.plans.keys import _DUCK_PREFIXES
from shapelens.plans.objects import TOPIC_CONFIGS, table_paths
from shapelens.plans.registry import ORACLES, duck_sql, query, spark_sql
from shapelens.session import TESTDATA_TABLES, ensure_checkpoint_dir, read_table

NL = " || chr(10) || "


def _j(*parts: str) -> str:
    return NL.join(parts)


def _key_pattern_blocks(spark, sf):
    groups = key_template_groups(spark_sql(spark, sf, KEY_LISTING), "key", "type", 10)
    return render_objects(groups, "key_patterns")


@query("render_key_patterns", f"""
WITH t AS (SELECT key, type, {duck.key_template('key')} AS pattern
           FROM ({duck_sql(KEY_LISTING)})),
pt AS (SELECT pattern, type, count(*) AS n FROM t GROUP BY pattern, type),
c AS (SELECT pattern, sum(n) AS count,
             string_agg('- ' || type || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY type)
               AS types
      FROM pt GROUP BY pattern),
r AS (SELECT pattern, key, row_number() OVER (PARTITION BY pattern ORDER BY key) AS rn FROM t),
s AS (SELECT pattern, string_agg('- ' || key, chr(10) ORDER BY key) AS samples
      FROM r WHERE rn <= 10 GROUP BY pattern)
SELECT {_j("'### Pattern: ' || c.pattern", "'**Count**: ' || format('{:,}', c.count)", "''",
           "'**Types**:'", "c.types", "''", "'**Sample Keys**:'", "s.samples", "''", "'---'",
           "''")} AS text
FROM c JOIN s USING (pattern)
""")
def q_render_key_patterns(spark, sf):
    return _key_pattern_blocks(spark, sf).select("text")


def _prefix_blocks(spark, sf):
    return render_objects(prefix_rollup(spark_sql(spark, sf, PREFIX_KEYS)), "prefixes")


@query("render_prefixes", f"""
WITH {_DUCK_PREFIXES},
c AS (SELECT prefix, depth, count(*) AS count FROM e GROUP BY prefix, depth),
kept AS (SELECT * FROM c WHERE depth = 1 OR count >= 2),
r AS (SELECT e.prefix, e.key, row_number() OVER (PARTITION BY e.prefix ORDER BY e.key) AS rn
      FROM e JOIN kept USING (prefix)),
s AS (SELECT prefix, string_agg('- ' || key, chr(10) ORDER BY key) AS samples
      FROM r WHERE rn <= 5 GROUP BY prefix)
SELECT {_j("'### Prefix: ' || kept.prefix", "'**Count**: ' || format('{:,}', kept.count)",
           "'**Depth**: ' || CAST(kept.depth AS VARCHAR)", "''", "'**Sample Keys**:'",
           "s.samples", "''", "'---'", "''")} AS text
FROM kept JOIN s USING (prefix)
""")
def q_render_prefixes(spark, sf):
    return _prefix_blocks(spark, sf).select("text")


def _topic_blocks(spark, sf):
    ev = read_table(spark, sf, "events")
    parts = ev.select(F.col("event_type").alias("topic"), F.col("event_id").alias("partition_id"),
                      F.sequence(F.lit(1), (1 + F.col("event_id") % 3).cast("int")).alias("replicas"))
    topics = topic_rollup(parts).join(config_map(spark_sql(spark, sf, TOPIC_CONFIGS)),
                                      "topic", "left")
    return render_objects(topics, "topics")


@query("render_topics", f"""
WITH p AS (SELECT event_type AS topic, count(*) AS partitions,
                  arg_min(1 + event_id % 3, event_id) AS rf
           FROM events GROUP BY event_type),
k AS (SELECT topic, name, max(value) AS value FROM ({duck_sql(TOPIC_CONFIGS)})
      WHERE NOT coalesce(is_default, false) AND coalesce(value, '') <> ''
      GROUP BY topic, name),
cfg AS (SELECT topic, string_agg('- ' || name || ': ' || value, chr(10) ORDER BY name) AS lines
        FROM k GROUP BY topic)
SELECT {_j("'### Topic: ' || p.topic", "'**Partitions**: ' || CAST(p.partitions AS VARCHAR)",
           "'**Replication Factor**: ' || CAST(p.rf AS VARCHAR)", "''",
           "CASE WHEN cfg.lines IS NULL THEN '---' ELSE '**Configuration**:' || chr(10) || "
           "cfg.lines || chr(10) || '' || chr(10) || '---' END", "''")} AS text
FROM p LEFT JOIN cfg USING (topic)
""")
def q_render_topics(spark, sf):
    return _topic_blocks(spark, sf).select("text")


def _queue_blocks(spark, sf):
    return render_objects(normalise_topology(spark_sql(spark, sf, QUEUES), "queues"), "queues")


@query("render_queues", f"""
SELECT {_j("'### Queue: ' || name",
           "'**Durable**: ' || CASE WHEN durable THEN 'Yes' ELSE 'No' END",
           "'**Auto Delete**: ' || CASE WHEN auto_delete THEN 'Yes' ELSE 'No' END",
           "'**Messages**: ' || format('{:,}', coalesce(messages, 0))",
           "'**Consumers**: ' || CAST(coalesce(consumers, 0) AS VARCHAR)", "''", "'---'",
           "''")} AS text
FROM ({duck_sql(QUEUES)})
""")
def q_render_queues(spark, sf):
    return _queue_blocks(spark, sf).select("text")


def _duck_parse_int(x: str) -> str:
    return (f"CASE WHEN regexp_matches(coalesce({x}, '0'), '^\\s*[+-]?[0-9]+') THEN "
            f"CAST(regexp_extract(coalesce({x}, '0'), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) END")


_LISTED = "SELECT {} AS sort_key, {} AS text"


def _listing_oracle(database: str, kind: str, oracle: str) -> str:
    bullet = (f"'- **' || name || '** ({kind})' || CASE WHEN coalesce(comment, '') <> '' THEN ': ' || comment ELSE '' END"
              " || CASE WHEN row_count IS NOT NULL THEN ' [' || format('{:,}', row_count) || ' rows]' ELSE '' END")
    return f"WITH l AS ({oracle})\n" + "\nUNION ALL\n".join([
        _LISTED.format("'0'", f"'# Tables in {database}'"), _LISTED.format("'1'", "''"),
        _LISTED.format("'2'", "'Found ' || (SELECT count(*) FROM l) || ' table(s):'"), _LISTED.format("'3'", "''"),
        _LISTED.format("'4' || name", bullet) + " FROM l"])


def _register_rendered_listing(dialect: str) -> None:
    template, kind, *_ = OBJECT_LISTINGS[dialect]

    @query(f"render_listing_{dialect}", _listing_oracle(dialect, kind, ORACLES[f"list_tables_{dialect}"]))
    def q(spark, sf):
        return render_listing(list_tables(spark_sql(spark, sf, template), dialect), dialect)


for _d in ("kafka", "etcd", "elasticsearch"):
    _register_rendered_listing(_d)


# Search statistics with nulls and texts that are no numbers in every field.
NULL_STATS = SEARCH_STATS.replace("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END",
                                  "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END") \
    .replace("ELSE 'red' END AS health", "END AS health").replace(
        "'open' AS status", "CASE WHEN o_orderkey % 4 > 0 THEN 'open' END AS status")


@query("render_indices", f"""
SELECT {_j("'### Index: ' || index", "'**Health**: ' || coalesce(health, 'unknown')",
           "'**Status**: ' || coalesce(status, 'unknown')",
           f"'**Documents**: ' || coalesce(format('{{:,}}', {_duck_parse_int('docs_count')}), 'unknown')",
           "'**Size**: ' || coalesce(store_size, '0b')",
           f"'**Primary Shards**: ' || coalesce(CAST({_duck_parse_int('pri')} AS VARCHAR), 'unknown')",
           f"'**Replica Shards**: ' || coalesce(CAST({_duck_parse_int('rep')} AS VARCHAR), 'unknown')",
           "''", "'---'", "''")} AS text
FROM ({duck_sql(NULL_STATS)})
""")
def q_render_indices(spark, sf):
    idx = normalise_search_indices(spark_sql(spark, sf, NULL_STATS))
    return render_objects(idx, "indices").select("text")


@query("render_listing", "\nUNION ALL\n".join(
    ["SELECT '0' AS sort_key, '# Tables in testdata' AS text",
     "SELECT '1' AS sort_key, '' AS text",
     f"SELECT '2' AS sort_key, 'Found {len(TESTDATA_TABLES)} table(s):' AS text",
     "SELECT '3' AS sort_key, '' AS text"]
    + [f"SELECT '4{t}' AS sort_key, '- **{t}** [' || format('{{:,}}', count(*)) || ' rows]' "
       f"AS text FROM {t}" for t in TESTDATA_TABLES]))
def q_render_listing(spark, sf):
    counts = row_counts({t: read_table(spark, sf, t) for t in TESTDATA_TABLES})
    listing = counts.select(F.col("table").alias("name"), F.lit("table").alias("type"),
                            F.lit(None).cast("string").alias("comment"), "row_count")
    return render_listing(listing, "testdata")


def _database_lines(spark, sf):
    blocks = {"key_patterns": _key_pattern_blocks(spark, sf),
              "topics": _topic_blocks(spark, sf),
              "queues": _queue_blocks(spark, sf),
              "prefixes": _prefix_blocks(spark, sf)}
    keys = spark_sql(spark, sf, KEY_LISTING).agg(F.count(F.lit(1)).alias("total"))
    return render_database(blocks, "testdata", "spark", "4.1",
                           totals={"key_patterns": keys})


def _render_database_oracle() -> str:
    from shapelens.plans.registry import ORACLES

    def blocks(name: str) -> str:
        return f"SELECT text FROM ({ORACLES[name]})"

    header = ["# Database Schema: testdata", "", "**Database Type**: SPARK", "**Version**: 4.1", ""]
    parts = [f"SELECT 0 AS section, '{line}' AS text" for line in header]
    keys_total = f"(SELECT count(*) FROM ({duck_sql(KEY_LISTING)}))"
    for section, heading, name in [
            (5, f"'## Key Patterns (Total Keys: ' || format('{{:,}}', {keys_total}) || ')'",
             "render_key_patterns"),
            (7, "'## Topics (' || CAST((SELECT count(*) FROM (" + ORACLES["render_topics"]
             + ")) AS VARCHAR) || ')'", "render_topics"),
            (8, "'## Queues (' || CAST((SELECT count(*) FROM (" + ORACLES["render_queues"]
             + ")) AS VARCHAR) || ')'", "render_queues"),
            (11, "'## Key Prefixes (Total Keys: Unknown)'", "render_prefixes")]:
        parts.append(f"SELECT {section} AS section, {heading} AS text")
        parts.append(f"SELECT {section} AS section, '' AS text")
        parts.append(f"SELECT {section} AS section, text FROM ({blocks(name)})")
    return "\nUNION ALL\n".join(parts)


@query("render_database", _render_database_oracle())
def q_render_database(spark, sf):
    return _database_lines(spark, sf).select("section", "text")


@query("write_markdown", """
WITH l AS (SELECT '0' AS k, '# Tables in customers' AS text UNION ALL SELECT '1' AS k, '' AS text
  UNION ALL SELECT '2' AS k, 'Found ' || CAST((SELECT count(*) FROM customer) AS VARCHAR) || ' table(s):' AS text
  UNION ALL SELECT '3' AS k, '' AS text
  UNION ALL SELECT '4' || c_name AS k, '- **' || c_name || '**: ' || c_mktsegment || ' [' || format('{:,}', c_custkey) || ' rows]' AS text FROM customer)
SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS line, text FROM l
""")
def q_write_markdown(spark, sf):
    """A listing of all customers, written, checked and read back in order."""
    listing = read_table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.lit("table").alias("type"), F.col("c_mktsegment").alias("comment"), F.col("c_custkey").alias("row_count"))
    path = f"{ensure_checkpoint_dir(spark)}/markdown-{uuid.uuid4().hex}"
    write_markdown(render_listing(listing, "customers"), path)
    return read_markdown(spark, path)


@query("write_database_document", "SELECT CAST(count(*) AS BIGINT) AS lines, count(*) = max(line) AND min(line) = 1 AS gapless FROM (SELECT "
       "row_number() OVER () AS line FROM (SELECT unnest(string_split(text, chr(10))) FROM (" + _render_database_oracle() + ")))")
def q_write_database_document(spark, sf):
    """The whole database document as files by section."""
    path = f"{ensure_checkpoint_dir(spark)}/markdown-{uuid.uuid4().hex}"
    write_markdown(_database_lines(spark, sf), path)
    return read_markdown(spark, path).agg(F.count(F.lit(1)).alias("lines"), ((F.count_distinct("line") == F.max("line")) & (
        F.count(F.lit(1)) == F.max("line")) & (F.min("line") == 1)).alias("gapless"))


@query("render_collections", f"""
WITH d AS ({duck_sql(ORDER_DOCUMENTS)}),
l AS ({duck.json_leaves('d', 'd.collection')}),
pt AS (SELECT collection, path, type, count(*) AS type_count FROM l
       GROUP BY collection, path, type),
pp AS (SELECT *, sum(type_count) OVER (PARTITION BY collection, path) AS occurrences FROM pt),
n AS (SELECT collection, count(*) AS docs FROM d GROUP BY collection),
f AS (SELECT pp.collection, path,
             string_agg(type || ' (' || CAST({duck.pct('type_count', 'occurrences')} AS VARCHAR)
                        || '%)', ', ' ORDER BY {duck.pct('type_count', 'occurrences')} DESC, type)
               AS types,
             max({duck.pct('occurrences', 'n.docs')}) AS occ
      FROM pp JOIN n USING (collection) GROUP BY pp.collection, path)
SELECT {_j("'### Collection: ' || collection", "'**Document Count**: ' || format('{:,}', docs)", "''",
           "'**Fields** (inferred from ' || CAST(docs AS VARCHAR) || ' samples):'", "''",
           "'| Field | Types | Occurrence |'", "'|-------|-------|------------|'")} AS text FROM n
UNION ALL SELECT '| ' || path || ' | ' || types || ' | ' || CAST(occ AS VARCHAR) || '% |' AS text FROM f
UNION ALL SELECT '' AS text FROM n
UNION ALL SELECT '---' || chr(10) || '' AS text FROM n
""")
def q_render_collections(spark, sf):
    text = spark_sql(spark, sf, ORDER_DOCUMENTS)
    profile = field_profile(text, "json", by=["collection"])
    stats = text.groupBy("collection").agg(F.count(F.lit(1)).cast("bigint").alias("document_count")) \
        .withColumn("sample_size", F.col("document_count"))
    return collection_lines(profile, stats).select("text")


@query("render_views", f"""
SELECT {_j("'### View: ' || name", "CASE WHEN schema <> '' THEN '**Schema**: ' || schema || chr(10) ELSE '' END || "
           "CASE WHEN coalesce(comment, '') <> '' THEN '**Description**: ' || comment || chr(10) ELSE '' END || ''",
           "'**Definition**:'", "'```sql'", "coalesce(definition, '')", "'```'", "''")} AS text
FROM ({duck_sql(VIEW_LISTING)}) WHERE upper(kind) = 'VIEW'
""")
def q_render_views(spark, sf):
    return render_objects(list_views(spark_sql(spark, sf, VIEW_LISTING)), "views").select("text")


@query("render_routines", f"""
SELECT {_j("'### ' || name", "'**Schema**: ' || schema",
           "CASE WHEN coalesce(return_type, '') <> '' THEN '**Returns**: ' || return_type || chr(10) "
           "ELSE '' END || ''")} AS text
FROM ({duck_sql(ROUTINE_LISTING)}) WHERE upper(routine_type) IN ('PROCEDURE', 'FUNCTION')
""")
def q_render_routines(spark, sf):
    return render_objects(list_routines(spark_sql(spark, sf, ROUTINE_LISTING), "oracle"),
                          "routines").select("text")


@query("render_exchanges", f"""
SELECT {_j("'### Exchange: ' || name", "'**Type**: ' || type",
           "'**Durable**: ' || CASE WHEN durable THEN 'Yes' ELSE 'No' END",
           "'**Auto Delete**: ' || CASE WHEN auto_delete THEN 'Yes' ELSE 'No' END",
           "'**Internal**: ' || CASE WHEN internal THEN 'Yes' ELSE 'No' END",
           "''", "'---'", "''")} AS text
FROM ({duck_sql(EXCHANGES)}) WHERE name <> ''
""")
def q_render_exchanges(spark, sf):
    ex = normalise_topology(spark_sql(spark, sf, EXCHANGES), "exchanges")
    return render_objects(ex, "exchanges").select("text")


@query("render_cache", f"""
SELECT {_j("'### Pattern: *'", "'**Count**: ' || format('{:,}', coalesce(sum(s_nationkey), 0))",
           "''", "'**Note**: N/A (Memcached does not support key enumeration)'", "''",
           "'---'", "''")} AS text
FROM supplier
""")
def q_render_cache(spark, sf):
    stats = read_table(spark, sf, "supplier").select(
        F.col("s_name").alias("server"), F.col("s_nationkey").alias("curr_items"))
    return render_objects(cache_totals(stats), "cache_patterns").select("text")


@query("render_storage_tables")
def q_render_storage_tables(spark, sf):
    st = storage_stats(table_paths(sf), spark).select(
        F.col("table").alias("name"), F.lit("Parquet").alias("engine"),
        F.lit(None).cast("string").alias("partition_key"),
        F.lit(None).cast("string").alias("sorting_key"),
        F.lit(None).cast("string").alias("primary_key"), "total_rows", "total_bytes")
    return render_objects(st, "storage_tables")


@query("render_vector_collections", """
SELECT '### Collection: embeddings' || chr(10) || '**Entities**: ' || format('{:,}', count(vec_id))
       || chr(10) || '' || chr(10) || '**Fields**:' || chr(10) || '' || chr(10)
       || '| Name | Type | Primary | Dimension |' || chr(10)
       || '|------|------|---------|-----------|' || chr(10)
       || '| **vec_id** | Int64 | Yes | - |' || chr(10)
       || '| embedding | FloatVector(' || CAST(max(len(embedding)) AS VARCHAR) || ') | No | '
       || CAST(max(len(embedding)) AS VARCHAR) || ' |' || chr(10)
       || '| label | Int32 | No | - |' || chr(10) || '' || chr(10) || '---' || chr(10) || '' AS text
FROM embeddings
""")
def q_render_vector_collections(spark, sf):
    prof = vector_profile(read_table(spark, sf, "embeddings"), "vec_id", "embedding")
    field = "struct<name:string,type:string,is_primary:boolean,dimension:int>"
    coll = prof.select(
        F.lit("embeddings").alias("name"), F.lit(None).cast("string").alias("description"),
        "entities", F.lit(None).cast("int").alias("shards"),
        F.array(
            F.struct(F.lit("vec_id").alias("name"), F.lit("Int64").alias("type"),
                     F.lit(True).alias("is_primary"), F.lit(None).cast("int").alias("dimension")),
            F.struct(F.lit("embedding").alias("name"),
                     F.concat(F.lit("FloatVector("), F.col("dimension").cast("string"),
                              F.lit(")")).alias("type"),
                     F.lit(False).alias("is_primary"), F.col("dimension").alias("dimension")),
            F.struct(F.lit("label").alias("name"), F.lit("Int32").alias("type"),
                     F.lit(False).alias("is_primary"),
                     F.lit(None).cast("int").alias("dimension"))).cast(f"array<{field}>")
        .alias("fields"),
        F.lit(None).cast("array<struct<index_name:string,field_name:string,index_type:string,"
                         "metric:string>>").alias("indexes"))
    return render_objects(coll, "vector_collections").select("text")


# A catalogue in which every table has twenty columns, five index columns and
# five key columns at most, however large the testdata; the same table, index and
# constraint names stand in two schemas, and some types and names are null.
RENDER_COLUMNS = """
SELECT concat('shop', CAST(CAST(floor(p_partkey / 10) AS BIGINT) % 2 AS STRING)) AS schema,
  concat('t', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)) AS table_name,
  CAST(p_partkey AS INT) AS ordinal_position,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS column_name,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS column_type,
  CASE WHEN p_partkey % 3 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS column_default,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS column_comment,
  CASE WHEN p_size % 7 = 0 THEN 'PRI' WHEN p_size % 7 = 1 THEN 'UNI' ELSE '' END AS column_key,
  CASE WHEN p_partkey % 6 = 0 THEN 'auto_increment' ELSE '' END AS extra,
  CAST(p_size % 4 * 64 AS BIGINT) AS character_maximum_length
FROM {part}"""
RENDER_INDEX_ROWS = """
SELECT concat('shop', CAST(CAST(floor(c_custkey / 10) AS BIGINT) % 2 AS STRING)) AS schema,
  concat('t', CAST(CAST(floor(c_custkey / 20) AS BIGINT) AS STRING)) AS table,
  CASE c_custkey % 4 WHEN 0 THEN 'PRIMARY' ELSE concat('idx_', CAST(c_custkey % 4 AS STRING))
  END AS index_name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS column_name, CAST(c_custkey AS INT) AS seq,
  CAST(c_custkey % 4 % 2 AS INT) AS non_unique,
  CASE c_custkey % 4 WHEN 3 THEN 'FULLTEXT' WHEN 1 THEN NULL ELSE 'BTREE' END AS index_type
FROM {customer}"""
RENDER_FK_KEY_USAGE = """
SELECT concat('shop', CAST(CAST(floor(s_suppkey / 5) AS BIGINT) % 2 AS STRING)) AS schema,
  concat('fk_', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) % 3 AS STRING)) AS constraint_name,
  concat('t', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING)) AS table,
  s_name AS column_name, CAST(s_suppkey AS INT) AS ordinal,
  CASE WHEN CAST(floor(s_suppkey / 5) AS BIGINT) % 4 = 0 THEN NULL ELSE 'ref' END AS referenced_table,
  concat('r', CAST(s_nationkey AS STRING)) AS referenced_column
FROM {supplier}"""
RENDER_FK_RULES = """
SELECT DISTINCT concat('shop', CAST(CAST(floor(s_suppkey / 5) AS BIGINT) % 2 AS STRING)) AS schema,
  concat('fk_', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) % 3 AS STRING)) AS constraint_name,
  concat('t', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING)) AS table,
  CASE CAST(floor(s_suppkey / 10) AS BIGINT) % 3 WHEN 0 THEN 'CASCADE' WHEN 1 THEN 'RESTRICT' ELSE '' END
    AS update_rule,
  CASE WHEN CAST(floor(s_suppkey / 10) AS BIGINT) % 2 = 0 THEN 'CASCADE' ELSE 'NO ACTION' END AS delete_rule
FROM {supplier}"""


def _render_catalogue(spark, sf):
    """The four inputs of a rendered catalogue: tables, columns, indexes, foreign keys."""
    cols = normalise_columns(spark_sql(spark, sf, RENDER_COLUMNS), "mysql").drop("database")
    tables = cols.groupBy("schema", "table").agg(F.count(F.lit(1)).cast("bigint").alias("row_count")) \
        .select("schema", "table", F.lit(None).cast("string").alias("comment"), "row_count")
    idx = assemble_indexes(spark_sql(spark, sf, RENDER_INDEX_ROWS))
    fks = assemble_foreign_keys(spark_sql(spark, sf, RENDER_FK_KEY_USAGE),
                                spark_sql(spark, sf, RENDER_FK_RULES))
    return tables, cols, idx, fks


_MYSQL_COLUMNS = f"""
SELECT schema, table_name AS "table", ordinal_position AS ordinal, coalesce(column_name, 'unknown') AS name,
  coalesce(column_type, 'unknown') AS type, is_nullable = 'YES' AS nullable, column_default AS default_value,
  nullif(column_comment, '') AS comment, coalesce(column_key = 'PRI', false) AS is_primary_key,
  coalesce(contains(extra, 'auto_increment'), false) AS is_auto_increment
FROM ({duck_sql(RENDER_COLUMNS)})"""

_TABLE_BLOCKS = f"""
WITH cols AS ({_MYSQL_COLUMNS}),
cl AS (SELECT schema, "table", count(*) AS rc,
  string_agg('| ' || CASE WHEN is_primary_key THEN '**' || name || '** (PK)' ELSE name END
             || ' | ' || CASE WHEN is_auto_increment THEN type || ' AUTO_INCREMENT' ELSE type END
             || ' | ' || CASE WHEN nullable THEN 'YES' ELSE 'NO' END
             || ' | ' || CASE WHEN coalesce(default_value, '') <> '' THEN default_value ELSE '-' END
             || ' | ' || coalesce(comment, '') || ' |', chr(10) ORDER BY ordinal, name) AS lines
  FROM cols GROUP BY schema, "table"),
ix AS (SELECT schema, "table", index_name AS name,
         string_agg(coalesce(column_name, 'unknown'), ', ' ORDER BY seq, column_name) AS columns,
         min(non_unique) = 0 AS is_unique, index_name = 'PRIMARY' AS is_primary,
         min(index_type) AS type
       FROM ({duck_sql(RENDER_INDEX_ROWS)}) GROUP BY schema, "table", index_name),
il AS (SELECT schema, "table", string_agg('- ' || CASE WHEN is_primary THEN 'PRIMARY KEY'
             WHEN is_unique THEN 'UNIQUE' ELSE 'INDEX' END
             || CASE WHEN coalesce(type, '') <> '' THEN ' (' || type || ')' ELSE '' END
             || ': `' || name || '` on (' || columns || ')', chr(10) ORDER BY name) AS lines
       FROM ix GROUP BY schema, "table"),
fj AS (SELECT k.*, r.update_rule, r.delete_rule
       FROM ({duck_sql(RENDER_FK_KEY_USAGE)}) k JOIN ({duck_sql(RENDER_FK_RULES)}) r
       ON k.schema = r.schema AND k."table" = r."table" AND k.constraint_name = r.constraint_name),
fx AS (SELECT schema, "table", constraint_name AS name, coalesce(referenced_table, 'unknown') AS referenced_table, delete_rule, update_rule,
         string_agg(column_name, ', ' ORDER BY ordinal, column_name, referenced_column) AS cols,
         string_agg(referenced_column, ', ' ORDER BY ordinal, column_name, referenced_column)
           AS rcols
       FROM fj GROUP BY schema, "table", constraint_name, referenced_table, delete_rule, update_rule),
fl AS (SELECT schema, "table", string_agg('- `' || name || '`: (' || cols || ') REFERENCES '
             || referenced_table || '(' || rcols || ')'
             || CASE WHEN coalesce(delete_rule, '') <> ''
                     THEN chr(10) || '  - ON DELETE: ' || delete_rule ELSE '' END
             || CASE WHEN coalesce(update_rule, '') <> ''
                     THEN chr(10) || '  - ON UPDATE: ' || update_rule ELSE '' END,
             chr(10) ORDER BY name) AS lines
       FROM fx GROUP BY schema, "table")
SELECT {_j("'### Table: ' || cl.\"table\"", "'**Schema**: ' || cl.schema",
           "'**Row Count**: ' || format('{:,}', cl.rc)", "''", "'**Columns**:'", "''",
           "'| Name | Type | Nullable | Default | Comment |'",
           "'|------|------|----------|---------|---------|'", "cl.lines", "''")}
  || CASE WHEN il.lines IS NULL THEN ''
          ELSE {_j("''", "'**Indexes**:'", "il.lines", "''")} END
  || chr(10) || CASE WHEN fl.lines IS NULL THEN {_j("'**Foreign Keys**: None'", "''")}
          ELSE {_j("'**Foreign Keys**:'", "fl.lines", "''")} END
  || chr(10) || '---' || chr(10) AS text
FROM cl LEFT JOIN il USING (schema, "table") LEFT JOIN fl USING (schema, "table")
"""


@query("render_table_blocks", _TABLE_BLOCKS)
def q_render_table_blocks(spark, sf):
    return render_objects(nest_table_details(*_render_catalogue(spark, sf)), "tables").select("text")


_TABLE_CTES = _TABLE_BLOCKS[:_TABLE_BLOCKS.index("\nSELECT '### Table: '")]


@query("render_table_details", _TABLE_CTES + f"""
SELECT {_j("'# Table: ' || cl.\"table\"", "''", "'**Schema**: ' || cl.schema",
           "'**Row Count**: ' || format('{:,}', cl.rc)", "''", "'## Columns'", "''",
           "'| Name | Type | Nullable | Default | Comment |'",
           "'|------|------|----------|---------|---------|'", "cl.lines", "''")}
  || CASE WHEN il.lines IS NULL THEN ''
          ELSE {_j("''", "'## Indexes'", "''", "il.lines", "''")} END
  || CASE WHEN fl.lines IS NULL THEN ''
          ELSE {_j("''", "'## Foreign Keys'", "''", "fl.lines")} END AS text
FROM cl LEFT JOIN il USING (schema, "table") LEFT JOIN fl USING (schema, "table")
WHERE cl."table" = 't1' AND cl.schema = 'shop1'
UNION ALL
SELECT 'Table "no_such_table" not found in database "shop".' AS text
""")
def q_render_table_details(spark, sf):
    four = _render_catalogue(spark, sf)
    return render_table_details(*four, "shop", "t1", "shop1").unionByName(
        render_table_details(*four, "shop", "no_such_table"))
